"""Vectorised byte-level word kernels shared by the text operators.

Every function works on the UTF-8 buffer of one Arrow batch, so a task holds
one batch at a time.  UTF-8 never encodes part of a non-ASCII character as an
ASCII byte, so word rules that only name ASCII characters can be applied to
bytes.  Words and shingles are carried as 64-bit mixes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_K1 = _U(0x9E3779B97F4A7C15)
_K2 = _U(0xBF58476D1CE4E5B9)
_K3 = _U(0x94D049BB133111EB)

#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (applied after folding)
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _K2
    h = (h ^ (h >> _U(27))) * _K3
    return h ^ (h >> _U(31))


def utf8_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches, column: int | str, most: int = 1 << 21):
    """The batches, cut so that a piece holds about ``most`` bytes of the column at most (one row at least)."""
    for batch in batches:
        values = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
        lo, n = 0, batch.num_rows
        ends = np.cumsum(lengths)
        while lo < n:
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def split_words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``raw``, and the first word of each row (one more than the rows)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = keep[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    out = (ends - starts).astype(np.uint64) * _K1
    if len(starts) == 0:
        return out
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    left = ends - starts
    live, at = None, starts
    while True:
        piece = eights[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ piece)
        else:
            out[live] = mix((out[live] + _K1) ^ piece)
        more = np.flatnonzero(left > 8)
        if len(more) == 0:
            return out
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def row_of(first_word: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of ``n`` words."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def shingle_hashes(words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words; a shorter non-empty row gives its whole sequence once."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.diff(first_word)
    row = row_of(first_word, n)
    place = np.arange(n) - first_word[row]
    begin = np.flatnonzero((place + k <= counts[row]) | ((place == 0) & (counts[row] < k)))
    length = np.minimum(counts[row[begin]], k)
    h = length.astype(np.uint64) * _K2
    if int(length.min()) == k:
        for j in range(k):
            h = mix((h + _K1) ^ words[begin + j])
    else:
        for j in range(k):
            live = length > j
            h = np.where(live, mix((h + _K1) ^ words[np.minimum(begin + j, n - 1)]), h)
    return row[begin], h


def fold_words(column: pa.Array, keep: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a folded string column and the first word of each row."""
    raw, offsets = utf8_buffer(column)
    raw = FOLD[raw]
    starts, ends, first = split_words(raw, offsets, keep)
    return hash_spans(raw, starts, ends), first


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash; ``row`` must ascend."""
    if len(h) == 0:
        return row, h
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]
