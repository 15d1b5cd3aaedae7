"""Operator 9: benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window).  A document contains a window only if it contains each of the
window's words, so the necessary prefix of a window, ordered by rarity, is its
one rarest word.  Rarity is counted over all documents for the benchmark's
words.  Documents are joined with windows on that word; the word's place in the
window fixes where the window would have to lie, which gives the positional
and length bounds; what is left is verified word by word.

The benchmark is taken in blocks of at most ``WINDOWS_PER_BLOCK`` windows, so
what a task holds is bounded for a benchmark of any size; each block is one
pass over the documents and the hits of former blocks travel with the rows.

Defined cases: null or empty text has no words and is clean; items without
words never occur; windows of items with a null id hit words, but such items
are not reported; equal items are each reported; items with one id count once;
very long texts and items are read whole; repeated rows are kept; an input column called like an
output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mesolite.llm import _words as W
from mesolite.llm._spark import documents, written

WINDOW = 13
WINDOWS_PER_BLOCK = 200_000


@dataclass
class Windows:
    """Distinct windows of one block, sorted by their prefix word."""

    words: np.ndarray  # windows x WINDOW, zero beyond the length
    length: np.ndarray
    prefix: np.ndarray  # hash of the rarest word
    offset: np.ndarray  # its place
    items: list[list[str]]

    def __post_init__(self) -> None:
        self.keys, self.first = np.unique(self.prefix, return_index=True)
        self.last = np.append(self.first[1:], len(self.prefix))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.keys & np.uint64(0xFFFF)] = True


def item_windows(texts: list[str], ids: list[str | None]) -> dict[tuple, set[str]]:
    words, first = W.fold_words(pa.array(texts, pa.string()), W.ALNUM)
    found: dict[tuple, set[str]] = {}
    for i, item in enumerate(ids):
        own = words[first[i] : first[i + 1]].tolist()
        for k in range(max(1, len(own) - WINDOW + 1) if own else 0):
            found.setdefault(tuple(own[k : k + WINDOW]), set()).update(() if item is None else (item,))
    return found


def blocks_of(benchmark: DataFrame, text_col: str, id_col: str):
    """The benchmark's windows, block by block; the driver holds one block at a time."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col)
    texts, ids, room = [], [], WINDOWS_PER_BLOCK
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        texts.append(text)
        ids.append(item)
        room -= max(1, len(text) // 2)
        if room <= 0:
            yield item_windows(texts, ids)
            texts, ids, room = [], [], WINDOWS_PER_BLOCK
    if texts:
        yield item_windows(texts, ids)


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> dict[int, int]:
    """How often each of ``vocabulary`` (bounded by one block) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def run(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in W.pieces(batches, 0):
            words, _ = W.fold_words(batch.column(0), W.ALNUM)
            if len(words):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                total += np.bincount(at[known[at] == words], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.word).view(np.uint64)): r.n for r in counted.toLocalIterator()}


def order_by_rarity(found: dict[tuple, set[str]], count: dict[int, int]) -> Windows:
    n = len(found)
    words, length = np.zeros((n, WINDOW), np.uint64), np.zeros(n, np.int64)
    prefix, offset, items = np.zeros(n, np.uint64), np.zeros(n, np.int64), []
    ranked = []
    for window, names in found.items():
        k = min(range(len(window)), key=lambda j: (count.get(window[j], 0), window[j], j))
        ranked.append((window[k], k, window, sorted(names)))
    ranked.sort(key=lambda x: x[0])
    for i, (p, k, window, names) in enumerate(ranked):
        words[i, : len(window)] = window
        length[i], prefix[i], offset[i] = len(window), p, k
        items.append(names)
    return Windows(words, length, prefix, offset, items)


def contained(words: np.ndarray, first: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, window) of every occurrence of a window in the rows' words."""
    none = np.zeros(0, np.int64)
    if len(words) == 0 or len(win.keys) == 0:
        return none, none
    at = np.flatnonzero(win.sieve[words & np.uint64(0xFFFF)])
    key = np.minimum(np.searchsorted(win.keys, words[at]), len(win.keys) - 1)
    same = win.keys[key] == words[at]
    at, key = at[same], key[same]
    fan = win.last[key] - win.first[key]
    starts, windows = [none], [none]
    for lo in range(0, len(at), 65536):  # bounds what a frequent word brings in at once
        part = slice(lo, lo + 65536)
        f = fan[part]
        w = np.repeat(win.first[key[part]], f) + np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f)
        s = np.repeat(at[part], f) - win.offset[w]
        row = np.searchsorted(first, np.repeat(at[part], f), side="right") - 1
        ok = (s >= first[row]) & (s + win.length[w] <= first[row + 1])
        s, w = s[ok], w[ok]
        for j in range(WINDOW):
            ok = (j >= win.length[w]) | (words[np.minimum(s + j, len(words) - 1)] == win.words[w, j])
            s, w = s[ok], w[ok]
        starts.append(s)
        windows.append(w)
    return np.concatenate(starts), np.concatenate(windows)


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans, flat."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def mark(docs: DataFrame, win: Windows, text_col: str) -> DataFrame:
    """One pass: ``n_words``, ``hit_spans`` (word places, flat) and ``hit_items``, joined with those of former passes."""
    shared = docs.sparkSession.sparkContext.broadcast(win)
    known = {"n_words", "hit_spans", "hit_items"}
    fields = [f for f in docs.schema.fields if f.name not in known]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))])

    def run(batches):
        w = shared.value
        for batch in W.pieces(batches, text_col):
            words, first = W.fold_words(batch.column(text_col), W.ALNUM)
            n = batch.num_rows
            spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
            if "hit_spans" in batch.schema.names:
                spans, items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            start, window = contained(words, first, w)
            row = np.searchsorted(first, start, side="right") - 1
            for r in np.unique(row):
                own = row == r
                s, k = start[own] - first[r], window[own]
                former = spans[r]
                spans[r] = _merge([*zip(former[::2], former[1::2], strict=True), *zip(s.tolist(), (s + w.length[k]).tolist(), strict=True)])
                items[r] = sorted({*items[r], *(x for j in set(k.tolist()) for x in w.items[j])})
            rest = [i for i, f in enumerate(batch.schema) if f.name not in known]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                schema=pa.schema([*(batch.schema.field(i) for i in rest), pa.field("n_words", pa.int64()), pa.field("hit_spans", pa.list_(pa.int64())), pa.field("hit_items", pa.list_(pa.string()))]),
            )

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans``, ``hit_items``, ``n_hit``, ``n_items`` and ``contaminated``.

    Contaminated: at least one word in twenty lies inside an occurrence of a window.
    """
    out = docs.drop("n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated")
    n = 0
    for found in blocks_of(benchmark, item_text_col, item_id_col):
        if not found:
            continue
        if n and n % 8 == 0:
            out = written(out, "decontamination")
        vocabulary = np.unique(np.array([x for w in found for x in w], np.uint64))
        out = mark(out, order_by_rarity(found, word_counts(docs, vocabulary, text_col)), text_col)
        n += 1
    if n == 0:
        nothing = Windows(np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), [])
        out = mark(out, nothing, text_col)
    n_hit = F.expr("aggregate(hit_spans, struct(0L AS at, 0L AS n), (a, x) -> struct(a.at + 1 AS at, if(a.at % 2 = 0, a.n - x, a.n + x) AS n)).n")
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("hit_items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # the text is dropped inside the job; only the marks leave it
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + 12) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(g) AS n FROM win
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), place AS (
  SELECT rid, k, n, list_slice(w, k, k + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, lens WHERE len(w) >= n)
), hit AS (SELECT rid, k, n, item_id FROM place JOIN win USING (g)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT cast(item_id AS VARCHAR))), ',') AS names FROM hit WHERE item_id IS NOT NULL GROUP BY rid
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
