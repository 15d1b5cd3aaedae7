"""Operator 1: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A document is
parsed greedily with each automaton: a phrase is the longest match from the
current place that occurs in the language's text, then the next phrase begins.
Few phrases mean low cross-entropy; the language with the fewest phrases,
normalised by the documents' length and the size of the training text, wins.

The automaton's greedy parse is a finite-state machine, so a task holds one
table per language and runs all blocks of an Arrow batch through it in step.
Blocks are ``BLOCK`` bytes of one document, read from the start state first.
Then each block is read again from the state in which the one before ends, until both
readings are in the same state, so a phrase goes on across blocks and the
phrases are those of the whole text.

Defined cases: null or empty text, or text without a letter, gives ``und`` with
score 0; without any labelled training row every document gives ``und``.  Ties
go to the language with more training bytes, then to the first by code point.
Texts of any length are parsed whole.
Repeated rows are kept, an input column called like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mesolite.llm import _words as W
from mesolite.llm._spark import crc_fold, documents

BLOCK = 1024
UND = "und"

#: Lower case; digits, marks and white space of ASCII become a space.
LETTERS = W.FOLD.copy()
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def letters_only(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with each run of ASCII non-letters as one space, so that numbers and marks tell no language."""
    if len(raw) == 0:
        return raw, offsets
    raw = LETTERS[raw]
    gap = raw == 0x20
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


@dataclass
class Automaton:
    lang: str
    size: int
    #: flat table: entry state * classes + class holds next state * classes * 2 + (1 if a phrase begins here)
    table: np.ndarray
    classes: int
    byte_class: np.ndarray


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def greedy_machine(lang: str, data: bytes) -> Automaton:
    """The greedy parse over ``data``'s automaton as a table of next states."""
    nxt = suffix_automaton(data)
    seen = sorted(set(data))
    byte_class = np.zeros(256, np.uint8)
    byte_class[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    root = np.zeros(a, np.int64)
    for c, s in nxt[0].items():
        root[byte_class[c]] = s
    table = np.tile((root * a * 2 + 1).astype(np.int32), (len(nxt), 1))
    rows = np.repeat(np.arange(len(nxt)), [len(t) for t in nxt])
    cols = np.fromiter((byte_class[c] for t in nxt for c in t), np.int64, len(rows))
    goes = np.fromiter((s for t in nxt for s in t.values()), np.int64, len(rows))
    table[rows, cols] = goes * a * 2
    table[0] = root * a * 2 + 1
    return Automaton(lang, len(data), table.ravel(), a, byte_class)


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    texts_per_lang: int = 96,
    longest_text: int = 4096,
    total_bytes: int = 384 << 10,
    bytes_per_lang: int = 64 << 10,
) -> list[Automaton]:
    """Automata from a bounded sample of labelled rows.

    The bound: per language at most ``texts_per_lang`` rows, one for each
    residue of the row's hash, short rows (up to ``longest_text`` characters)
    before longer ones, as many whole texts as fit in ``bytes_per_lang`` bytes,
    or in ``total_bytes`` over the number of languages where that is less.  Only
    where the first text alone is longer it is cut there.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    h = F.xxhash64(F.col(id_col).cast("string"))
    order = F.struct((F.length(text_col) > longest_text).alias("long"), h.alias("h"))
    picked = (
        labelled.groupBy(F.col(lang_col).cast("string").alias("lang"), F.pmod(h, F.lit(texts_per_lang)).alias("slot"))
        .agg(F.min_by(F.substring(text_col, 1, bytes_per_lang), order).alias("text"), F.min(order).alias("o"))
        .select("lang", "text", "o.long", "o.h")
    )
    texts: dict[str, list[tuple]] = {}
    for r in picked.toLocalIterator():  # at most texts_per_lang rows of bytes_per_lang characters for each language
        texts.setdefault(r.lang, []).append((r.long, r.h, r.text))
    if not texts:
        return []
    limit = max(256, min(bytes_per_lang, total_bytes // len(texts)))
    out = []
    for lang in sorted(texts):
        own = [t.encode() for *_, t in sorted(texts[lang])]
        ends = np.cumsum([len(t) + 1 for t in own])
        data = b"\n".join(own[: max(1, int(np.searchsorted(ends, limit + 1, side="right")))])[: max(limit, 1)]
        out.append(greedy_machine(lang, bytes(letters_only(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])))
    return out


def phrases(raw: np.ndarray, offsets: np.ndarray, machines: list[Automaton]) -> np.ndarray:
    """Phrases of each row for each machine (rows x machines)."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    out = np.zeros((len(sizes), len(machines)), np.int64)
    if total == 0:
        return out
    owner = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = offsets[owner] + nth * BLOCK
    length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(int(length[order[0]])), side="left")  # blocks longer than t
    by_nth = np.argsort(nth, kind="stable")
    rounds = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
    went = np.zeros(len(raw), np.int32)
    for m, machine in enumerate(machines):
        kinds, count = machine.byte_class[raw], np.zeros(total, np.int64)
        for lo in range(0, total, 2048):
            own = order[lo : lo + 2048]
            state, n, at = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32), begin[own]
            for t in range(int(length[own[0]])):
                k = min(int(live[t]), lo + len(own)) - lo
                v = machine.table[state[:k] + kinds[at[:k] + t]]
                went[at[:k] + t] = v
                n[:k] += v & 1
                state[:k] = v >> 1
            count[own] = n
        ends = went[begin + length - 1] >> 1
        for r in range(1, len(rounds) - 1):  # the next block of each text, from where the one before ends
            own = by_nth[rounds[r] : rounds[r + 1]]
            state, t = ends[own - 1], 0
            while len(own):
                at = begin[own] + t
                v, old = machine.table[state + kinds[at]], went[at]
                count[own] += (v & 1) - (old & 1)
                state = v >> 1
                apart = state != old >> 1
                t += 1
                over = apart & (t == length[own])
                ends[own[over]] = state[over]
                own, state = own[apart & ~over], state[apart & ~over]
        out[:, m] = np.bincount(owner, count, len(sizes))
    return out


def identify(docs: DataFrame, machines: list[Automaton], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1, the winner's lead over the second) and ``phrase_bytes`` (mean phrase length)."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "phrase_bytes", "has_letter__")
    shared = spark.sparkContext.broadcast(machines)
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_bytes", T.DoubleType())]

    def run(batches):
        ms = shared.value
        names = np.array([m.lang for m in ms] + [UND], dtype=object)
        rate = np.array([np.log2(m.size + 1) for m in ms])
        rank = np.argsort([(-m.size) for m in ms], kind="stable")
        for batch in W.pieces(batches, text_col):
            letter = batch.column("has_letter__").to_numpy(zero_copy_only=False).astype(bool)
            raw, off = W.utf8_buffer(batch.column(text_col))
            n = len(letter)
            win, score, mean = np.full(n, len(ms)), np.zeros(n), np.zeros(n)
            if ms and n:
                raw, off = letters_only(raw, off)
                found = phrases(raw, off, ms)
                cost = found * rate
                cost = cost[:, rank]
                best = np.argmin(cost, axis=1)
                lowest = cost[np.arange(n), best]
                if len(ms) > 1:
                    second = np.partition(cost, 1, axis=1)[:, 1]
                    score = np.where(second > 0, 1 - lowest / np.maximum(second, 1e-9), 0.0)
                else:
                    score = np.ones(n)
                size = np.diff(off)
                mean = size / np.maximum(found[:, rank][np.arange(n), best], 1)
                win = np.where(letter, rank[best], len(ms))
                score = np.where(letter, np.clip(score, 0, 1), 0.0)
                mean = np.where(letter, mean, 0.0)
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.field(i).name != "has_letter__"]
            kept = [f for f in batch.schema if f.name != "has_letter__"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names[win], pa.string()), pa.array(score, pa.float64()), pa.array(mean, pa.float64())],
                schema=pa.schema([*kept, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("phrase_bytes", pa.float64())]),
            )

    marked = docs.withColumn("has_letter__", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, T.StructType(fields))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    machines = learn(docs.filter(crc_fold("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), machines)
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "phrase_bytes")
