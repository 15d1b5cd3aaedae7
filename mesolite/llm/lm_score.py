"""Operator 6: scoring with a hashed maximum-entropy language model.

The probability of a token is factored by classes: P(class | context) times
P(part of the class | class, context) times P(token | part).  The most frequent
words are classes of their own, the end of a text is one, the others fall into
classes by their first and last byte; a class has ``PARTS`` parts, dealt by the
words' hashes.

* P(class | context) and P(part | class, context) are maximum-entropy models
  (softmax) over hashed features: the word before (bigram), the two words
  before (trigram) and the word before that (skip), for parts together with the
  class, beside a feature of the class or part itself, whose weight is its log
  frequency.  The number of buckets of a feature doubles with the training
  tokens, up to ``2**MOST_BUCKET_BITS``.
* They are trained by distributed gradient updates: all tasks add up, for the
  common weights, observed and expected counts of each weight, whose difference
  is the gradient; a step is scaled by the expected count and taken in the log
  domain (generalised iterative scaling).  At the first step the expected
  counts follow from the observed ones; later ones take a pass and are taken
  for the classes' weights.  Counts are
  whole numbers, expected ones in ``2**-16``, so their sums, the model and the
  scores are the same however the texts are dealt to tasks.
* P(token | part) is the maximum-entropy model of the word's own feature, which
  is its smoothed relative frequency, with one place for unseen words.

Counts cover all training texts.  The most frequent words (bounded by
``MOST_WORDS``) are sent to the tasks; what a text holds beside them is joined
with the whole table of counts.

Defined cases: null or empty text is its end alone; a very long text is read
like any other; a null id counts as empty text for the hold-out; repeated rows
are counted and scored each; words of equal count are ordered by hash; without
training texts all counts are 0 and classes are uniform; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm import _words as W
from mesolite.llm._fold import emit_chunks, fold_fixed
from mesolite.llm._spark import crc_fold, documents, written

MOST_WORDS = 1 << 19
OWN, CLASSES, PARTS = 15, 32, 32
END_CLASS = OWN
LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 8, 14
TOKENS_PER_BUCKET = 1 << 13
FEATURES = 3
UPDATES = 2
RATE, DAMPING = 0.5, 2.0
STEP = 4096
FIXED = 1 << 16
END = np.uint64(0x5EED0E4D)
START = np.uint64(0x57A57)
_U = np.uint64


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    own: np.ndarray  # hashes of the words that are classes, sorted
    own_class: np.ndarray
    n: int
    v: int
    end_count: int
    part_n: np.ndarray  # CLASSES x PARTS: tokens and words of each part
    part_v: np.ndarray
    bias: np.ndarray  # CLASSES
    part_bias: np.ndarray  # CLASSES x PARTS
    weights: np.ndarray  # 2 x FEATURES x buckets x CLASSES (or PARTS)


def part_of(h: np.ndarray) -> np.ndarray:
    return (W.mix(h) % _U(PARTS)).astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte classes, and the first word of each row."""
    raw, offsets = W.utf8_buffer(column)
    raw = W.FOLD[raw]
    starts, ends, first = W.split_words(raw, offsets)
    h = W.hash_spans(raw, starts, ends)
    shape = raw[starts].astype(_U) * _U(256) + raw[ends - 1] if len(starts) else np.zeros(0, _U)
    kind = END_CLASS + 1 + (W.mix(shape) % _U(CLASSES - END_CLASS - 1)).astype(np.int64)
    return h, kind, first


@dataclass
class Sequences:
    row: np.ndarray
    cls: np.ndarray
    part: np.ndarray
    inner: np.ndarray  # the tokens that have parts
    buckets: np.ndarray  # FEATURES x tokens
    part_buckets: np.ndarray  # FEATURES x inner tokens
    at: np.ndarray  # where the words went


def sequences(h: np.ndarray, kind: np.ndarray, first: np.ndarray, own: np.ndarray, own_class: np.ndarray, buckets: int) -> Sequences:
    """The rows' tokens with their ends."""
    rows = len(first) - 1
    at = np.arange(len(h)) + W.row_of(first, len(h))
    total = len(h) + rows
    seq, cls, row = np.full(total, END), np.full(total, END_CLASS), np.repeat(np.arange(rows), np.diff(first) + 1)
    if len(h):
        seq[at] = h
        k = kind
        if len(own):
            place = np.minimum(np.searchsorted(own, h), len(own) - 1)
            k = np.where(own[place] == h, own_class[place], kind)
        cls[at] = k
    begin = (first[:-1] + np.arange(rows))[row] if rows else np.zeros(0, np.int64)
    i = np.arange(total)
    one = np.where(i - 1 >= begin, seq[np.maximum(i - 1, 0)], START) if total else seq
    two = np.where(i - 2 >= begin, seq[np.maximum(i - 2, 0)], START) if total else seq
    context = np.stack([W.mix(one), W.mix(W.mix(one) + two), W.mix(two ^ _U(0xA5A5))])
    inner = np.flatnonzero(cls > END_CLASS)
    with_class = W.mix(context[:, inner] ^ W.mix(cls[inner].astype(_U) + _U(1)))
    mask = _U(buckets - 1)
    return Sequences(row, cls, part_of(seq), inner, (context & mask).astype(np.int64), (with_class & mask).astype(np.int64), at)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, cls, c) of every word of ``docs``."""

    def run(batches):
        for batch in W.pieces(batches, 0, 1 << 23):
            h, kind, _ = tokens(batch.column(0))
            u, where, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(kind[where].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h", "cls", "c"])

    return docs.select(text_col).mapInArrow(run, "h long, cls int, c long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


def log_softmax(weights: np.ndarray, bias: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    z = weights[0][buckets[0]] + bias
    for k in range(1, FEATURES):
        z += weights[k][buckets[k]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def observed_counts(docs: DataFrame, text_col: str, own: np.ndarray, own_class: np.ndarray, buckets: int) -> np.ndarray:
    """How often each weight's feature meets its class, or its part: 2 x FEATURES x buckets x CLASSES."""
    size = FEATURES * buckets * CLASSES

    def run(batches):
        total = np.zeros((2, size), np.int64)
        lift = np.arange(FEATURES)[:, None] * buckets
        for batch in W.pieces(batches, 0):
            q = sequences(*tokens(batch.column(0)), own, own_class, buckets)
            total[0] += np.bincount(((q.buckets + lift) * CLASSES + q.cls).ravel(), minlength=size)
            total[1] += np.bincount(((q.part_buckets + lift) * PARTS + q.part[q.inner]).ravel(), minlength=size)
        yield emit_chunks(total.ravel())

    got = fold_fixed(docs.select(text_col), run, "<i8", np.add)
    return (got if len(got) else np.zeros(2 * size, np.int64)).reshape(2, FEATURES, buckets, CLASSES)


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    by = np.argsort(rows, kind="stable")
    ids = rows[by]
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total[ids[heads]] += np.add.reduceat(values[by], heads, axis=0)


def expected_counts(docs: DataFrame, text_col: str, own: np.ndarray, own_class: np.ndarray, bias: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The counts of classes that the model of ``weights`` (FEATURES x buckets x CLASSES) expects, in whole ``1 / FIXED``."""
    shared = docs.sparkSession.sparkContext.broadcast((own, own_class, bias, weights))

    def run(batches):
        words, classes, own_feature, w = shared.value
        total = np.zeros(w.shape, np.int64)
        for batch in W.pieces(batches, 0):
            buckets = sequences(*tokens(batch.column(0)), words, classes, w.shape[1]).buckets
            for lo in range(0, buckets.shape[1], STEP):
                some = buckets[:, lo : lo + STEP]
                z = log_softmax(w, own_feature, some)
                np.exp(z, out=z)
                z *= FIXED
                z = np.rint(z, out=z).astype(np.int32)
                for k in range(FEATURES):
                    _add_rows(total[k], some[k], z)
        yield emit_chunks(total.ravel())

    got = fold_fixed(docs.select(text_col), run, "<i8", np.add)
    return (got if len(got) else np.zeros(weights.size, np.int64)).reshape(weights.shape)


def gradient_step(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A step up the gradient ``observed - expected``, scaled by ``expected`` and damped, in the log domain."""
    step = np.log1p((observed - expected) / (expected + DAMPING))
    return (weights + RATE * step).astype(np.float32)


def learn(docs: DataFrame, text_col: str = "text", updates: int = UPDATES) -> tuple[Model, DataFrame]:
    """The model, and the whole table of counts (h, cls, c)."""
    counts = written(count_words(docs, text_col), "counts")
    # the number of words by count, in a bounded number of steps, gives the least count of the most frequent ones
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64)).cast("int")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, least = MOST_WORDS, sizes[0][0] if sizes else 0
    for s, n in sizes:
        room -= n
        if room < 0:
            break
        least = s
    top = counts.filter(step >= least).orderBy(F.col("c").desc(), "h").limit(MOST_WORDS).select("h", "c").toArrow()
    h, c = top["h"].to_numpy().view(_U), top["c"].to_numpy()
    ranked = np.lexsort((h, -c))
    own = h[ranked[:OWN]]
    own_order = np.argsort(own)
    names, classes = own[own_order], np.arange(len(own))[own_order]
    by_hash = np.argsort(h)

    def parts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(batch.column(1).to_numpy().view(_U)).astype(np.int32)), batch.column(2)], names=["cls", "part", "c"])

    per = counts.filter(~F.col("h").isin([int(x) for x in own.view(np.int64)])) if len(own) else counts
    part_n, part_v = np.zeros((CLASSES, PARTS)), np.zeros((CLASSES, PARTS))
    for r in per.select("cls", "h", "c").mapInArrow(parts, "cls int, part int, c long").groupBy("cls", "part").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        part_n[r.cls, r.part], part_v[r.cls, r.part] = r.n, r.v
    n_docs = docs.count()
    in_class = part_n.sum(axis=1)
    in_class[: len(own)] = c[ranked[:OWN]]
    in_class[END_CLASS] = n_docs
    bias = np.log((in_class + 1) / (in_class.sum() + CLASSES)).astype(np.float32)
    part_bias = np.log((part_n + 1) / (part_n.sum(axis=1, keepdims=True) + PARTS)).astype(np.float32)

    n_tokens = int(total[0]) + n_docs
    buckets = 1 << min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, (n_tokens // TOKENS_PER_BUCKET).bit_length()))
    weights = np.zeros((2, FEATURES, buckets, CLASSES), np.float32)
    if updates:
        observed = observed_counts(docs, text_col, names, classes, buckets)
        # without weights every context expects the classes by their frequency; parts by that within their class, which the bucket mixes
        first = np.stack([observed[0].sum(axis=2, keepdims=True) * np.exp(bias.astype(np.float64)), observed[1].sum(axis=2, keepdims=True) * np.full(PARTS, 1 / PARTS)])
        weights = gradient_step(weights, observed, first)
        for _ in range(updates - 1):
            weights[0] = gradient_step(weights[0], observed[0], expected_counts(docs, text_col, names, classes, bias, weights[0]) / FIXED)
    model = Model(h[by_hash], c[by_hash], names, classes, n_tokens, int(total[1]) + (n_docs > 0), n_docs, part_n, part_v, bias, part_bias, weights)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        m = shared.value
        room = np.log10(m.part_n + m.part_v + 1)
        for batch in W.pieces(batches, 1):
            h, shape, first = tokens(batch.column(1))
            rows = batch.num_rows
            q = sequences(h, shape, first, m.own, m.own_class, m.weights.shape[2])
            by_row = np.zeros(rows)
            for level, buckets, own in ((0, q.buckets, np.arange(len(q.cls))), (1, q.part_buckets, q.inner)):
                for lo in range(0, len(own), STEP):
                    some = own[lo : lo + STEP]
                    z = log_softmax(m.weights[level], m.bias if level == 0 else m.part_bias[q.cls[some]], buckets[:, lo : lo + STEP])
                    got = z[np.arange(len(some)), q.cls[some] if level == 0 else q.part[some]].astype(np.float64)
                    by_row += np.bincount(q.row[some], got / np.log(10), rows)
            word_row = W.row_of(first, len(h))
            u, back = np.unique(h, return_inverse=True)
            known = np.zeros(len(u), np.int64)
            if len(m.words) and len(u):
                place = np.minimum(np.searchsorted(m.words, u), len(m.words) - 1)
                known = np.where(m.words[place] == u, m.counts[place], 0)
            c = known[back] if len(h) else np.zeros(0, np.int64)
            logs = np.log10(c + 1.0)
            top = np.bincount(word_row, logs, rows)
            n_top = np.bincount(word_row[c > 0], minlength=rows)
            other = q.cls[q.at] > END_CLASS
            inside = np.bincount(word_row[other], (logs - room[q.cls[q.at], q.part[q.at]])[other], rows)
            rest = c == 0
            rr, rh = word_row[rest], h[rest]
            order = np.lexsort((rh, rr))
            rr, rh = rr[order], rh[order]
            new = np.concatenate([[True], (rr[1:] != rr[:-1]) | (rh[1:] != rh[:-1])]) if len(rr) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            k = np.diff(np.append(heads, len(rr)))
            ends = np.searchsorted(rr[heads], np.arange(rows + 1)).astype(np.int32)
            listed = lambda values, kind_: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind_))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first) + 1, pa.int64()), pa.array(n_top, pa.int64()), pa.array(top), pa.array(by_row + inside), listed(rh[heads].view(np.int64), pa.int64()), listed(k.astype(np.int32), pa.int32())],
                names=["doc_id", "n_tokens", "n_top", "top", "model", "rest", "times"],
            )

    schema = f"doc_id {kind}, n_tokens long, n_top long, top double, model double, rest array<long>, times array<int>"
    parts = docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    parts = written(parts, "scores")
    each = parts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("k"))
    seen = each.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("k").alias("n"))
    out = parts.drop("rest", "times").join(seen, "row", "left")
    logs, n = F.coalesce("logs", F.lit(0.0)), F.coalesce("n", F.lit(0))
    end = float(np.log10(model.end_count + 1.0))
    base = F.col("top") + logs + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1.0)))
    return out.select("doc_id", "n_tokens", (F.col("n_top") + n + F.lit(int(model.end_count > 0))).alias("n_known"), base.alias("base_score"), F.round(F.col("model") + logs, 6).alias("score"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, counts = learn(docs.filter(crc_fold("doc_id", 7) != 2))
    out = score(docs, model, counts)
    return out.select("doc_id", (crc_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
