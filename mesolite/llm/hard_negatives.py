"""Operator 11: hard-negative mining by product quantisation with stored residual norms.

Vectors are whole numbers.  The index stores each row with the codes of its
pairs of components in a codebook, and with the lengths of what the codes leave
over, rounded up.  For an anchor, a table of inner products with the codebook
gives a row's score but for the residuals, and the sum of the products of
lengths bounds those, so every score lies in a known interval.  A row is reranked
by its exact whole-number product only if its interval meets the window and
reaches the k-th best score that is known so far; no row that belongs to a
result fails that test, so results are exact whatever the codebook.

Anchors come in blocks.  For each block two passes read the index, the first for
the positives, the second for the negatives of each positive's window.  A task
keeps the best few of each window and Spark ranks the tasks' lists.  The work is
that of anchors times rows, as the task asks; memory is bounded by the block.
The codebook is fitted on at most ``SAMPLE`` rows, those of the smallest hashes of
their ids; the bound decides how many rows are reranked, not the result.

Defined cases: rows without an id, label or vector, or with a component that is
null or not finite, take no part.  Shorter vectors count as ending in zeros.
Repeated rows are rows of their own, each may be an anchor, a positive and a
negative, and only an anchor's own row is not its positive.  Quantised components
beyond 2**24 count as 2**24.  Without anchors, or without rows in a window, there is
no result for them.  Columns of other names are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.llm._spark import counted, written
from mesolite.llm._vectors import embeddings, finite, matrix, quantised

SCALE = 256
EVERY = 100  # ids of anchors are divisible by it
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a window in hundredths of the positive's score
SAMPLE = 4096
WORDS = 256  # of the codebook, for each pair of components
ANCHORS = 1024  # of a block
ROWS = 512  # scored at a time
NONE = -(2**62)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def eligible(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return vectors.filter(known & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("embedding", scale).alias("vector"))


def mislabelled(rows: DataFrame, modulus: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` with every ``modulus``-th id's label moved to the next one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % modulus == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def codebook(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """(pairs, words, 2) whole numbers: Lloyd's rounds over each pair of components."""
    pairs = sample.shape[1] // 2
    words = min(WORDS, max(1, len(sample)))
    book = np.zeros((pairs, words, 2), np.int64)
    for m in range(pairs if len(sample) else 0):
        x = sample[:, 2 * m : 2 * m + 2].astype(np.float64)
        c = x[np.random.default_rng(m).permutation(len(x))[:words]]
        for _ in range(rounds):
            best = _nearest(x, c)
            n = np.bincount(best, minlength=words)
            new = np.stack([np.bincount(best, x[:, j], words) for j in (0, 1)], 1) / np.maximum(n, 1)[:, None]
            c = np.where(n[:, None] > 0, new, c)
        book[m] = np.rint(c)
    return book


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2.0 * (x @ c.T)).argmin(1)


def encode(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and lengths of the residuals rounded up, of rows of whole numbers."""
    pairs = book.shape[0]
    codes, norms = np.zeros((len(x), pairs), np.uint8), np.zeros((len(x), pairs), np.float32)
    for m in range(pairs):
        part = x[:, 2 * m : 2 * m + 2]
        codes[:, m] = best = _nearest(part.astype(np.float64), book[m].astype(np.float64))
        left = (part - book[m][best]).astype(np.float64)
        norms[:, m] = np.nextafter(np.sqrt((left * left).sum(1)).astype(np.float32), np.float32(np.inf))
    return codes, norms


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), dtype).reshape(len(got), -1)


def build_index(rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """The written index (row, vec_id, label, vector, codes, norms) and its codebook; none without rows."""
    first = rows.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").select("vector").limit(SAMPLE)
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows, None
    width = max(2, width + width % 2)
    book = codebook(matrix(first.toArrow().column("vector").cast(pa.list_(pa.int32())), width))

    def run(batches):
        for b in batches:
            x = matrix(b.column("vector"), width)
            codes, norms = encode(x, book)
            columns = [b.column("row"), b.column("vec_id"), b.column("label"), *map(_packed, (x.astype(np.int32), codes, norms))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "vector", "codes", "norms"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    return written(numbered.mapInArrow(run, "row long, vec_id long, label long, vector binary, codes binary, norms binary"), "negatives-index"), book


class Anchors:
    """A block of anchors as arrays; tasks make its lookup tables once."""

    def __init__(self, table: pa.Table, book: np.ndarray):
        self.row, self.vec_id, self.label = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.vector = _unpacked(table.column("vector"), np.int32).astype(np.int64)
        self.book = book

    def __len__(self) -> int:
        return len(self.row)

    def prepare(self) -> None:
        parts = self.vector.reshape(len(self), -1, 2).astype(np.float64)
        self.tables = [self.book[m].astype(np.float64) @ parts[:, m].T for m in range(self.book.shape[0])]
        self.lengths = np.sqrt((parts**2).sum(2)).T

    def interval(self, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of rows and anchors; rounding stays below what is added."""
        middle = self.tables[0][codes[:, 0]]
        for m in range(1, len(self.tables)):
            middle += self.tables[m][codes[:, m]]
        off = norms.astype(np.float64) @ self.lengths
        off *= 1 + 1e-9
        off += 16
        return middle - off, middle + off

    def exact(self, x: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 65536):
            part = slice(at, at + 65536)
            out[part] = np.einsum("ij,ij->i", x[i[part]], self.vector[q[part]])
        return out


class Best:
    """The best (score, id) of each window: higher scores first, then smaller ids."""

    def __init__(self, windows: int, most: int):
        self.score = np.full((windows, most), NONE)
        self.id = np.full((windows, most), 2**63 - 1)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, most = np.unique(w), self.score.shape[1]
        w = np.concatenate([np.repeat(touched, most), w])
        score, ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, w))
        w, score, ids = w[order], score[order], ids[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        kept = rank < most
        self.score[w[kept], rank[kept]], self.id[w[kept], rank[kept]] = score[kept], ids[kept]

    def batch(self) -> pa.RecordBatch:
        w, r = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(self.score[w, r]), pa.array(self.id[w, r])], names=["window", "score", "vec_id"])


def _pieces(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            p = b.slice(at, ROWS)
            row, ids, label = (p.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            yield row, ids, label, *(_unpacked(p.column(c), t) for c, t in (("vector", np.int32), ("codes", np.uint8), ("norms", np.float32)))


def _floor(best: np.ndarray, low: np.ndarray, sure: np.ndarray, most: int) -> np.ndarray:
    """What a score has to reach: the k-th best known, or the k-th highest lower bound of rows that surely belong."""
    if len(low) < most or (best > NONE).all():
        return best
    return np.maximum(best, np.partition(np.where(sure, low, NONE), -most, axis=0)[-most])


def _ranked(lists: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


LISTS = "window long, score long, vec_id long"


def positives(index: DataFrame, block: Anchors, most: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """Scores (``NONE`` where there are fewer) and ids of each anchor's best other rows of its label."""

    def run(batches):
        block.prepare()
        best = Best(len(block), most)
        for row, ids, label, x, codes, norms in _pieces(batches):
            own = (label[:, None] == block.label) & (row[:, None] != block.row)
            low, high = block.interval(codes, norms)
            i, q = np.nonzero(own & (high >= _floor(best.least(), low, own, most)))
            best.add(q, block.exact(x.astype(np.int64), i, q), ids[i])
        yield best.batch()

    score, ids = np.full((len(block), most), NONE), np.zeros((len(block), most), np.int64)
    found = _ranked(index.mapInArrow(run, LISTS), most).toArrow()
    at = found.column("window").to_numpy(), found.column("rank").to_numpy() - 1
    score[at], ids[at] = found.column("score").to_numpy(), found.column("vec_id").to_numpy()
    return score, ids


def negatives(index: DataFrame, block: Anchors, score: np.ndarray, ids: np.ndarray, most: int = NEGATIVES, low_pct: int = LOW, high_pct: int = HIGH) -> DataFrame:
    """The best rows of other labels within each positive's window."""
    k = score.shape[1]

    def run(batches):
        block.prepare()
        best = [Best(len(block), most) for _ in range(k)]
        for _, own_ids, label, x, codes, norms in _pieces(batches):
            x = x.astype(np.int64)
            other = label[:, None] != block.label
            low, high = block.interval(codes, norms)
            for n in range(k):
                p = score[:, n]
                # bounds are taken in hundredths; a missing positive has an empty window
                least, top = np.where(p > NONE, low_pct * np.maximum(p, -(2**56)), 2**62), np.where(p > NONE, high_pct * np.maximum(p, -(2**56)), NONE)
                may = other & (100 * low <= top) & (100 * high >= least)
                if not may.any():
                    continue
                sure = may & (100 * high <= top) & (100 * low >= least)
                i, q = np.nonzero(may & (high >= _floor(best[n].least(), low, sure, most)))
                s = block.exact(x, i, q)
                inside = (100 * s >= least[q]) & (100 * s <= top[q])
                best[n].add(q[inside], s[inside], own_ids[i[inside]])
        for n in range(k):
            b = best[n].batch()
            window = b.column("window").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(window * k + n), *b.columns[1:], pa.array(block.vec_id[window]), pa.array(ids[window, n]), pa.array(score[window, n])], names=["window", "score", "vec_id", "anchor_id", "positive_id", "positive_score"])

    found = _ranked(index.mapInArrow(run, LISTS + ", anchor_id long, positive_id long, positive_score long"), most)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, vector) for the anchors whose id is divisible by ``every``."""
    spark = rows.sparkSession
    index, book = build_index(rows)
    anchors, n = (None, 0) if book is None else counted(index.filter(F.col("vec_id") % every == 0).drop("codes", "norms"), "negatives-anchors")
    blocks, parts = -(-n // ANCHORS), []
    for b in range(blocks):
        block = Anchors(anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow(), book)
        if len(block):
            parts.append(written(negatives(index, block, *positives(index, block)), "negatives"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives of each anchor's first five positives, over all rows."""
    return mine(mislabelled(eligible(embeddings(spark, sf_dir))))


ORACLE_SQL = """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
) WHERE rank <= 5
"""
