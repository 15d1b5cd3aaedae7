"""Operator 12: centroid clustering by weighted deduplication.

Vectors are quantised to whole numbers and identical ones become one row with
their multiplicity.  Lloyd's rounds run over these distinct vectors: each task
assigns its rows and adds up multiplicity times vector for each centroid in
whole numbers, Spark adds up the tasks' sums, and the new centroids are exact
floors.  The last assignment is joined back to the ids by the vector.

What passes through the driver are the centroids and their sums, whose size is
fixed by ``k`` and the number of components.  A vector that a third of all
rows share is one row after partial counts, and one key of the join back,
which Spark splits where it is skewed.

Defined cases: vectors that are null, of another length, or hold a null or a
component that isn't finite are left out; a null id is hashed as empty text;
rows that are repeated count as often as they stand there, and of starts with
one hash the smaller vector is the first; with fewer than ``k`` vectors there
are as many centroids as vectors; without any the result is empty.  Quantised
components beyond 2**24 count as 2**24.  Columns of other names are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm._spark import written
from mesolite.llm._vectors import embeddings, finite, matrix, quantised

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3


def keep(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the quantised vectors that take part."""
    whole = F.coalesce(F.size("embedding") == width, F.lit(False)) & finite("embedding")
    return vectors.filter(whole).select("vec_id", quantised("embedding", scale).alias("vector"))


def distinct_vectors(kept: DataFrame) -> DataFrame:
    """(vector, n): each vector once, with its multiplicity."""
    return written(kept.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")


def starts(kept: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("vector", key.alias("key")).orderBy("key", "vector").limit(k).collect()
    return np.array([r.vector for r in first], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the smaller number of equal ones, and the squared distance; exact."""
    # below 2**22, sums of some hundred products are whole numbers that a double holds
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 2**22
    a, c = (x.astype(np.float64), centroids.astype(np.float64)) if small else (x, centroids)
    d = (c * c).sum(1) - 2 * (a @ c.T)
    best = d.argmin(1)
    return best.astype(np.int32), (d[np.arange(len(x)), best] + (a * a).sum(1)).astype(np.int64)


def sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """For each centroid that has vectors: cluster, n, inertia and the componentwise sums ``s0``, ``s1``, ..."""
    k, width = centroids.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches):
        n, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x, w = matrix(b.column("vector"), width), b.column("n").to_numpy()
            best, d = nearest(x, centroids)
            np.add.at(n, best, w)
            np.add.at(inertia, best, w * d)
            np.add.at(total, best, w[:, None] * x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(inertia), *[pa.array(total[:, i]) for i in range(width)]], names=["cluster", "n", "inertia", *names])

    schema = "cluster int, n long, inertia long, " + ", ".join(f"{c} long" for c in names)
    rows = distinct.mapInArrow(run, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "inertia", *names)])
    return rows.filter("n > 0").collect()


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds over weighted distinct vectors."""
    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums(distinct, centroids):
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vector, cluster, distance) of each distinct vector."""

    def run(batches):
        for b in batches:
            best, d = nearest(matrix(b.column("vector"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vector"), pa.array(best), pa.array(d)], names=["vector", "cluster", "distance"])

    return distinct.select("vector").mapInArrow(run, "vector array<int>, cluster int, distance long")


def cluster(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """``kept`` (vec_id, vector) with cluster, distance, cluster_inertia, inertia and centroid (its final components)."""
    distinct = distinct_vectors(kept)
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return kept.limit(0).select("*", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("vector").alias("centroid"))
    centroids = lloyd(distinct, centroids, rounds)
    found = sums(distinct, centroids)
    total = sum(r.inertia for r in found)
    facts = kept.sparkSession.createDataFrame([(r.cluster, r.inertia, total, [int(x) for x in centroids[r.cluster]]) for r in found], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    # one row for each centroid: k of them at most
    with_facts = assigned(distinct, centroids).join(F.broadcast(facts), "cluster")
    return kept.join(with_facts, "vector").select("vec_id", "vector", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_weighted_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 16 centroids over all vectors, with the hash of each vector's final centroid."""
    return cluster(keep(embeddings(spark, sf_dir))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def digest(centroid) -> str:
    """The hash that the query gives for a centroid."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _oracle() -> str:
    assign = """near{r} AS (
  SELECT id, v, c, d FROM (
    SELECT kept.id, kept.v, t.c, list_dot_product(kept.v, kept.v) - 2 * list_dot_product(kept.v, t.v) + list_dot_product(t.v, t.v) AS d,
           row_number() OVER (PARTITION BY kept.id ORDER BY list_dot_product(t.v, t.v) - 2 * list_dot_product(kept.v, t.v), t.c) AS rank
    FROM kept, cent{r} t) WHERE rank = 1)"""
    move = """part{r} AS (
  SELECT c, i, floor(sum(v[i]) / count(*)) AS x FROM near{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
cent{s} AS (
  SELECT t.c, coalesce(m.v, t.v) AS v FROM cent{r} t LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM part{r} GROUP BY c) m ON t.c = m.c)"""
    ctes = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """cent0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT 16))""",
    ]
    for r in range(ROUNDS):
        ctes += [assign.format(r=r), move.format(r=r, s=r + 1)]
    ctes.append(assign.format(r=ROUNDS))
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT k.vec_id, n.c::INTEGER AS cluster, n.d::BIGINT AS distance, sum(n.d) OVER (PARTITION BY n.c)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(t.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN kept k ON n.id = k.id JOIN cent{ROUNDS} t ON n.c = t.c"""
    )


ORACLE_SQL = _oracle()
