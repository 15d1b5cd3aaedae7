"""Operator 4: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are put in a fixed random order (the MD5 of id and seed)
and dealt into ``16 ** HEX`` blocks by the leading digits of that key.  A
source whose target is ``k`` whole passes and a rest takes every block ``k``
times and, of one more pass, the leading blocks up to the rest; in the last of
these the documents are taken in order and the last one in part, so that the
words taken equal the rounded target.

The numbers of drawn blocks are exact quotas.  A tree over the output shards
splits them: each node shares its blocks among its children by multivariate
hypergeometric draws, so each shard holds an exact number of blocks of each
source, and the mixture is that of a full shuffle of all blocks.  Each shard
takes the next of a source's blocks in their permuted order (disjoint) and
shuffles its own rows.

Defined cases: null text has size 0; a null source is a source of its own, the
last in order; a null id sorts as empty text; rows with one id are ordered by
size; a source without words takes nothing; a text of any length is one
document and its cut may lie anywhere in it; columns called like an output are
not read (``mix`` replaces ``shard``, ``pass`` and ``words``).  Nothing depends
on partitioning, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.llm._spark import documents, written

HEX = 3
BLOCKS = 16**HEX
SHARDS = 64
FAN = 8
MOST_SOURCES_TO_BROADCAST = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def weights_123(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, in the sources' code point order, null last."""
    return sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``target`` by weight, none above ``most`` times its source's size, the excess reshared by weight.

    ``sources`` holds one row per source (source, source_size, weight).  With
    the sources in the order in which their caps are met, the level after the
    first j caps is what is left over what weight is left; it rises while caps
    are met and falls after, so the final level is the highest.
    """
    in_order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = sources.withColumn("level", left / weight)
    levels = levels.withColumn("level", F.max("level").over(every))
    return levels.withColumn("target", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).cast("double")).drop("level")


def _split(node: int, children: int, seed: int, source: np.ndarray, blocks: np.ndarray) -> pd.DataFrame:
    """Shares ``blocks`` of each source among ``children`` nodes of as equal size as can be."""
    rng = np.random.Generator(np.random.PCG64([seed, node]))
    rest, out = blocks.astype(np.int64).copy(), []
    for c in range(children):
        take = int(rest.sum()) // (children - c)
        drawn = rng.multivariate_hypergeometric(rest, take, method="marginals") if c < children - 1 else rest.copy()
        rest = rest - drawn
        out.append(pd.DataFrame({"source": source, "node": node * FAN + c, "blocks": drawn}))
    return pd.concat(out)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """(source, node = shard, blocks) from (source, blocks): one level of the tree is one grouped job over the nodes."""
    depth = round(np.log(shards) / np.log(FAN))
    if FAN**depth != shards:
        raise ValueError(f"shards must be a power of {FAN}")

    def at(level_no: int):
        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("source", na_position="last")
            return _split(int(pdf["node"].iloc[0]), FAN, seed + level_no, pdf["source"].to_numpy(dtype=object), pdf["blocks"].to_numpy())

        return split

    level = quotas.select("source", F.lit(0).cast("long").alias("node"), F.col("blocks").cast("long"))
    for k in range(depth):
        level = level.groupBy("node").applyInPandas(at(k), "source string, node long, blocks long")
    return level


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, shards: int = SHARDS, weigh=weights_123, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: its id, source, size, source_size, target, taken and ``copies`` (pass, words, shard).

    ``carry`` names columns of ``docs`` that come along (not id and source).
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    lazy = docs.select(
        *carry, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")
    ).withColumn("block", F.conv(F.substring("key", 1, HEX), 16, 10).cast("int"))
    sized = written(lazy.drop(*carry), "mixing-sizes")
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))), "mixing-blocks")

    sources = targets(weigh(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    some = F.col("source_size") > 0
    sources = sources.withColumn("passes", F.when(some, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("int"))
    sources = sources.withColumn("rest", F.when(some, whole - F.col("passes") * F.col("source_size")).otherwise(F.lit(0)).cast("long"))
    # the block in which the rest ends
    edge = (
        blocks.join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min("block").alias("edge"), F.min_by("before", "block").alias("edge_before"))
    )
    sources = sources.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    sources = sources.withColumns({"edge": F.coalesce("edge", F.lit(-1)), "edge_before": F.coalesce("edge_before", F.lit(0))})
    sources = written(sources, "mixing-sources")

    shares = splitting_tree(sources.select("source", (F.col("passes") * BLOCKS + F.col("edge") + 1).alias("blocks")), shards, seed)
    shares = shares.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("node", "blocks"))).alias("shares"))
    ends = F.expr("slice(aggregate(shares, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.blocks))), 2, size(shares))")
    sources = written(sources.join(shares.select("s", ends.alias("ends")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mixing-plan")
    few = sources.count() <= MOST_SOURCES_TO_BROADCAST

    params = sources.withColumnRenamed("source", "s")
    joined = (lazy if carry else sized).join(F.broadcast(params) if few else params, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_edge = joined.filter(F.col("block") == F.col("edge"))
    upto = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    clipped = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("edge_before") - F.coalesce(F.sum("size").over(upto), F.lit(0))))
    at_edge = at_edge.withColumn("extra", clipped.cast("long"))
    others = joined.filter(F.col("block") != F.col("edge")).withColumn("extra", F.when(F.col("block") < F.col("edge"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    shard = lambda p: f"size(filter(ends, e -> e <= {p} * {BLOCKS}L + block))"
    copies = F.expr(
        f"concat(transform(if(passes > 0, sequence(0, passes - 1), cast(array() AS array<int>)), p -> struct(p AS pass, size AS words, {shard('p')} AS shard)),"
        f" if(extra > 0, array(struct(passes AS pass, extra AS words, {shard('passes')} AS shard)), cast(array() AS array<struct<pass: int, words: bigint, shard: int>>)))"
    )
    rows = others.unionByName(at_edge).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")).withColumn("copies", copies)
    return rows.select(*carry, "doc_id", "source", "key", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, shards: int = SHARDS) -> DataFrame:
    """The mixture itself: one row per drawn copy, the columns of ``docs`` and (shard, pass, words), shuffled within each shard.

    The text of a copy that is taken in part is cut after its last taken word.
    The rows come along, so ids need not be unique.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id__"), F.col(source_col).alias("source__"), F.col(text_col).cast("string").alias("text"))
    drawn = plan(whole, "id__", "text", "source__", seed, shards, carry=("doc", "text")).select("doc", "text", "key", "size", F.explode("copies").alias("c"))
    word = "'" + WORD.replace("\\", "\\\\") + "'"
    cut = F.expr(f"if(c.words < size, array_join(zip_with(slice(split(text, {word}, -1), 1, int(c.words)), slice(regexp_extract_all(text, {word}, 0), 1, int(c.words)), (g, w) -> concat(g, w)), ''), text)")
    named = {"shard": F.col("c.shard"), "pass": F.col("c.pass"), "words": F.col("c.words")}
    kept = [(cut if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns if c not in named]
    out = drawn.select(*kept, *(v.alias(k) for k, v in named.items()), F.md5(F.concat("key", F.col("c.pass").cast("string")).cast("binary")).alias("k__"))
    return out.repartition("shard", F.substring("k__", 1, 2)).sortWithinPartitions("shard", "k__").drop("k__")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, with each document's copies as pass:shard:words; the splitting tree gives their shards."""
    copies = F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["pass"], c["shard"], c["words"])), ",")
    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", copies.alias("copies"))


#: All columns but ``copies``, whose shards are drawn; the tests hold them against the tree.
ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(cast(doc_id AS VARCHAR), '') || ':1') AS key FROM documents
), src AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM doc GROUP BY source
), lev AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
  FROM src WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tgt AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(lev) OVER () * weight) AS target FROM lev
), cum AS (
  SELECT doc.*, source_size, target, cast(floor(target + 0.5) AS BIGINT) AS want,
         coalesce(sum(size) OVER (PARTITION BY doc.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM doc JOIN tgt ON doc.source IS NOT DISTINCT FROM tgt.source
)
SELECT doc_id, size, source_size, target,
       cast(CASE WHEN source_size = 0 THEN 0 ELSE (want // source_size) * size + least(size, greatest(0, want % source_size - before)) END AS BIGINT) AS taken
FROM cum
"""
