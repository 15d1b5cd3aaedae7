"""The corpus pipeline over ``documents``.

Each stage is written as Parquet and read again as the next one's documents.
All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm import decontamination, jaccard_join, language_id, mixing, secret_scan
from mesolite.llm._spark import documents, written


def _beside_text(docs: DataFrame) -> DataFrame:
    """(doc, text): all other columns as a struct, so that an operator's own columns can't replace one of them."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")


def _as_before(carried: DataFrame, columns: list[str]) -> DataFrame:
    return carried.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which no language fits, go; without any labelled row to learn from, no other does.

    A null or empty text has no letter.  Whole texts of any length are judged; repeated rows and
    equal ids are judged one by one.  All columns keep their values, whatever they are called.
    """
    machines = language_id.learn(docs)
    if not machines:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(_beside_text(docs), machines).filter(F.col("lang_pred") != language_id.UND)
    return _as_before(found, docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays (a null id is the last); an id may stand in several rows.

    Null and empty texts link with nothing and stay; of repeated rows one stays; whole texts of any
    length are compared.  All columns keep their values, whatever they are called.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    found = jaccard_join.jaccard_components(rows.select("row", F.col("doc.text").alias("text")), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    kept = rows.select("row", order.alias("order")).join(found, "row").groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias("row"))
    # as many rows are kept as there are groups, so both sides are shuffled at every size
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts have no words and stay; whole texts of any length are searched; repeated
    rows are judged one by one.  All columns keep their values, whatever they are called.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_before(decontamination.decontaminate(_beside_text(docs), benchmark).filter(~F.col("contaminated")), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base matches and live owned values of the whole input's scan are masked in the text; no document goes.

    Null and empty texts stay as they are; texts of any length are scanned; repeated rows are masked
    alike.  All other columns keep their values, whatever they are called.
    """
    return secret_scan.mask_found(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row for each drawn copy, with its output shard, pass and words (columns of these names are replaced).

    Null and empty texts have no words and are never drawn; a long text may be drawn in part; rows
    that tie in id and size are alike to the draw.
    """
    return mixing.mix(docs)


def plan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it and the output shards of its copies."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source", "key", "size", "source_size", "target", "taken", "copies"))
    return mixing.plan(docs, carry=rest).drop("key")


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: Language identification and the word-set join are not expressed in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def _through(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in stages:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query ``pipeline``: all stages applied to ``documents``, to the drawn copies."""
    return _through(spark, sf_dir, STAGES)


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the mixture over the cleaned documents, one row for each, which op4's SQL can be held against."""
    return _through(spark, sf_dir, [*STAGES[:-1], ("plan", plan_stage)])
