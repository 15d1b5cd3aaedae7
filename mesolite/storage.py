"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode only."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="mesolite-")
        sc.setCheckpointDir(known)
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: cuts the lineage of loops, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, which the writing job itself counts."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each frame by ``order``, which has to tell all rows of a frame apart.

    Rows are dealt out by ranges of the order; a row's number is that in its part
    plus the rows of the parts before, so no task holds a whole frame.
    """
    parts = written(df.repartitionByRange("frame", *order).withColumn("part__", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("frame", "part__").agg(F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.partitionBy("frame").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = parts.withColumn("own__", F.row_number().over(Window.partitionBy("frame", "part__").orderBy(*order)))
    joined = own.join(counts.select("frame", "part__", before.alias("before__")), ["frame", "part__"])
    return joined.withColumn(name, (F.col("before__") + F.col("own__")).cast("long")).drop("part__", "own__", "before__")
