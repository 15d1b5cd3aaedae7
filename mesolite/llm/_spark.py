"""Session helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; where it names none, a temporary one in local mode only."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="mesolite-")
        sc.setCheckpointDir(known)
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, which the writing job itself counts."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more, so that they hold no disk while the job goes on."""
    for table in tables:
        spark = table.sparkSession
        conf = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def with_text(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with null columns of type string for those of ``needed`` that it lacks."""
    return df.withColumns({c: F.lit(None).cast("string") for c in needed if c not in df.columns})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; one that is stored in fewer parts than half the cores is dealt out, larger ones are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def crc_fold(column: str, modulus: int) -> F.Column:
    """crc32 of a column as text, modulo ``modulus`` (a null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
