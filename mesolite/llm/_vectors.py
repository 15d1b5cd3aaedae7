"""Arrow columns of embeddings as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quantised components end here, so that an inner product of some hundred of them, times a hundred, fits a long.
MOST = 2**24


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; one that is stored in fewer parts than half the cores is dealt out, larger ones are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def finite(column: str) -> F.Column:
    """True for an array without a null, NaN or infinite component; false for a null array."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(column).cast("array<double>"), sound), F.lit(False))


def quantised(column: str, scale: int) -> F.Column:
    """floor(scale * x) of each component as an int, x as a double; what lies beyond ``MOST`` is ``MOST``."""
    grid = lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(grid(x)).cast("int"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A column of int lists, none longer than ``width``, as rows of ``width``; shorter ones end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out
