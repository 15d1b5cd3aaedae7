"""Streams of frames: dump files that arrive in a folder, and trajectories unwrapped with state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.sources import dump


def dump_stream(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Atoms of dump files as they arrive; the same columns as in a batch read, without frame numbers."""
    return dump.atoms(dump.frames(spark, folder, stream=True), extra)


def step_counts(stream: DataFrame) -> DataFrame:
    """Atoms and mean position by timestep, for ``complete`` or ``update`` output."""
    return stream.groupBy("timestep").agg(F.count("*").alias("n"), F.avg("position.x").alias("mean_x"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Count, sum and mean by time window; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time_col, width)
    out = events.withWatermark(time_col, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"), F.avg(value_col).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "n", "total", "mean")


def unwrap_stream(stream: DataFrame, cell: Cell, key: str = "particle_identifier") -> DataFrame:
    """(key, frame, x, y, z): continuous positions; the state of a particle is its last position and its crossings.

    Frames of a particle have to arrive in order; those of one batch are sorted.
    """
    inverse, matrix, on = cell.inverse, cell.array, np.array(cell.periodic)

    def follow(name, batches, state):
        rows = pd.concat(list(batches)).sort_values("frame")
        p = rows[["x", "y", "z"]].to_numpy(float)
        last, n = state.get if state.exists else (p[0].tolist(), [0.0, 0.0, 0.0])
        r = np.vstack([last, p]) @ inverse.T
        step = np.where(on, np.floor(r[:-1] - r[1:] + 0.5), 0.0)
        total = np.asarray(n) + np.cumsum(step, axis=0)
        state.update((p[-1].tolist(), total[-1].tolist()))
        q = p + total @ matrix.T
        yield pd.DataFrame({key: name[0], "frame": rows["frame"].to_numpy(), "x": q[:, 0], "y": q[:, 1], "z": q[:, 2]})

    rows = stream.select(F.col(key).cast("long").alias(key), F.col("frame").cast("int").alias("frame"), *[F.col(f"position.{c}").alias(c) for c in "xyz"])
    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} long, frame int, x double, y double, z double", "last array<double>, n array<double>", "append", "NoTimeout")
