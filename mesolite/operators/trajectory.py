"""Operators along the time axis: unwrapping, smoothing, lines, averages and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesolite.cell import Cell, vec

ID = "particle_identifier"


def _jumps(df: DataFrame, cell: Cell, key: str) -> list[Column]:
    """Running sums of the crossings of periodic faces between consecutive frames, in cell vectors."""
    w = Window.partitionBy(key).orderBy("frame")
    r = cell.reduced(F.col("position"))
    out = []
    for d in range(3):
        if not cell.periodic[d]:
            out.append(F.lit(0.0))
            continue
        step = F.floor(F.lag(r[d]).over(w) - r[d] + 0.5)
        out.append(F.coalesce(step, F.lit(0)).cast("double"))
    return out


def unwrap(df: DataFrame, cell: Cell, key: str = ID) -> DataFrame:
    """Continuous trajectories: by ``periodic_image`` where there is one (it is used up), else by undoing jumps of more than half a cell."""
    if "periodic_image" in df.columns:
        s = cell.shift([F.col(f"periodic_image.{c}").cast("double") for c in "xyz"])
        return df.withColumn("position", vec(*[F.col(f"position.{c}") + s[d] for d, c in enumerate("xyz")])).drop("periodic_image")
    steps = df.withColumns({f"s{d}": c for d, c in enumerate(_jumps(df, cell, key))})
    upto = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({f"n{d}": F.sum(f"s{d}").over(upto) for d in range(3)})
    s = cell.shift([F.col(f"n{d}") for d in range(3)])
    return steps.withColumn("position", vec(*[F.col(f"position.{c}") + s[d] for d, c in enumerate("xyz")])).drop(*(f"{a}{d}" for a in "sn" for d in range(3)))


def smooth(df: DataFrame, cell: Cell, window: int = 3, key: str = ID, scalars: tuple[str, ...] = (), minimum_image: bool = True) -> DataFrame:
    """Positions (relative to the central frame by minimum image) and scalars averaged over ``window`` frames.

    Frames beyond the ends count as the end frame, so end frames repeat in the
    mean.  The frames are those of the whole table.
    """
    if window < 2:
        return df
    lo, hi = df.agg(F.min("frame"), F.max("frame")).first()
    if lo is None:
        return df
    offsets = F.array(*[F.lit(o) for o in range(-((window - 1) // 2), window // 2 + 1)])
    asked = df.select("frame", key, F.col("position").alias("p0"), F.explode(offsets).alias("o"))
    asked = asked.withColumn("f", F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("frame") + F.col("o"))))
    other = df.select(F.col("frame").alias("f"), key, F.col("position").alias("p"), *scalars)
    j = asked.join(other, ["f", key])
    if minimum_image and any(cell.periodic):
        j = j.withColumn("d", F.struct(*[(F.col(f"p.{c}") - F.col(f"p0.{c}")).alias(c) for c in "xyz"]))
        r = cell.reduced_vector(F.col("d"))
        s = cell.shift([F.floor(r[k] + 0.5).cast("double") if cell.periodic[k] else F.lit(0.0) for k in range(3)])
        j = j.withColumn("p", F.struct(*[(F.col(f"p0.{c}") + F.col(f"d.{c}") - s[k]).alias(c) for k, c in enumerate("xyz")]))
    got = j.groupBy("frame", key).agg(*[F.avg(f"p.{c}").alias(f"m{c}") for c in "xyz"], *[F.avg(x).alias(f"m_{x}") for x in scalars])
    out = df.join(got, ["frame", key]).withColumn("position", vec(F.col("mx"), F.col("my"), F.col("mz"))).withColumns({x: F.col(f"m_{x}") for x in scalars})
    return out.select(df.columns)


def interpolate(df: DataFrame, cell: Cell, time: float, key: str = ID, scalars: tuple[str, ...] = ()) -> DataFrame:
    """The state between two frames: linear in position (by minimum image) and scalars."""
    first = int(time // 1)
    part = float(time - first)
    a = df.filter(F.col("frame") == first)
    b = df.filter(F.col("frame") == first + 1).select(F.col(key), F.col("position").alias("q"), *[F.col(x).alias(f"q_{x}") for x in scalars])
    j = a.join(b, key, "left").withColumn("d", F.struct(*[(F.coalesce(F.col(f"q.{c}"), F.col(f"position.{c}")) - F.col(f"position.{c}")).alias(c) for c in "xyz"]))
    r = cell.reduced_vector(F.col("d"))
    s = cell.shift([F.floor(r[k] + 0.5).cast("double") if cell.periodic[k] else F.lit(0.0) for k in range(3)])
    j = j.withColumn("position", vec(*[F.col(f"position.{c}") + part * (F.col(f"d.{c}") - s[k]) for k, c in enumerate("xyz")]))
    j = j.withColumns({x: F.col(x) + part * (F.coalesce(f"q_{x}", x) - F.col(x)) for x in scalars})
    return j.select(df.columns)


def trajectory_lines(df: DataFrame, cell: Cell, every: int = 1, key: str = ID, unwrapped: bool = True, selected: DataFrame | None = None) -> DataFrame:
    """(particle, time, position) of each n-th frame, in order of particle and time, continuous across periodic faces."""
    rows = df.filter(F.col("frame") % every == 0)
    if selected is not None:
        rows = rows.join(selected.filter(F.col("selection") != 0).select(key).distinct(), key, "left_semi")
    rows = unwrap(rows.drop("periodic_image"), cell, key) if unwrapped else rows
    return rows.select(F.col(key).alias("particle"), F.col("frame").alias("time"), "position")


def time_average(df: DataFrame, columns: list[str], key: str | None = ID) -> DataFrame:
    """The mean of columns over all frames, for each row key (or of the whole table)."""
    means = [F.avg(c).alias(f"{c}_average") for c in columns]
    return df.groupBy(key).agg(*means) if key else df.agg(*means)


def time_series(attributes: DataFrame, keys: list[str], time_axis: str | None = None) -> DataFrame:
    """Attributes (frame, key, value) as one row for each frame; optionally with one of them as time axis."""
    out = attributes.groupBy("frame").pivot("key", keys).agg(F.first("value"))
    return out.withColumnRenamed(time_axis, "time") if time_axis else out.withColumn("time", F.col("frame"))


def keyframes(points: list[tuple[float, float]], column: Column, mode: str = "linear") -> Column:
    """An animated parameter as a function of the frame: constant steps or linear between keys."""
    points = sorted(points)
    out = F.lit(float(points[-1][1]))
    for (t0, v0), (t1, v1) in reversed(list(zip(points, points[1:], strict=False))):
        inside = F.lit(float(v0)) if mode == "constant" else F.lit(float(v0)) + (column - t0) * ((v1 - v0) / (t1 - t0))
        out = F.when(column < t1, inside).otherwise(out)
    return F.when(column < points[0][0], F.lit(float(points[0][1]))).otherwise(out)
