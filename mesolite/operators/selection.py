"""Selections (a 0/1 column), plane cuts and deletion with its cascade."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.functions.ieee import truth
from mesolite.operators.neighbors import at_places, nearest, neighbors, places
from mesolite.storage import written


def select_expression(df: DataFrame, expression: Column | str) -> DataFrame:
    """Selected where the expression isn't zero (NaN counts as selected, null doesn't)."""
    e = F.expr(expression) if isinstance(expression, str) else expression
    return df.withColumn("selection", F.coalesce(truth(e.cast("double")).cast("int"), F.lit(0)))


def selected_count(df: DataFrame) -> DataFrame:
    return df.groupBy("frame").agg(F.count_if(F.col("selection") != 0).alias("count"))


def select_type(df: DataFrame, column: str, types: list, names: dict[str, int] | None = None) -> DataFrame:
    """Rows of the given type ids or names; an unknown name is an error."""
    ids = []
    for t in types:
        if isinstance(t, str):
            if t not in (names or {}):
                raise ValueError(f"there is no type {t!r}")
            t = names[t]
        ids.append(int(t))
    return df.withColumn("selection", F.col(column).isin(ids).cast("int") if ids else F.lit(0))


def clear_selection(df: DataFrame) -> DataFrame:
    return df.drop("selection")


def invert_selection(df: DataFrame) -> DataFrame:
    old = F.coalesce("selection", F.lit(0)) if "selection" in df.columns else F.lit(0)
    return df.withColumn("selection", F.when(old != 0, 0).otherwise(1))


def manual_selection(df: DataFrame, ids: DataFrame, id_col: str = "particle_identifier") -> DataFrame:
    """Rows whose id is in the table ``ids``."""
    marks = ids.select(F.col(id_col).alias("m__")).distinct()
    return df.drop("selection").join(marks, F.col(id_col) == F.col("m__"), "left").withColumn("selection", F.col("m__").isNotNull().cast("int")).drop("m__")


def expand_selection(df: DataFrame, cell: Cell, mode: str = "cutoff", cutoff: float = 3.2, k: int = 1, iterations: int = 1, bonds: DataFrame | None = None) -> DataFrame:
    """Adds the neighbours of selected rows: within a cutoff, the k nearest (30 at most), or bonded."""
    if mode == "cutoff":
        # whatever is at a chosen place is within any distance of it, so places are chosen
        spots = written(places(df, F.max((F.col("selection") != 0).cast("int")).alias("selection")).filter("position IS NOT NULL"), "places")
        for _ in range(iterations):
            near = neighbors(spots.filter("selection = 1"), cell, cutoff, others=spots).select("frame", F.col("j").alias("idx")).distinct().withColumn("r__", F.lit(1))
            spots = written(spots.join(near, ["frame", "idx"], "left").select("frame", "position", "idx", "n", F.greatest("selection", F.coalesce("r__", F.lit(0))).alias("selection")), "places")
        reached = spots.filter("selection = 1").select("frame", "position", F.lit(1).alias("r__"))
        return at_places(df, reached).withColumn("selection", F.when((F.col("selection") != 0) | F.col("r__").isNotNull(), 1).otherwise(0)).drop("r__")
    if mode == "nearest":
        if not 1 <= k <= 30:
            raise ValueError("k must be between 1 and 30")
        links = nearest(df, cell, k).select("frame", "i", "j")
    else:
        links = bonds.select("frame", F.col("a").alias("i"), F.col("b").alias("j")).unionByName(bonds.select("frame", F.col("b").alias("i"), F.col("a").alias("j")))
    links = written(links.distinct(), "links") if iterations > 1 else links.distinct()
    for _ in range(iterations):
        chosen = df.filter(F.col("selection") != 0).select("frame", F.col("idx").alias("i"))
        reached = links.join(chosen, ["frame", "i"], "left_semi").select("frame", F.col("j").alias("idx")).distinct().withColumn("r__", F.lit(1))
        df = df.join(reached, ["frame", "idx"], "left").withColumn("selection", F.when((F.col("selection") != 0) | F.col("r__").isNotNull(), 1).otherwise(0)).drop("r__")
        if iterations > 1:
            df = written(df, "selection")
    return df


def select_range(df: DataFrame, *ranges: tuple[Column, float, float]) -> DataFrame:
    """Selected rows (all where there is no selection) whose values lie in all ranges, both ends included."""
    keep = F.col("selection") != 0 if "selection" in df.columns else F.lit(True)
    for value, lo, hi in ranges:
        keep = keep & value.between(min(lo, hi), max(lo, hi))
    return df.withColumn("selection", F.coalesce(keep, F.lit(False)).cast("int"))


def _cut(normal, distance: float, slab_width: float, inverse: bool) -> Column:
    """Whether a position is cut away."""
    x, y, z = map(float, normal)
    size = math.sqrt(x * x + y * y + z * z)
    x, y, z = (0.0, 0.0, 1.0) if size == 0 else (x / size, y / size, z / size)
    d = F.col("position.x") * x + F.col("position.y") * y + F.col("position.z") * z - float(distance)
    if slab_width > 0:
        inside = F.abs(d) <= slab_width / 2
        return inside if inverse else ~inside
    return d < 0 if inverse else d > 0


def slice_plane(df: DataFrame, normal=(1.0, 0.0, 0.0), distance: float = 0.0, slab_width: float = 0.0, inverse: bool = False, create_selection: bool = False, apply_to_selection: bool = False) -> DataFrame:
    """Removes (or selects) what lies on the plane's positive side, or outside a slab; ``inverse`` the other part."""
    cut = _cut(normal, distance, slab_width, inverse)
    if apply_to_selection:
        cut = cut & (F.col("selection") != 0)
    return df.withColumn("selection", cut.cast("int")) if create_selection else df.filter(~cut)


def delete_selected(df: DataFrame, topology: dict[str, tuple[DataFrame | Callable[[DataFrame], DataFrame], list[str]]] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Removes selected rows and the topology rows (bonds, angles, ...) with a removed or invalid member.

    Indices stay dense: a row's new index is its old one less the removed rows
    before it, summed over blocks of ``BLOCK`` indices, so no task sees a frame.
    Where topology follows from the particles alone, as bonds from distances, a
    function may stand for the table: it is asked for the rows among those left,
    by their new indices, and no row is joined.
    """
    topology = topology or {}
    kept = df.filter(F.col("selection") == 0).drop("selection")
    block = 1 << 16
    sizes = kept.groupBy("frame", F.floor(F.col("idx") / block).alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("frame").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("frame", "part").orderBy("idx")
    numbered = kept.withColumn("part", F.floor(F.col("idx") / block)).withColumn("r__", F.row_number().over(w)).join(before, ["frame", "part"])
    numbered = written(numbered.withColumn("new", (F.col("base") + F.col("r__") - 1).cast("long")).drop("part", "r__", "base"), "kept")
    names = numbered.select("frame", F.col("idx").alias("o__"), F.col("new").alias("n__"))
    left = numbered.withColumn("idx", F.col("new")).drop("new")
    out = {}
    for name, (table, members) in topology.items():
        if callable(table):
            out[name] = table(left)
            continue
        t = table
        for m in members:
            t = t.withColumnRenamed(m, "o__").join(names, ["frame", "o__"]).withColumnRenamed("n__", m).drop("o__")
        out[name] = t.select(table.columns)
    return left, out
