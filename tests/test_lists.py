"""Neighbour lists from blocks against the joins on bins, across periodic faces, empty blocks and open walls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import lists as L
from mesolite.operators import neighbors as N
from mesolite.operators import templates as T

SCHEMA = "frame int, idx long, position struct<x: double, y: double, z: double>, kind long"
CELLS = {
    "open": Cell.box(30, 20, 10, pbc=(False, False, False)),
    "periodic": Cell.box(30, 20, 10),
    "tilted": Cell(((30.0, 4.0, 0.0), (0.0, 20.0, 3.0), (0.0, 0.0, 10.0)), (0.0, 0.0, 0.0), (True, True, False), False),
    "flat": Cell.box(30, 20, 10, is2d=True),
}


def scattered(spark, n=600):
    """Two frames, the second of few particles; a third of all in one corner, so blocks beside it are empty; some beyond the walls."""
    p = np.random.default_rng(5).uniform(-2, 1, (n, 3)) * 0.5 + np.random.default_rng(6).uniform(0, 1, (n, 3)) * np.where(np.arange(n) % 3 == 0, 3, 30)[:, None]
    return spark.createDataFrame([(int(k % 9 == 0), k, tuple(map(float, x)), k % 4) for k, x in enumerate(p)], SCHEMA)


@pytest.mark.parametrize("name", CELLS)
def test_same_pairs_as_the_join(spark, monkeypatch, name):
    monkeypatch.setattr(L, "HELD", 20)
    cell, df = CELLS[name], scattered(spark)
    got = L.neighbor_lists(df, cell, 2.5, keep=("kind",)).select("frame", F.col("idx").alias("i"), F.explode("near").alias("n"))
    got = got.select("frame", "i", "n.j", "n.ix", "n.iy", "n.iz", "n.dx", "n.dy", "n.dz", "n.d2", F.col("n.kind").alias("kind_j"))
    want = N.neighbors(df, cell, 2.5, keep=("kind",)).select("frame", "i", "j", *(F.col(f"image.{c}").alias(f"i{c}") for c in "xyz"), "dx", "dy", "dz", "d2", "kind_j")
    assert want.count() > 500 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", CELLS)
def test_same_nearest_as_the_join(spark, monkeypatch, name):
    monkeypatch.setattr(L, "HELD", 20)
    cell, df = CELLS[name], scattered(spark)
    got = L.nearest_lists(df, cell, 7).select("frame", F.col("idx").alias("i"), F.explode("near").alias("n")).select("frame", "i", "n.rank", "n.j", "n.ix", "n.iy", "n.iz", "n.d2")
    want = N.nearest(df, cell, 7).select("frame", "i", "rank", "j", *(F.col(f"image.{c}").alias(f"i{c}") for c in "xyz"), "d2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_rows_are_sent(spark):
    """Bins sent every particle 27 times; blocks send it to those it is near to."""
    df = spark.range(40_000).select(F.lit(0).alias("frame"), F.col("id").alias("idx"), F.struct(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6)) / 1e4).alias(c) for k, c in enumerate("xyz")]).alias("position"))
    cell, cutoff = Cell.box(100, 100, 100), 5.5
    assert L._sent(df, cell, cutoff, L._count(cell, cutoff, 0.04)).count() < 4 * df.count()


def test_sheets_are_matched_once():
    assert len(T._sheet_orders()) == 8  # 48 ways, of which the template's rotations map six to each other
