"""Coordination polyhedra against hulls found by trying every triangle."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.operators import hulls as H
from mesolite.operators.neighbors import neighbors
from tests.test_structure import crystal


def plain_hull(p):
    out = set()
    for t in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        s = np.delete((p - p[t[0]]) @ n, t)
        if (s < 0).all() or (s > 0).all():
            out.add(t)
    return out


def test_hulls_of_scattered_points():
    rng = np.random.default_rng(2)
    sizes = [4, 7, 13, 30, 3, 0, 5]
    sets = [rng.normal(size=(n, 3)) for n in sizes]
    sets[4] = rng.normal(size=(3, 3))
    sets[6] = np.column_stack([rng.normal(size=(5, 2)), np.zeros(5)])  # flat
    row = np.repeat(np.arange(7), [len(s) for s in sets])
    points = np.concatenate(sets)
    which, three = H.hull_triangles(row, points, 7)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k, p in enumerate(sets):
        got = {tuple(sorted(t - first[k])) for t in three[which == k]}
        assert got == (plain_hull(p) if k not in (4, 5, 6) else set())
        for t in three[which == k]:
            a, b, c = points[t]
            assert np.cross(b - a, c - a) @ (a - p.mean(0)) > 0


@pytest.mark.parametrize(("kind", "cutoff", "volume"), [("fcc", 3.0, 5 * 2**0.5 / 3 * 8**1.5), ("bcc", 3.6, 64.0), ("sc", 4.1, 4 / 3 * 64), ("diamond", 1.8, 8 / 3)])
def test_polyhedra_of_crystals(spark, kind, cutoff, volume):
    df, cell = crystal(spark, kind, 3)
    df = df.withColumn("selection", (F.col("idx") % 2).cast("int"))
    faces = H.coordination_polyhedra(df, neighbors(df, cell, cutoff)).cache()
    table = H.polyhedron_table(faces).collect()
    assert {r.center for r in table} == {r.idx for r in df.filter("selection = 1").collect()}
    assert [r.volume for r in table] == pytest.approx([volume] * len(table), rel=1e-6)
    n = {"fcc": 12, "bcc": 8, "sc": 6, "diamond": 4}[kind]
    assert {r.faces for r in table} == {2 * n - 4}
    assert H.coordination_polyhedra(df.limit(0), neighbors(df, cell, cutoff)).count() == 0
    assert H.coordination_polyhedra(df, neighbors(df, cell, 0.5)).count() == 0
