"""Grains of bicrystals and strains of crystals that were deformed by known gradients."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import grains as G
from mesolite.operators import templates as T
from mesolite.operators.neighbors import neighbors
from tests.test_structure import BASES

SCHEMA = "frame int, idx long, position struct<x: double, y: double, z: double>"
OPEN = (False, False, False)


def turn(axis, degrees):
    a = np.array(axis, float) / np.linalg.norm(axis)
    t = np.radians(degrees)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def lattice(kind, n, a):
    return np.array([(np.array(c) + b) * a for c in itertools.product(range(-n, n), repeat=3) for b in BASES[kind]])


def points(spark, places):
    return spark.createDataFrame([(0, k, tuple(map(float, p))) for k, p in enumerate(places)], SCHEMA)


@pytest.mark.parametrize("kind", [T.FCC, T.HCP])
def test_disorientation_is_the_least_over_the_group(spark, kind):
    rng = np.random.default_rng(1)
    p, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 60, 4)))
    rows = spark.createDataFrame([(k, tuple(map(float, a)), tuple(map(float, b))) for k, (a, b) in enumerate(zip(p, q, strict=True))], "k int, p struct<w: double, x: double, y: double, z: double>, q struct<w: double, x: double, y: double, z: double>")
    got = [r.d for r in rows.select("k", G.disorientation(F.col("p"), F.col("q"), F.lit(kind)).alias("d")).orderBy("k").collect()]
    every = T.product(q[:, None], G._group(kind)[None])
    want = np.degrees(2 * np.arccos(np.clip(np.abs(np.einsum("nki,ni->nk", every, p)).max(1), 0, 1)))
    assert len(G._group(kind)) == (24 if kind == T.FCC else 12) and got == pytest.approx(want.tolist(), abs=1e-4)


@pytest.fixture(scope="module")
def bicrystal(spark):
    """Two half balls of one lattice, one turned by 20 degrees, and a small third one."""
    rng = np.random.default_rng(2)
    p = lattice("fcc", 4, 4.0)
    one, two = p @ turn((1, 2, 3), 5).T, p @ turn((0, 0, 1), 25).T
    one, two = one[(np.linalg.norm(one, axis=1) < 13) & (one[:, 0] < -0.9)], two[(np.linalg.norm(two, axis=1) < 12.5) & (two[:, 0] > 0.9)]
    small = lattice("fcc", 2, 4.0) @ turn((1, 0, 0), 30).T
    small = small[np.linalg.norm(small, axis=1) < 6] + (0, 0, 24)
    places = np.concatenate([one, two, small]) + rng.normal(size=(len(one) + len(two) + len(small), 3)) * 0.03
    df = points(spark, places)
    cell = Cell.box(60, 60, 70, OPEN, origin=(-30, -30, -20))
    return df, cell, T.template_matching(df, cell).cache(), (len(one), len(two), len(small))


def test_grains_of_a_bicrystal(spark, bicrystal):
    df, cell, matched, (n1, n2, n3) = bicrystal
    plain = G.grain_segmentation(matched, 4.0, 20, adopt=False).cache()
    labels = {r.idx: r.grain for r in plain.collect()}
    crystal = {r.idx for r in matched.filter("structure_type = 1").collect()}
    where = lambda lo, hi: {labels[k] for k in range(lo, hi) if k in crystal}
    assert where(0, n1) <= {0, 1, 2} and len(where(0, n1) - {0}) == 1 and len(where(n1, n1 + n2) - {0}) == 1 and where(0, n1) - {0} != where(n1, n1 + n2) - {0}
    assert all(labels[k] == 0 for k in range(n1 + n2 + n3) if k not in crystal)
    table = {r.grain: r for r in G.grain_table(plain).collect()}
    for lo, hi, true in ((0, n1, turn((1, 2, 3), 5)), (n1, n1 + n2, turn((0, 0, 1), 25))):
        (g,) = where(lo, hi) - {0}
        o = table[g].orientation
        near = T.product(np.array([[o.w, o.x, o.y, o.z]])[:, None], G._group(T.FCC)[None])[0]
        off = np.degrees(2 * np.arccos(np.clip(np.abs(near @ T.quaternions(true[None])[0]).max(), 0, 1)))
        assert off < 0.3 and table[g].spread < 3 and table[g].structure_type == T.FCC
        assert table[g].size == sum(v == g for v in labels.values())


def test_small_grains_dissolve_and_orphans_are_adopted(spark, bicrystal):
    df, cell, matched, (n1, n2, n3) = bicrystal
    near = neighbors(df, cell, 3.5)
    adopted = {r.idx: r.grain for r in G.grain_segmentation(matched, 4.0, 60, near=near).collect()}
    assert {adopted[k] for k in range(n1 + n2)} == {1, 2}
    assert {adopted[k] for k in range(n1 + n2, n1 + n2 + n3)} == {0}  # too small, and out of reach
    strict = G.grain_segmentation(matched, 0.01, 60, adopt=False)  # shaken neighbours are never that alike
    assert {r.grain for r in strict.collect()} == {0}
    assert G.grain_segmentation(matched.limit(0), near=near).count() == 0


@pytest.mark.parametrize("push", [True, False])
@pytest.mark.parametrize(("kind", "label", "a"), [("fcc", T.FCC, 4.0), ("bcc", T.BCC, 3.0), ("diamond", T.CUBIC_DIAMOND, 5.4)])
def test_strain_of_a_deformed_crystal(spark, kind, label, a, push):
    f = turn((1, 1, 0), 8) @ (np.eye(3) + np.array([[0.02, 0.01, 0.0], [0.0, -0.01, 0.005], [0.0, 0.0, 0.015]]))
    p = lattice(kind, 2, a)
    df = points(spark, p @ f.T)
    cell = Cell.box(60, 60, 60, OPEN, origin=(-30, -30, -30))
    s = G.elastic_strain(T.template_matching(df, cell, tuple(T.SIZES)), label, a, push_forward=push).cache()
    rows = s.filter(F.col("structure_type") == label).collect()
    inverse = np.linalg.inv(f)
    want = (np.eye(3) - inverse.T @ inverse) / 2 if push else (f.T @ f - np.eye(3)) / 2
    assert len(rows) > 10
    for r in rows:
        assert r.volumetric_strain == pytest.approx(np.trace(want) / 3, abs=1e-9)
        own = np.array(r.elastic_deformation).reshape(3, 3)
        assert np.allclose(own @ own.T, f @ f.T, atol=1e-9)
        if push:
            assert [r.strain[c] for c in ("xx", "yy", "zz", "xy", "xz", "yz")] == pytest.approx([want[i, j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))], abs=1e-9)
    assert s.filter((F.col("structure_type") != label) & (F.col("volumetric_strain") != 0)).count() == 0


def test_strain_of_a_hexagonal_crystal_with_another_ratio(spark):
    ratio, a = 1.58, 2.9
    sites = np.array([(0, 0, 0), (0.5, 0.5, 0), (0.5, 5 / 6, 0.5), (0, 1 / 3, 0.5)])
    p = np.array([(np.array(c) + b) * (a, a * 3**0.5, a * ratio) for c in itertools.product(range(4), repeat=3) for b in sites])
    matched = T.template_matching(points(spark, p * 1.01), Cell.box(40, 40, 40, OPEN, origin=(-5, -5, -5)))
    got = G.elastic_strain(matched, T.HCP, a, ratio).filter("structure_type = 2").collect()
    assert len(got) > 20 and [r.volumetric_strain for r in got] == pytest.approx([(1 - 1.01**-2) / 2] * len(got), abs=1e-9)
