"""Alpha shapes against a search over all tetrahedra and bodies of known size."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import mesh as M
from mesolite.operators.alpha import FACET, INNER, TETRAHEDRON, AlphaShape, alpha_complex

SCHEMA = "frame int, idx long, position struct<x: double, y: double, z: double>, selection int"


def points(spark, places, frame=0):
    return spark.createDataFrame([(frame, k, tuple(map(float, p)), int(k % 5 > 0)) for k, p in enumerate(places)], SCHEMA)


def solids(p, radius):
    """Every four points whose sphere is empty and below the radius."""
    out = []
    for t in itertools.combinations(range(len(p)), 4):
        a = p[list(t[1:])] - p[t[0]]
        if abs(np.linalg.det(a)) < 1e-12:
            continue
        c = np.linalg.solve(2 * a, (a * a).sum(1))
        r = np.linalg.norm(c)
        others = np.delete(p, t, 0)
        if r < radius and (np.linalg.norm(others - p[t[0]] - c, axis=1) > r).all():
            out.append(t)
    return out


@pytest.mark.parametrize("radius", [0.9, 1.3, 4.0])
def test_all_tetrahedra_of_scattered_points(spark, radius):
    rng = np.random.default_rng(1)
    p = rng.random((34, 3)) * 4
    cell = Cell.box(4, 4, 4, (False,) * 3)
    rows = alpha_complex(points(spark, p), cell, radius).collect()
    want = solids(p, radius)
    tets = [r for r in rows if r.kind == TETRAHEDRON]
    assert len(tets) == len(want) and sum(r.volume for r in tets) == pytest.approx(sum(abs(np.linalg.det(p[list(t[1:])] - p[t[0]])) / 6 for t in want), rel=1e-6)
    sides = Counter(frozenset(f) for t in want for f in itertools.combinations(t, 3))
    assert sorted(sorted((r.a, r.b, r.c)) for r in rows if r.kind == FACET) == sorted(sorted(f) for f, n in sides.items() if n == 1)
    assert sum(r.kind == INNER for r in rows) == sum(n == 2 for n in sides.values())
    if radius == 4.0:
        shape = AlphaShape(points(spark, p), cell, radius)
        assert M.open_edges(shape.faces(0)).count() == 0
        assert M.enclosed_volume(shape.faces(0)).first().volume == pytest.approx(shape.totals(0).first().solid_volume, rel=1e-6)


def lattice(n, a=4.0):
    base = np.array([(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)])
    return np.array([(np.array(c) + b) * a for c in itertools.product(range(n), repeat=3) for b in base])


def test_a_periodic_lattice_is_solid_and_a_void_has_a_surface(spark):
    p, cell = lattice(4), Cell.box(16, 16, 16)
    whole = AlphaShape(points(spark, p), cell, 3.0)
    t = whole.totals().first()
    assert (t.surface_area, t.solid_volume, t.solid_fraction) == (0.0, pytest.approx(4096, rel=1e-6), pytest.approx(1, rel=1e-6))
    d = p - (8, 8, 8)
    left = p[np.linalg.norm(d, axis=1) > 5.0]
    void = AlphaShape(points(spark, left), cell, 3.0)
    faces = void.faces(0).cache()
    assert M.open_edges(faces).count() == 0 and M.shells(faces).select("shell").distinct().count() == 1
    t = void.totals(0).first()
    assert t.empty_volume == pytest.approx(-M.enclosed_volume(faces).first().volume, rel=1e-6)
    # the hole is at least the ball and at most the ball grown by a neighbour distance
    assert 4 / 3 * np.pi * 4.3**3 < t.empty_volume < 4 / 3 * np.pi * 7.0**3
    assert t.surface_area > 0.8 * (36 * np.pi * t.empty_volume**2) ** (1 / 3)
    corner = void.select_surface().filter("selection = 1")
    rim = np.array([tuple(r.position) for r in corner.collect()])
    assert np.linalg.norm(rim - 8, axis=1).max() < 8.0
    soft = void.totals(8).first()
    assert soft.surface_area < t.surface_area and soft.solid_volume == t.solid_volume


def test_two_bodies_across_a_boundary(spark):
    p = lattice(6)
    one, two = p[np.linalg.norm(p - (10, 12, 12), axis=1) < 6], p[np.linalg.norm(p - (10, 12, 12), axis=1) < 7.5] + (18, 0, 0)
    cell = Cell(((34.0, 3.0, 0.0), (0.0, 30.0, 0.0), (0.0, 0.0, 30.0)), (0.0, 0.0, 0.0))
    both = np.concatenate([one, two]) + (6.0, 9.0, 11.0)  # the second body leaves the cell
    shape = AlphaShape(points(spark, both), cell, 3.2)
    regions = shape.regions(0).orderBy("volume").collect()
    assert len(regions) == 2 and M.open_edges(shape.faces(0)).count() == 0
    alone = [AlphaShape(points(spark, x), Cell.box(60, 60, 60, (False,) * 3), 3.2).totals(0).first() for x in (one, two)]
    assert [r.volume for r in regions] == pytest.approx([a.solid_volume for a in alone], rel=1e-6)
    assert [r.surface_area for r in regions] == pytest.approx([a.surface_area for a in alone], rel=1e-6)


def test_few_points_one_place_selection_and_frames(spark):
    cell = Cell.box(20, 20, 20)
    for places in (np.zeros((0, 3)), np.ones((3, 3)), np.array([[1.0, 1, 1], [2, 1, 1], [1, 2, 1], [1, 1, 2]]), np.array([[1.0, 1, 1]] * 6)):
        shape = AlphaShape(points(spark, places), cell, 2.0)
        t = shape.totals().collect()
        assert len(t) == (1 if len(places) else 0)
        if len(places) == 4:
            assert t[0].solid_volume == pytest.approx(1 / 6) and shape.faces(0).count() == 4
    p = lattice(3)
    two = points(spark, p).unionByName(points(spark, p + 0.3, 1))
    rows = AlphaShape(two, Cell.box(12, 12, 12), 3.0, only_selected=True).totals(0).orderBy("frame").collect()
    assert [r.frame for r in rows] == [0, 1] and rows[0].solid_volume == pytest.approx(rows[1].solid_volume, rel=1e-6)
    with pytest.raises(ValueError):
        alpha_complex(two, Cell.box(1, 1, 1, is2d=True))


def test_small_periodic_cells_count_images(spark):
    """A cell smaller than the probe: the complex is that of the cell repeated, per cell."""
    rng = np.random.default_rng(5)
    p = rng.random((9, 3)) * 2
    small = alpha_complex(points(spark, p), Cell.box(2, 2, 2), 0.8).groupBy("kind").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).collect()
    big = np.concatenate([p + np.array(s) * 2 for s in itertools.product(range(3), repeat=3)])
    large = alpha_complex(points(spark, big), Cell.box(6, 6, 6), 0.8).groupBy("kind").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).collect()
    assert {r.kind: 27 * r.n for r in small} == {r.kind: r.n for r in large}
    assert 27 * sum(r.v for r in small) == pytest.approx(sum(r.v for r in large), rel=1e-6)
