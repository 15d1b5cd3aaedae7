"""Isosurfaces, meshes and distances from them against shapes of known area and volume."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import isosurface as I
from mesolite.operators import mesh as M

SKEW = Cell(((10.0, 2.0, 0.0), (0.0, 9.0, 1.0), (0.0, 0.0, 11.0)), (1.0, -1.0, 0.5))


def field(spark, cell, shape, f, centred=True):
    """``f`` of places (n, 3) at the grid's points."""
    at = np.array(list(itertools.product(*map(range, shape))))
    n = np.array([shape[d] if centred or cell.periodic[d] else max(shape[d] - 1, 1) for d in range(3)])
    value = f((at + 0.5 * centred) / n @ cell.array.T + cell.origin)
    return spark.createDataFrame([(0, *map(int, a), float(v), float(a[0])) for a, v in zip(at, value, strict=True)], "frame int, vx int, vy int, vz int, value double, other double")


def ball(cell, centre, radius):
    def f(p):
        d = (p - centre) @ cell.inverse.T
        d -= np.where(cell.pbc, np.round(d), 0)
        return radius - np.linalg.norm(d @ cell.array.T, axis=1)

    return f


def test_every_case_closes_and_points_outward():
    for case in range(256):
        for joined in range(64):
            t = I.triangles(case, joined)
            crossed = {k for k, (c, a) in enumerate(I.EDGES) if (case >> c & 1) != (case >> (c | 1 << a) & 1)}
            assert set(t.ravel()) == crossed
    # one corner inside: the normal points away from it
    for c in range(8):
        (e,) = I.triangles(1 << c, 0)
        p = [I.CORNERS[I.EDGES[k][0]] + 0.5 * np.eye(3)[I.EDGES[k][1]] for k in e]
        assert np.cross(p[1] - p[0], p[2] - p[0]) @ (p[0] - I.CORNERS[c]) > 0


@pytest.mark.parametrize("pbc", [(True, True, True), (False, True, False), (False, False, False)])
@pytest.mark.parametrize("centre", [(6.0, 4.0, 6.0), (1.5, -0.5, 1.0)])
def test_balls_in_a_skewed_cell(spark, pbc, centre, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    cell = Cell(SKEW.matrix, SKEW.origin, pbc)
    shape, f = (37, 40, 33), ball(cell, np.array(centre), 3.0)
    grid = field(spark, cell, shape, f)
    faces = I.isosurface(grid, cell, shape, 0.0, fields=("other",)).cache()
    assert M.open_edges(faces).count() == 0
    area, volume = M.surface_area(faces).first().area, I.volume_inside(grid, cell, shape, 0.0).first().volume
    whole = all(pbc) or centre[0] > 2
    if whole:
        assert area == pytest.approx(36 * np.pi, rel=0.01) and volume == pytest.approx(36 * np.pi, rel=0.01)
    rng = np.random.default_rng(0)
    reduced = rng.random((400_000, 3))
    # where the ball is cut off, the surface lies half a voxel inside the cell's face
    edge = np.where(pbc, 0, 0.5 / np.array(shape))
    inside = (f(reduced @ cell.array.T + cell.origin) > 0) & ((reduced > edge) & (reduced < 1 - edge)).all(1)
    assert volume == pytest.approx(inside.mean() * cell.volume, rel=0.02)
    if centre[0] > 2:
        assert M.enclosed_volume(faces).first().volume == pytest.approx(volume, rel=1e-9)
    v = M.vertices(faces, cell)
    off = [abs(np.linalg.norm(np.array(r.position) - centre) - 3) for r in v.collect()] if centre[0] > 2 else [0]
    assert max(off) < 0.02 and v.count() - _edges(faces) + faces.count() == 2
    values = np.array(faces.select("values").toPandas()["values"].tolist()) if whole else np.zeros((1, 3, 1))
    assert np.isfinite(values).all() and 0 <= values.min() and values.max() <= 36


def _edges(faces):
    return M._directed(faces).select("frame", F.least("u", "v"), F.greatest("u", "v")).distinct().count()


def test_random_fields_are_closed_and_their_volumes_agree(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 4)
    rng = np.random.default_rng(1)
    for pbc in ((False, False, False), (True, False, True)):
        cell, shape = Cell.box(9, 10, 11, pbc), (9, 10, 11)
        at = list(itertools.product(*map(range, shape)))
        values = rng.normal(size=len(at)).round(1)  # some at the level
        grid = spark.createDataFrame([(0, *a, float(v) if v < 2 else None) for a, v in zip(at, values, strict=True)], "frame int, vx int, vy int, vz int, value double")
        faces = I.isosurface(grid, cell, shape, 0.0).cache()
        assert faces.count() > 1000 and M.open_edges(faces).count() == 0
        volume = I.volume_inside(grid, cell, shape, 0.0).first().volume
        assert 0.2 * cell.volume < volume < 0.7 * cell.volume
        if not any(pbc):
            assert M.enclosed_volume(faces).first().volume == pytest.approx(volume, rel=1e-9)
        high = I.volume_inside(grid.withColumn("value", -F.col("value")), cell, shape, 1e-12).first().volume
        missing = (values >= 2).sum()
        if all(pbc):
            assert high + volume == pytest.approx(cell.volume - missing, rel=1e-6)


def test_smoothing_flattens_and_keeps_the_size(spark):
    cell, shape = Cell.box(10, 10, 10), (24, 24, 24)
    rng = np.random.default_rng(2)
    rough = ball(cell, np.array([1.0, 5.0, 9.5]), 3.0)
    grid = field(spark, cell, shape, lambda p: rough(p) + rng.normal(size=len(p)) * 0.08)
    faces = I.isosurface(grid, cell, shape, 0.0).cache()
    soft = M.smooth(faces, cell, 8).cache()
    off = lambda t: np.std([np.linalg.norm((np.array(r.position) - (1, 5, 9.5) + 5) % 10 - 5) for r in M.vertices(t, cell).collect()])
    assert soft.count() == faces.count() and M.open_edges(soft).count() == 0 and off(soft) < 0.8 * off(faces)
    assert M.surface_area(soft).first().area == pytest.approx(36 * np.pi, rel=0.05)
    assert M.smooth(faces, cell, 0) is faces


def test_smoothing_moves_as_the_plain_rule_does(spark):
    cell, shape = Cell.box(6, 6, 6, (False,) * 3), (7, 7, 7)
    faces = I.isosurface(field(spark, cell, shape, ball(cell, np.array([3.0, 3.0, 3.0]), 2.0)), cell, shape, 0.0).cache()
    p = {r.vertex: np.array(r.position) for r in M.vertices(faces, cell).collect()}
    near = {}
    for r in faces.collect():
        for x in (r.a, r.b, r.c):
            near.setdefault(x, set()).update({r.a, r.b, r.c} - {x})
    for _ in range(2):
        for f in (0.5, 1 / (0.1 - 2)):
            p = {k: v + f * (np.mean([p[j] for j in near[k]], 0) - v) for k, v in p.items()}
    got = {r.vertex: np.array(r.position) for r in M.vertices(M.smooth(faces, cell, 2), cell).collect()}
    assert max(np.abs(got[k] - p[k]).max() for k in p) < 1e-9


def test_shells_and_histogram(spark):
    cell, shape = Cell.box(20, 10, 10), (40, 20, 20)
    one, two = ball(cell, np.array([6.0, 5.0, 5.0]), 3.0), ball(cell, np.array([19.0, 5.0, 5.0]), 2.0)
    grid = field(spark, cell, shape, lambda p: np.maximum(one(p), two(p)))
    areas = sorted(r.area for r in M.surface_area(M.shells(I.isosurface(grid, cell, shape, 0.0)), "shell").collect())
    assert areas == pytest.approx([16 * np.pi, 36 * np.pi], rel=0.02)
    h = I.field_histogram(grid, bins=10).collect()
    assert sum(r["count"] for r in h) == 16000 and len(h) == 10
    assert I.isosurface(grid, cell, shape, 1e9).count() == 0 and I.isosurface(grid.limit(0), cell, shape, 0.0).count() == 0
    with pytest.raises(ValueError):
        I.isosurface(grid, Cell.box(1, 1, 1, is2d=True), shape, 0.0)


@pytest.mark.parametrize("pbc", [(True, True, True), (False, False, True)])
def test_distances_from_a_surface(spark, pbc):
    cell = Cell(SKEW.matrix, SKEW.origin, pbc)
    shape, centre = (14, 13, 15), np.array([6.0, 4.0, 6.0])
    faces = I.isosurface(field(spark, cell, shape, ball(cell, centre, 2.5)), cell, shape, 0.0).cache()
    rng = np.random.default_rng(4)
    places = (rng.random((60, 3)) * 1.4 - 0.2) @ cell.array.T + cell.origin
    points = spark.createDataFrame([(0, k, tuple(map(float, p)), "old") for k, p in enumerate(places)], "frame int, idx long, position struct<x: double, y: double, z: double>, surface_distance string")
    got = {r.idx: r.surface_distance for r in M.surface_distance(points, faces, cell).collect()}
    corners = np.array([[tuple(p) for p in r.corners] for r in faces.collect()])
    images = np.array(list(itertools.product(*[(-2, -1, 0, 1, 2) if p else (0,) for p in pbc]))) @ cell.array.T
    want = np.min([M.triangle_distances(np.repeat(places, len(corners), 0), *[np.tile(corners[:, k] + s, (60, 1)) for k in range(3)]).reshape(60, -1).min(1) for s in images], axis=0)
    assert [got[k] for k in range(60)] == pytest.approx(want.tolist(), abs=1e-9)
    assert M.surface_distance(points, faces.limit(0), cell).filter("surface_distance IS NULL").count() == 60


def test_point_and_triangle():
    a, b, c = np.array([[0.0, 0, 0]]), np.array([[1.0, 0, 0]]), np.array([[0.0, 1, 0]])
    d = lambda p: float(M.triangle_distances(np.array([p], float), a, b, c)[0])
    assert [d((0.2, 0.2, 3)), d((-1, 0.5, 0)), d((2, 0, 0)), d((1, 1, 0)), d((0.1, 0.1, 0))] == pytest.approx([3, 1, 1, 0.5**0.5, 0])
    assert float(M.triangle_distances(np.array([[3.0, 4, 0]]), a, a, a)[0]) == pytest.approx(5)
