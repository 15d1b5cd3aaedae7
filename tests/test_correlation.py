"""Grid correlations against numpy's transform of the whole grid."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators.correlation import grid_correlation, grid_shape

SCHEMA = "frame int, idx long, position struct<x: double, y: double, z: double>, a double, b double"


def points(spark, places, a, b, frame=0):
    return spark.createDataFrame([(frame, k, tuple(map(float, p)), float(u), float(v)) for k, (p, u, v) in enumerate(zip(places, a, b, strict=True))], SCHEMA)


def plain(places, a, b, cell, spacing, window, axis):
    shape = grid_shape(cell, spacing)
    grids = [np.zeros(shape) for _ in range(3)]
    for p, u, v in zip(places, a, b, strict=True):
        r = cell.inverse @ (p - cell.origin)
        i, w = [math.floor(r[d] * shape[d]) for d in range(3)], 1.0
        for d in range(3):
            if cell.pbc[d]:
                i[d] %= shape[d]
            elif window:
                w *= math.sqrt(2 / 3) * (1 - math.cos(2 * math.pi * r[d]))
        if all(0 <= i[d] < shape[d] for d in range(3)):
            for g, x in zip(grids, (u, v, 1.0), strict=True):
                g[tuple(i)] += w * (0 if math.isnan(x) else x)
    f = [np.fft.fftn(g) for g in grids]
    corr, dens = f[0] * f[1].conj(), f[2] * f[2].conj()
    real, rdf = (np.fft.ifftn(x).real * x.size for x in (corr, dens))
    across, n = min(cell.face_distances()), len(places)
    signed = lambda i, m: (i + m // 2) % m - m // 2
    cq, cr = {}, {}
    for i in itertools.product(*map(range, shape)):
        if axis is None:
            k = math.floor(np.linalg.norm(np.array([signed(i[d], shape[d]) for d in range(3)]) @ cell.inverse) * across)
            if any(i) and k < int(across / (2 * spacing)):
                cq.setdefault(k, []).append(corr[i].real)
        else:
            cq.setdefault(i[(axis + 2) % 3] + shape[(axis + 2) % 3] * i[(axis + 1) % 3], []).append(corr[i].real)
        bins = int(across / (2 * spacing))
        k = math.floor(np.linalg.norm(cell.array @ [signed(i[d], shape[d]) / shape[d] for d in range(3)]) / (across / (2 * bins)))
        if any(i) and k < bins:
            cr.setdefault(k, []).append((real[i], rdf[i]))
    return {k: (np.mean(v) * cell.volume / n**2, len(v)) for k, v in cq.items()}, {k: (*np.mean(v, 0) / n**2, len(v)) for k, v in cr.items()}


@pytest.mark.parametrize(("pbc", "window", "axis"), [((True, True, True), False, None), ((True, False, True), True, None), ((False, False, False), False, 0), ((True, True, True), False, 2)])
def test_against_the_whole_transform(spark, pbc, window, axis):
    rng = np.random.default_rng(3)
    cell = Cell(((12.0, 2.0, 0.0), (0.0, 10.0, 1.0), (0.0, 0.0, 15.0)), (1.0, -2.0, 0.5), pbc)
    places = (rng.random((300, 3)) * 1.1 - 0.05) @ cell.array.T + cell.origin
    a, b = rng.normal(size=300), rng.normal(size=300)
    a[5] = float("nan")
    q, r = grid_correlation(points(spark, places, a, b), cell, F.col("a"), F.col("b"), 1.3, window, axis)
    cq, cr = plain(places, a, b, cell, 1.3, window, axis)
    got = {x.bin: (x.correlation, x["count"]) for x in q.collect()}
    assert got.keys() == cq.keys() and all(got[k] == pytest.approx(cq[k], abs=1e-9) for k in cq)
    got = {x.bin: (x.correlation, x.rdf, x["count"]) for x in r.collect()}
    assert got.keys() == cr.keys() and all(got[k] == pytest.approx(cr[k], abs=1e-9) for k in cr)


def test_frames_apart_and_no_particles(spark):
    rng = np.random.default_rng(4)
    cell = Cell.box(9, 9, 9)
    one, two = rng.random((50, 3)) * 9, rng.random((70, 3)) * 9
    rows = points(spark, one, one[:, 0], one[:, 1]).unionByName(points(spark, two, two[:, 0], two[:, 1], 1))
    both = {(x.frame, x.bin): x.correlation for x in grid_correlation(rows, cell, F.col("a"), F.col("b"), 1.5)[0].collect()}
    alone = {(1, x.bin): x.correlation for x in grid_correlation(rows.filter("frame = 1"), cell, F.col("a"), F.col("b"), 1.5)[0].collect()}
    assert {k: v for k, v in both.items() if k[0] == 1} == pytest.approx(alone)
    assert all(t.count() == 0 for t in grid_correlation(rows.limit(0), cell, F.col("a"), F.col("b"), 1.5))
    wide = grid_correlation(rows, cell, F.col("a"), F.col("b"), 100.0)
    assert [t.count() for t in wide] == [0, 0]
