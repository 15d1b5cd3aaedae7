"""Occupancies of sites against plain loops over frames."""

from __future__ import annotations

from collections import Counter

import numpy as np

from mesolite.cell import Cell
from mesolite.operators.reference import wigner_seitz

SCHEMA = "frame int, idx long, position struct<x: double, y: double, z: double>, kind int"


def test_sites_of_several_frames(spark):
    rng = np.random.default_rng(1)
    cell = Cell(((8.0, 1.0, 0.0), (0.0, 7.0, 0.5), (0.0, 0.0, 9.0)), (0.5, 0.0, -1.0))
    place = lambda n: rng.random((n, 3)) @ cell.array.T + cell.origin
    sites, frames = place(40), {f: place(30 + 5 * f) for f in (0, 3, 7)}
    rows = [(f, k, tuple(map(float, p)), k % 2) for f, ps in frames.items() for k, p in enumerate(ps)]
    out, defects = wigner_seitz(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, k, tuple(map(float, p)), 0) for k, p in enumerate(sites)], SCHEMA).drop("kind"), cell, "kind")
    got = {(r.frame, r.idx): (r.occupancy, r.occupancy_by_type) for r in out.collect()}
    found = {r.frame: (r.vacancy_count, r.interstitial_count) for r in defects.collect()}
    for f, ps in frames.items():
        d = (ps[:, None] - sites) @ cell.inverse.T
        near = np.linalg.norm((d - np.round(d)) @ cell.array.T, axis=2)
        images = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]) @ cell.array.T
        near = np.min([np.linalg.norm(ps[:, None] - sites - s, axis=2) for s in images], axis=0).argmin(1)
        n, by = Counter(near.tolist()), Counter(zip(near.tolist(), (k % 2 for k in range(len(ps))), strict=True))
        for k in range(40):
            assert got[f, k] == (n[k], {t: by[k, t] for t in (0, 1) if by[k, t]} or None)
        assert found[f] == (sum(n[k] == 0 for k in range(40)), sum(v - 1 for v in n.values()))
    assert len(got) == 120


def test_no_particles_and_one_site_for_all(spark):
    cell = Cell.box(5, 5, 5)
    site = spark.createDataFrame([(0, 9, (1.0, 1.0, 1.0))], "frame int, idx long, position struct<x: double, y: double, z: double>")
    rows = spark.createDataFrame([(f, k, (float(k), 2.0, 3.0), 0) for f in (0, 1) for k in range(4)], SCHEMA)
    out, defects = wigner_seitz(rows, site, cell)
    assert sorted((r.frame, r.occupancy) for r in out.collect()) == [(0, 4), (1, 4)]
    assert sorted(map(tuple, defects.collect())) == [(0, 0, 3), (1, 0, 3)]
    assert [t.count() for t in wigner_seitz(rows.limit(0), site, cell)] == [0, 0]
