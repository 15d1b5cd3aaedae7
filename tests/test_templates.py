"""Template matching against a search without hulls, known crystals, known alloys."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import neighbors
from mesolite.operators import templates as T
from mesolite.plans.tables import LATTICES, crystals
from tests.test_structure import crystal

KINDS = tuple(T.SIZES)


def turned(rng, n):
    q = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
    return q * np.linalg.det(q)[:, None, None]


def surroundings(rng, kind, n, noise, size=2.5):
    p = T.template(kind).points
    turn = turned(rng, n)
    v = (np.einsum("bij,nj->bni", turn, p) + rng.normal(size=(n, len(p), 3)) * noise) * size
    order = np.linalg.norm(v, axis=2).argsort(1)
    out = np.zeros((n, 16, 3))
    out[:, : len(p)] = np.take_along_axis(v, order[:, :, None], 1)
    return out, turn


def least_rmsd(points, ideal):
    """Without hulls: turns that take two template points to two neighbours, nearest partners, Kabsch with scale."""
    best, n = np.inf, len(ideal)
    frame = lambda u, v: np.stack([u / np.linalg.norm(u), (w := np.cross(u, v)) / np.linalg.norm(w), np.cross(u, w) / np.linalg.norm(np.cross(u, w))], 1)
    size = np.linalg.norm(points, axis=1).mean()
    for a, b in itertools.permutations(range(n), 2):
        other = next(k for k in range(1, n) if np.linalg.norm(np.cross(ideal[0], ideal[k])) > 0.3)
        if np.linalg.norm(np.cross(points[a], points[b])) < 0.1 * size**2:
            continue
        turn = frame(points[a], points[b]) @ frame(ideal[0], ideal[other]).T
        pick = np.linalg.norm((ideal @ turn.T)[:, None] - points / size, axis=2).argmin(1)
        if len(set(pick.tolist())) == n:
            x, w = np.vstack([np.zeros(3), points[pick]]), np.vstack([np.zeros(3), ideal])
            x = x - x.mean(0)
            u, s, v = np.linalg.svd(w.T @ x)
            total = s[0] + s[1] + s[2] * np.sign(np.linalg.det(u @ v))
            best = min(best, np.sqrt(max(0, (w * w).sum() - total**2 / (x * x).sum()) / len(w)))
    return best


@pytest.mark.parametrize("kind", KINDS)
def test_matches_are_those_of_a_search_without_hulls(kind):
    rng = np.random.default_rng(kind)
    points, _ = surroundings(rng, kind, 6, 0.04)
    n = T.SIZES[kind]
    m = T.match(points, np.full(6, n), KINDS)
    assert (m.kind == kind).all()
    assert m.rmsd == pytest.approx([least_rmsd(p[:n], T.template(kind).points) for p in points], abs=1e-7)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("noise", [0.0, 0.03, 0.05])
def test_labels_sizes_and_orientations_under_noise(kind, noise):
    rng = np.random.default_rng(3)
    points, turn = surroundings(rng, kind, 200, noise)
    m = T.match(points, np.full(200, T.SIZES[kind]), KINDS)
    T._least_turn(m)
    assert (m.kind == kind).mean() >= 0.995 and np.abs(1 / m.scale - 2.5).max() < max(1e-6, 4 * noise)
    t = T.template(kind)
    # the true turn times one of the template's rotations, and of those the one of least angle
    every = turn[:, None] @ t.rotations[None]
    angle = lambda r: np.arccos(np.clip((r.trace(axis1=-2, axis2=-1) - 1) / 2, -1, 1))
    own = T.matrices(m.q)
    near = angle(np.swapaxes(every, -1, -2) @ own[:, None])
    ok = m.kind == kind
    assert near.min(1)[ok].max() < max(1e-6, 3 * noise) and (angle(own)[ok] <= angle(every).min(1)[ok] + max(1e-6, 3 * noise)).all()
    for b in np.flatnonzero(ok)[:20]:
        placed = t.points @ own[b].T / m.scale[b]
        assert np.abs(points[b, m.pick[b, : len(placed)]] - placed).max() < max(1e-6, 6 * noise * 2.5)


def test_random_points_are_other():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 16, 3))
    points = np.take_along_axis(points, np.linalg.norm(points, axis=2).argsort(1)[:, :, None], 1)
    m = T.match(points, np.full(300, 16), KINDS)
    assert (m.rmsd > 0.1).all()
    few = T.match(points, np.full(300, 5), KINDS)
    assert (few.kind == T.OTHER).all()


@pytest.mark.parametrize(("kind", "label"), [("fcc", T.FCC), ("bcc", T.BCC), ("sc", T.SC), ("diamond", T.CUBIC_DIAMOND)])
def test_periodic_crystals(spark, kind, label):
    df, cell = crystal(spark, kind, 3)
    got = T.template_matching(df.withColumn("rmsd", F.lit("own")), cell, KINDS).collect()
    assert len(got) == df.count() and {(r.structure_type, r.ordering_type) for r in got} == {(label, T.NO_ORDER + T.PURE)}
    for r in got:
        # the tetrahedra of diamond's second sublattice are turned by a right angle
        w = 0.5**0.5 if kind == "diamond" and r.idx % 2 else 1
        assert r.rmsd < 1e-6 and r.orientation.w == pytest.approx(w, abs=1e-6) and (w < 1 or r.deformation == pytest.approx(np.eye(3).ravel(), abs=1e-6))
    first = {"fcc": 8**0.5, "bcc": 12**0.5, "sc": 4, "diamond": 3**0.5}[kind]
    assert {round(r.interatomic_distance, 6) for r in got} == {round(first, 6)}


def test_neighbours_in_template_order_point_where_the_template_does(spark):
    df, cell = crystal(spark, "fcc", 3)
    m = T.template_matching(df, cell)
    ordered = T.template_order(m)
    assert ordered.count() == 12 * df.count()
    near = neighbors.nearest(df, cell, 12).select("i", "j", "dx", "dy", "dz")
    both = ordered.join(near, ["i", "j"]).withColumn("off", sum(F.abs(F.col(f"t{c}") - F.col(f"d{c}") / 8**0.5) for c in "xyz"))
    assert both.count() == 12 * df.count() and both.agg(F.max("off")).first()[0] < 1e-6
    h = T.rmsd_histogram(m).collect()
    assert len(h) == 100 and sum(r["count"] for r in h) == df.count()


@pytest.mark.parametrize(("kind", "one", "want"), [("fcc", lambda i: i % 4 == 0, {T.L12_AU, T.L12_CU}), ("fcc", lambda i: i % 4 in (0, 1), {T.L10}), ("bcc", lambda i: i % 2 == 0, {T.B2}), ("diamond", lambda i: i % 2 == 0, {T.SIC}), ("fcc", lambda i: True, {T.PURE}), ("fcc", lambda i: i == 0, {T.PURE, T.NO_ORDER, T.L12_AU})])
def test_alloys(spark, kind, one, want):
    df, cell = crystal(spark, kind, 3)
    pick = F.col("idx").isin([i for i in range(df.count()) if one(i)])
    got = T.template_matching(df.withColumn("particle_type", F.when(pick, 1).otherwise(2)), cell, KINDS, type_col="particle_type")
    assert {r[0] for r in got.select("ordering_type").distinct().collect()} == want


def test_cutoff_empty_table_and_lone_particles(spark):
    df, cell = crystal(spark, "fcc", 3)
    shaken = df.withColumn("position", F.struct(*[(F.col(f"position.{c}") + (F.rand(d) - 0.5) * 0.5).alias(c) for d, c in enumerate("xyz")]))
    strict = T.template_matching(shaken, cell, rmsd_cutoff=0.03)
    assert strict.filter("structure_type = 0 AND rmsd > 0.03 AND orientation IS NULL").count() == strict.filter("structure_type = 0").count() > 0
    assert T.template_matching(shaken, cell, rmsd_cutoff=0).filter("structure_type = 1").count() > 100
    assert T.template_matching(df.limit(0), cell).count() == 0
    lone = T.template_matching(df.limit(2), Cell.box(50, 50, 50, (False, False, False))).collect()
    assert [(r.structure_type, r.rmsd) for r in lone] == [(T.OTHER, None)] * 2


def test_sites_inside_the_finite_crystals(spark):
    sf = "/root/testdata/sf0.01"
    df, box = crystals(spark, sf)
    got = T.template_matching(df, box, KINDS, type_col="particle_type")
    # inside are the sites with as many near ones as the lattice has
    inside = {"fcc": (T.FCC, 3.5, 12), "hcp": (T.HCP, 3.5, 12), "bcc": (T.BCC, 3.9, 14), "sc": (T.SC, 3.2, 6), "cubic_diamond": (T.CUBIC_DIAMOND, 4.2, 16), "hex_diamond": (T.HEX_DIAMOND, 4.15, 17), "graphene": (T.GRAPHENE, 2.7, 9)}
    near = neighbors.neighbors(df, box, 4.2).groupBy("frame", F.col("i").alias("idx")).agg(F.collect_list("d2").alias("d2"))
    rows = got.join(near, ["frame", "idx"]).select("frame", "structure_type", "d2").collect()
    for k, (name, *_) in enumerate(LATTICES):
        label, cutoff, n = inside[name]
        labels = [r.structure_type for r in rows if r.frame == k and sum(d <= cutoff**2 for d in r.d2) == n]
        # shaken sheets have third neighbours within the cutoff, which stand in for missing second ones at the rim
        assert len(labels) > 15 and sum(x == label for x in labels) >= (0.9 if name == "graphene" else 1) * len(labels), (name, labels)
