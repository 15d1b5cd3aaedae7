"""Perfect crystals, whose structure is known."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators import aggregates, bonds, clusters, neighbors, reference, structure

BASES = {
    "sc": [(0, 0, 0)],
    "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)],
    "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)],
}
BASES["diamond"] = [(x + d, y + d, z + d) for x, y, z in BASES["fcc"] for d in (0, 0.25)]


def crystal(spark, kind: str, n: int = 4, a: float = 4.0):
    points = [(i + b[0], j + b[1], k + b[2]) for i, j, k in itertools.product(range(n), repeat=3) for b in BASES[kind]]
    rows = [(0, i, i, 1, tuple(float(a * c) for c in p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "frame int, idx long, particle_identifier long, particle_type int, position struct<x: double, y: double, z: double>"), Cell.box(n * a, n * a, n * a)


def kinds(df, column="structure_type"):
    return {r[0] for r in df.select(column).distinct().collect()}


@pytest.mark.parametrize(("kind", "label"), [("fcc", structure.FCC), ("bcc", structure.BCC)])
def test_common_neighbours(spark, kind, label):
    assert kinds(structure.common_neighbors(*crystal(spark, kind))) == {label}


def test_centrosymmetry_of_a_perfect_crystal_is_zero(spark):
    df, cell = crystal(spark, "fcc")
    assert structure.centrosymmetry(df, cell).agg(F.max("centrosymmetry")).first()[0] == pytest.approx(0, abs=1e-9)


def test_least_matching_is_that_of_all_matchings():
    rng = np.random.default_rng(3)
    w = rng.random((20, 6, 6))
    w = w + w.transpose(0, 2, 1)

    def least(m, left):
        return 0 if not left else min(m[left[0], j] + least(m, [x for x in left[1:] if x != j]) for j in left[1:])

    assert structure.least_matching(w) == pytest.approx([least(m, list(range(6))) for m in w])


def test_matching_mode_of_centrosymmetry(spark):
    df, cell = crystal(spark, "fcc")
    assert structure.centrosymmetry(df, cell, matching=True).agg(F.max("centrosymmetry")).first()[0] == pytest.approx(0, abs=1e-9)
    one = structure.centrosymmetry(df.filter("idx != 0"), cell, matching=True)
    plain = structure.centrosymmetry(df.filter("idx != 0"), cell).withColumnRenamed("centrosymmetry", "plain")
    both = one.join(plain.select("idx", "plain"), "idx")
    assert both.count() == 255 and both.filter("centrosymmetry < plain - 1e-9").count() == 0 and both.filter("centrosymmetry > 1").count() > 0
    with pytest.raises(ValueError):
        structure.centrosymmetry(df, cell, 18, matching=True)


@pytest.mark.parametrize(("kind", "cutoff", "label"), [("fcc", 3.4, structure.FCC), ("bcc", 4.8, structure.BCC)])
def test_common_neighbours_with_a_fixed_cutoff(spark, kind, cutoff, label):
    assert kinds(structure.common_neighbors(*crystal(spark, kind), "fixed", cutoff)) == {label}


def test_diamond(spark):
    assert kinds(structure.identify_diamond(*crystal(spark, "diamond", 3))) == {1}


@pytest.mark.parametrize(("kind", "cutoff", "n"), [("sc", 4.1, 6), ("bcc", 3.6, 8), ("fcc", 2.9, 12), ("fcc", 4.1, 18)])
def test_coordination(spark, kind, cutoff, n):
    df, cell = crystal(spark, kind)
    assert kinds(aggregates.coordination(df, cell, cutoff), "coordination") == {n}


def test_images_of_one_particle_in_a_small_cell(spark):
    df, cell = crystal(spark, "sc", 1)
    got = neighbors.neighbors(df, cell, 4.1)
    assert got.count() == 6 and got.select("image").distinct().count() == 6
    assert bonds.create_bonds(df, cell, 4.1).count() == 3


def test_clusters_across_a_boundary(spark):
    rows = [(0, k, (x, 5.0, 5.0)) for k, x in enumerate([0.5, 9.5, 5.0])]
    df = spark.createDataFrame(rows, "frame int, idx long, position struct<x: double, y: double, z: double>")
    got = clusters.cluster_analysis(df, Cell.box(10, 10, 10), 1.5).orderBy("idx").collect()
    assert [r.cluster for r in got] == [1, 1, 2]


@pytest.mark.parametrize(("kind", "label"), [("fcc", structure.FCC), ("bcc", structure.BCC)])
def test_bond_angles_of_perfect_crystals(spark, kind, label):
    assert kinds(structure.ackland_jones(*crystal(spark, kind))) == {label}


def test_strain_of_a_homogeneous_deformation(spark):
    before, cell = crystal(spark, "fcc", 3)
    f = (1.02, 1.0, 0.97)
    after = before.withColumn("position", F.struct(*[(F.col(f"position.{c}") * f[k]).alias(c) for k, c in enumerate("xyz")]))
    size = 12.0
    got = reference.atomic_strain(after, before, Cell.box(*(size * x for x in f)), cell, 3.0).collect()
    assert len(got) == 108 and all(r.valid for r in got)
    for r in got[:20]:
        g, e = r.deformation_gradient, r.strain_tensor
        assert (g.xx, g.yy, g.zz, g.xy, g.yx) == pytest.approx((*f, 0, 0), abs=1e-9)
        assert (e.xx, e.yy, e.zz) == pytest.approx([(x * x - 1) / 2 for x in f], abs=1e-9)
        assert r.d2min == pytest.approx(0, abs=1e-9) and r.volumetric_strain == pytest.approx(sum((x * x - 1) / 2 for x in f) / 3, abs=1e-9)
