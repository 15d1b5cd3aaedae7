"""Grains and elastic strain of crystals, from particles that template matching has labelled and oriented."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesolite.operators import templates as T
from mesolite.operators.clusters import components
from mesolite.storage import counted, ranked, written

CUBIC = (T.FCC, T.BCC, T.SC, T.CUBIC_DIAMOND)
HEXAGONAL = (T.HCP, T.HEX_DIAMOND, T.GRAPHENE)
#: Distance of the first shell for a lattice constant of one; hexagonal lattices have their basal constant.
FIRST_SHELL = {T.FCC: 0.5**0.5, T.BCC: 0.75**0.5, T.SC: 1.0, T.CUBIC_DIAMOND: 3**0.5 / 4, T.HCP: 1.0, T.HEX_DIAMOND: 6**0.5 / 4, T.GRAPHENE: 3**-0.5}
IDEAL_RATIO = (8 / 3) ** 0.5


def _quotient(p: Column, q: Column) -> dict[str, Column]:
    """Components of the rotation from p to q in p's frame."""
    w, x, y, z = (p[c] for c in "wxyz")
    t, u, v, s = (q[c] for c in "wxyz")
    return {"w": w * t + x * u + y * v + z * s, "x": w * u - x * t - y * s + z * v, "y": w * v + x * s - y * t - z * u, "z": w * s - x * v + y * u - z * t}


def disorientation(p: Column, q: Column, kind: Column) -> Column:
    """The least angle in degrees between two orientations of a structure, under its lattice's rotations (24 cubic, 12 hexagonal ones)."""
    r = _quotient(p, q)
    size = F.reverse(F.array_sort(F.array(*[F.abs(c) for c in r.values()])))
    cubic = F.greatest(size[0], (size[0] + size[1]) / math.sqrt(2), (size[0] + size[1] + size[2] + size[3]) / 2)
    steps = [(math.cos(k * math.pi / 6), math.sin(k * math.pi / 6)) for k in range(6)]
    hexagonal = F.greatest(*[F.abs(c * r[a] + s * r[b]) for a, b in (("w", "z"), ("x", "y")) for c, s in steps])
    most = F.when(kind.isin(*HEXAGONAL), hexagonal).when(kind.isin(*CUBIC), cubic).otherwise(F.abs(r["w"]))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), most)))


def lattice_links(matched: DataFrame) -> DataFrame:
    """(frame, i, j, disorientation, d): pairs i < j of template neighbours of one structure; d is the bond's length."""
    crystal = matched.filter(F.col("structure_type") > 0)
    own = crystal.select("frame", F.col("idx").alias("i"), F.col("structure_type").alias("kind"), F.col("orientation").alias("p"), F.explode("template_neighbors").alias("j"))
    pairs = own.select("frame", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).filter("i < j").distinct()
    end = lambda k, q: crystal.select("frame", F.col("idx").alias(k), F.col("structure_type").alias(f"kind_{k}"), F.col("orientation").alias(q))
    both = pairs.join(end("i", "p"), ["frame", "i"]).join(end("j", "q"), ["frame", "j"]).filter("kind_i = kind_j")
    return both.select("frame", "i", "j", disorientation(F.col("p"), F.col("q"), F.col("kind_i")).alias("disorientation"))


def grain_segmentation(matched: DataFrame, threshold: float = 4.0, min_size: int = 100, adopt: bool = True, near: DataFrame | None = None) -> DataFrame:
    """``matched`` with grain: 1, 2, ... by falling size (ties by lowest index), 0 for particles in none.

    Crystal neighbours whose disorientation is at most ``threshold`` degrees are in one
    grain, as where single-linkage merging in the order of disorientation stops at the
    threshold.  Grains of fewer than ``min_size`` particles are dissolved.  With ``adopt`` the
    particles left join the grain across their shortest bond of ``near`` (frame, i, j, d2: both
    senses), those next to a grain first, round after round; without ``near`` nothing is adopted.
    """
    links = lattice_links(matched).filter(F.col("disorientation") <= threshold)
    crystal = matched.filter(F.col("structure_type") > 0).select("frame", "idx")
    root = written(components(crystal, links), "grain-roots")
    sizes = root.groupBy("frame", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    numbered = ranked(sizes, [F.desc("n"), F.asc("root")], "grain")
    known = written(root.join(numbered, ["frame", "root"]).select("frame", "idx", "grain"), "grains")
    if adopt and near is not None:
        left = written(matched.select("frame", "idx").join(known, ["frame", "idx"], "left_anti"), "grain-left")
        bonds = written(near.select("frame", "i", "j", "d2").join(left.withColumnRenamed("idx", "i"), ["frame", "i"], "left_semi"), "grain-bonds")
        front, n = known, 1
        while n:
            # neighbours of earlier ones were adopted with the last front, so only the front has offers to make
            offers = bonds.join(front.select("frame", F.col("idx").alias("j"), "grain"), ["frame", "j"]).join(left.withColumnRenamed("idx", "i"), ["frame", "i"], "left_semi")
            front, n = counted(offers.groupBy("frame", F.col("i").alias("idx")).agg(F.min_by("grain", F.struct("d2", "j")).alias("grain")), "grain-adopted")
            known = known.unionByName(front)
            left = written(left.join(front, ["frame", "idx"], "left_anti"), "grain-left")
    return matched.drop("grain").join(known, ["frame", "idx"], "left").withColumn("grain", F.coalesce("grain", F.lit(0).cast("long")))


def _group(kind: int) -> np.ndarray:
    """Quaternions of the rotations of a structure's lattice."""
    if kind in CUBIC:
        return T.quaternions(T.template(T.SC).rotations)
    if kind in HEXAGONAL:
        steps = np.arange(6) * np.pi / 6
        zero = np.zeros(6)
        return np.concatenate([np.stack([np.cos(steps), zero, zero, np.sin(steps)], 1), np.stack([zero, np.cos(steps), np.sin(steps), zero], 1)])
    return np.array([[1.0, 0, 0, 0]])


def aligned(q: np.ndarray, reference: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of the equivalent orientations the one nearest to a reference; quaternions (n, 4) as w, x, y, z."""
    out = q.copy()
    for kind in np.unique(kinds):
        own = kinds == kind
        every = T.product(q[own][:, None], _group(int(kind))[None])
        along = np.einsum("nki,ni->nk", every, reference[own])
        best = np.abs(along).argmax(1)
        at = np.arange(int(own.sum()))
        out[own] = every[at, best] * np.sign(along[at, best])[:, None]
    return out


def grain_table(grained: DataFrame) -> DataFrame:
    """(frame, grain, structure_type, size, orientation, spread): each grain's commonest structure, mean orientation and root mean square angle from it in degrees.

    Orientations are first turned to equivalents near that of the grain's lowest
    particle; their mean is the main axis of the sum of outer products.
    """
    rows = grained.filter("grain > 0")
    crystal = rows.filter("structure_type > 0")
    counts = crystal.groupBy("frame", "grain", "structure_type").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("frame", "grain").agg(F.min_by("structure_type", F.struct((-F.col("n")).alias("m"), "structure_type")).alias("structure_type"))
    first = crystal.join(kinds, ["frame", "grain", "structure_type"]).groupBy("frame", "grain", "structure_type").agg(F.min_by("orientation", "idx").alias("first"))
    names = [f"m{a}{b}" for a in range(4) for b in range(a, 4)]

    def products(batches):
        for b in batches:
            q, r = (np.stack([b.column(f"{x}{c}").to_numpy() for c in "wxyz"], 1) for x in "qr")
            q = aligned(q, r, b.column("structure_type").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("frame"), b.column("grain"), *[pa.array(q[:, int(n[1])] * q[:, int(n[2])]) for n in names]], names=["frame", "grain", *names])

    def means(batches):
        for b in batches:
            m = np.zeros((b.num_rows, 4, 4))
            for n in names:
                m[:, int(n[1]), int(n[2])] = m[:, int(n[2]), int(n[1])] = b.column(n).to_numpy()
            value, vector = np.linalg.eigh(m / np.maximum(b.column("n").to_numpy(), 1)[:, None, None])
            q = vector[:, :, 3] * np.where(vector[:, :1, 3] < 0, -1, 1)
            # the mean of sin^2 of half the angle
            spread = np.degrees(2 * np.arcsin(np.sqrt(np.clip(1 - value[:, 3], 0, 1))))
            yield pa.RecordBatch.from_arrays([b.column("frame"), b.column("grain"), *[pa.array(q[:, k]) for k in (1, 2, 3, 0)], pa.array(spread)], names=["frame", "grain", "x", "y", "z", "w", "spread"])

    flat = crystal.join(first, ["frame", "grain", "structure_type"]).select("frame", "grain", "structure_type", *[F.col(f"orientation.{c}").alias(f"q{c}") for c in "wxyz"], *[F.col(f"first.{c}").alias(f"r{c}") for c in "wxyz"])
    key = f"frame {rows.schema['frame'].dataType.simpleString()}, grain long"
    sums = flat.mapInArrow(products, f"{key}, " + ", ".join(f"{n} double" for n in names)).groupBy("frame", "grain").agg(F.count("*").cast("double").alias("n"), *[F.sum(n).alias(n) for n in names])
    mean = sums.mapInArrow(means, f"{key}, x double, y double, z double, w double, spread double")
    size = rows.groupBy("frame", "grain").agg(F.count("*").alias("size"))
    return size.join(kinds, ["frame", "grain"]).join(mean, ["frame", "grain"]).select("frame", "grain", "structure_type", "size", F.struct("x", "y", "z", "w").alias("orientation"), "spread")


def elastic_strain(matched: DataFrame, structure: int, lattice_constant: float, axial_ratio: float | None = None, push_forward: bool = True) -> DataFrame:
    """``matched`` with elastic_deformation (row-wise F), strain (xx, yy, zz, xy, xz, yz) and volumetric_strain of particles of ``structure``; zeros for others.

    F maps the ideal crystal of the given lattice constant (and c/a ratio) to the
    neighbours best, from the template's frame to space.  The strain is the spatial one,
    (1 - (F F^T)^-1) / 2, which no choice among equivalent frames changes, or without
    ``push_forward`` the material one, (F^T F - 1) / 2.  The volumetric strain is a third of its trace.
    """
    first = float(np.linalg.norm(T.template(structure).points[0]))
    size = lattice_constant * FIRST_SHELL[structure] / first
    # a template with another ratio is the ideal one stretched along its axis
    stretch = [1.0, 1.0, (axial_ratio or IDEAL_RATIO) / IDEAL_RATIO if structure in (T.HCP, T.HEX_DIAMOND) else 1.0]
    unit = F.col("interatomic_distance") / F.lit(first * size)
    f = [[F.col("f__")[3 * i + j] for j in range(3)] for i in range(3)]
    own = F.col("structure_type") == structure
    rows = matched.drop("elastic_deformation", "strain", "volumetric_strain").withColumn("f__", F.when(own, F.array(*[F.col("deformation")[3 * i + j] * unit / F.lit(stretch[j]) for i in range(3) for j in range(3)])))
    det = f[0][0] * (f[1][1] * f[2][2] - f[1][2] * f[2][1]) - f[0][1] * (f[1][0] * f[2][2] - f[1][2] * f[2][0]) + f[0][2] * (f[1][0] * f[2][1] - f[1][1] * f[2][0])
    cof = lambda i, j: f[(i + 1) % 3][(j + 1) % 3] * f[(i + 2) % 3][(j + 2) % 3] - f[(i + 1) % 3][(j + 2) % 3] * f[(i + 2) % 3][(j + 1) % 3]
    if push_forward:
        rows = rows.withColumn("g__", F.array(*[cof(i, j) / det for j in range(3) for i in range(3)]))  # the inverse
        g = [[F.col("g__")[3 * i + j] for j in range(3)] for i in range(3)]
        part = lambda a, b: (F.lit(float(a == b)) - sum((g[k][a] * g[k][b] for k in range(3)), F.lit(0.0))) / 2
    else:
        part = lambda a, b: (sum((f[k][a] * f[k][b] for k in range(3)), F.lit(0.0)) - F.lit(float(a == b))) / 2
    pairs = {"xx": (0, 0), "yy": (1, 1), "zz": (2, 2), "xy": (0, 1), "xz": (0, 2), "yz": (1, 2)}
    rows = rows.withColumn("strain", F.struct(*[F.coalesce(part(a, b), F.lit(0.0)).alias(n) for n, (a, b) in pairs.items()]))
    zero = F.array(*[F.lit(0.0)] * 9)
    return rows.withColumns({"elastic_deformation": F.coalesce("f__", zero), "volumetric_strain": (F.col("strain.xx") + F.col("strain.yy") + F.col("strain.zz")) / 3}).drop("f__", "g__")
