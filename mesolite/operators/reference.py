"""Operators that compare a frame with a reference: frozen properties, displacements, strain, site occupancy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell, vec
from mesolite.operators.neighbors import closest_site, neighbors
from mesolite.storage import written


def match(current: DataFrame, reference: DataFrame, columns: list[str], frame: int | None = 0, offset: int | None = None, key: str = "particle_identifier", check: bool = True) -> DataFrame:
    """``current`` with the ``columns`` of the matching reference rows, as ``ref_<column>``.

    Rows match by id where both have one, else by index.  The reference is one
    frame, or the frame ``offset`` frames away.  ``check``: repeated ids or rows
    without a partner are errors; else they get nulls.
    """
    key = key if key in current.columns and key in reference.columns else "idx"
    ref = reference if offset is not None else reference.filter(F.col("frame") == F.lit(frame))
    if check and not ref.groupBy("frame", key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is repeated in the reference")
    cols = [F.col(c).alias(f"ref_{c}") for c in columns]
    if offset is None:
        out = current.join(ref.select(F.col(key).alias("k__"), F.lit(True).alias("hit__"), *cols), F.col(key) == F.col("k__"), "left")
    else:
        ref = ref.select((F.col("frame") - offset).alias("f__"), F.col(key).alias("k__"), F.lit(True).alias("hit__"), *cols)
        out = current.join(ref, (F.col(key) == F.col("k__")) & (F.col("frame") == F.col("f__")), "left").drop("f__")
    if check and not out.filter(F.col("hit__").isNull()).isEmpty():
        raise ValueError("a row has no partner in the reference")
    return out.drop("k__", "hit__")


def freeze_property(df: DataFrame, source: str, destination: str, frame: int = 0, key: str = "particle_identifier") -> DataFrame:
    """The value that a property has at ``frame``, in all frames."""
    out = match(df, df, [source], frame, key=key)
    return out.drop(destination).withColumnRenamed(f"ref_{source}", destination)


def displacements(df: DataFrame, cell: Cell, frame: int | None = 0, offset: int | None = None, key: str = "particle_identifier", minimum_image: bool = True, reference: DataFrame | None = None, check: bool = False) -> DataFrame:
    """``displacement`` and ``displacement_magnitude`` from the reference position, by minimum image along periodic vectors."""
    out = match(df, df if reference is None else reference, ["position"], frame, offset, key, check)
    delta = F.struct(*[(F.col(f"position.{c}") - F.col(f"ref_position.{c}")).alias(c) for c in "xyz"])
    out = out.withColumn("d__", delta)
    if minimum_image and any(cell.periodic):
        r = cell.reduced_vector(F.col("d__"))
        s = cell.shift([F.floor(r[k] + 0.5).cast("double") if cell.periodic[k] else F.lit(0.0) for k in range(3)])
        out = out.withColumn("d__", F.struct(*[(F.col(f"d__.{c}") - s[k]).alias(c) for k, c in enumerate("xyz")]))
    out = out.withColumn("displacement", vec(*[F.col(f"d__.{c}") for c in "xyz"]))
    size = F.sqrt(F.col("d__.x") ** 2 + F.col("d__.y") ** 2 + F.col("d__.z") ** 2)
    return out.withColumn("displacement_magnitude", size).drop("d__", "ref_position")


STRAIN = "struct<xx: double, yy: double, zz: double, xy: double, xz: double, yz: double>"


def _strain(sums: pd.DataFrame, planar: bool) -> pd.DataFrame:
    """Deformation gradient, strain and its invariants of a batch of particles, from the neighbour sums."""
    v = sums[[f"v{a}{b}" for a in range(3) for b in range(3)]].to_numpy().reshape(-1, 3, 3)
    w = sums[[f"w{a}{b}" for a in range(3) for b in range(3)]].to_numpy().reshape(-1, 3, 3)
    if planar:
        v[:, 2, :] = v[:, :, 2] = w[:, 2, :] = w[:, :, 2] = 0
        v[:, 2, 2] = w[:, 2, 2] = 1
    count, scale = sums["n"].to_numpy(), sums["r2"].to_numpy()
    ok = (count >= (2 if planar else 3)) & (np.abs(np.linalg.det(v)) > 1e-12 * scale) & (np.abs(np.linalg.det(w)) > 1e-12 * scale)
    f = np.tile(np.eye(3), (len(v), 1, 1))
    f[ok] = w[ok] @ np.linalg.inv(v[ok])
    e = 0.5 * (np.swapaxes(f, 1, 2) @ f - np.eye(3))
    xx, yy, zz, xy, xz, yz = e[:, 0, 0], e[:, 1, 1], e[:, 2, 2], e[:, 0, 1], e[:, 0, 2], e[:, 1, 2]
    if planar:
        shear, volume = np.sqrt(xy**2 + (xx - yy) ** 2 / 2), (xx + yy) / 2
    else:
        shear = np.sqrt(xy**2 + xz**2 + yz**2 + ((yy - zz) ** 2 + (xx - zz) ** 2 + (xx - yy) ** 2) / 6)
        volume = (xx + yy + zz) / 3
    # the part of the motion that F does not explain
    c2 = sums["c2"].to_numpy()
    d2min = np.maximum(c2 - 2 * np.einsum("nij,nij->n", f, w) + np.einsum("nij,njk,nik->n", f, v, f), 0)
    u, s, vt = np.linalg.svd(f)
    flip = np.linalg.det(u @ vt) < 0
    u[flip, :, 2] *= -1
    s = s.copy()
    s[flip, 2] *= -1
    rot = u @ vt
    stretch = np.swapaxes(vt, 1, 2) @ (s[:, :, None] * vt)
    out = pd.DataFrame({"frame": sums["frame"], "idx": sums["i"], "valid": ok})
    bad = ~ok
    for name, col in (("shear_strain", shear), ("volumetric_strain", volume), ("d2min", d2min)):
        out[name] = np.where(bad, 0.0, col)
    six = lambda m: np.stack([m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], m[:, 0, 1], m[:, 0, 2], m[:, 1, 2]], 1)
    for name, m in (("strain", six(e)), ("stretch", six(stretch))):
        for k, c in enumerate(("xx", "yy", "zz", "xy", "xz", "yz")):
            out[f"{name}_{c}"] = np.where(bad, 0.0, m[:, k])
    for a in range(3):
        for b in range(3):
            out[f"f{a}{b}"] = np.where(bad, 0.0, f[:, a, b])
            out[f"rot{a}{b}"] = np.where(bad, 0.0, rot[:, a, b])
    return out


def atomic_strain(current: DataFrame, reference: DataFrame, cell: Cell, ref_cell: Cell, cutoff: float = 3.0, key: str = "particle_identifier") -> DataFrame:
    """Per particle the deformation of its reference neighbourhood.

    The 20 sums over neighbours are one join and one aggregation in the JVM;
    the 3x3 algebra runs on batches of sums.  Particles with too few neighbours
    or a singular neighbourhood aren't valid and get zeros.
    """
    ids = reference.select("frame", F.col("idx").alias("ref_idx"), F.col(key).alias("id"))
    pairs = neighbors(reference, ref_cell, cutoff)
    now = current.select(F.col("frame").alias("now"), F.col("idx"), F.col(key).alias("id"), "position")
    base = [c for c in pairs.columns if c != "frame"]
    pairs = pairs.join(ids.select("frame", F.col("ref_idx").alias("i"), F.col("id").alias("id_i")), ["frame", "i"]).join(ids.select("frame", F.col("ref_idx").alias("j"), F.col("id").alias("id_j")), ["frame", "j"])
    pairs = pairs.select(*[c for c in base if c not in ("i", "j")], "id_i", "id_j")
    pairs = pairs.join(now.withColumnsRenamed({"id": "id_i", "idx": "i", "position": "pi"}), "id_i").join(now.select("now", F.col("id").alias("id_j"), F.col("position").alias("pj")), ["now", "id_j"])
    # the current separation along the reference image, by minimum image
    r = [F.col(f"pj.{c}") - F.col(f"pi.{c}") for c in "xyz"]
    pairs = pairs.withColumn("e__", F.struct(*[x.alias(c) for x, c in zip(r, "xyz", strict=True)]))
    red = cell.reduced_vector(F.col("e__"))
    s = cell.shift([F.floor(red[k] + 0.5).cast("double") if cell.periodic[k] else F.lit(0.0) for k in range(3)])
    cur = [F.col(f"e__.{c}") - s[k] for k, c in enumerate("xyz")]
    pairs = pairs.withColumns({f"c{k}": cur[k] for k in range(3)})
    ref = [F.col("dx"), F.col("dy"), F.col("dz")]
    sums = [F.sum(ref[a] * ref[b]).alias(f"v{a}{b}") for a in range(3) for b in range(3)] + [F.sum(F.col(f"c{a}") * ref[b]).alias(f"w{a}{b}") for a in range(3) for b in range(3)]
    sums += [F.count("*").alias("n"), F.sum("d2").alias("r2"), F.sum(F.col("c0") ** 2 + F.col("c1") ** 2 + F.col("c2") ** 2).alias("c2")]
    table = pairs.groupBy(F.col("now").alias("frame"), "i").agg(*sums)
    planar = cell.is2d

    def run(batches):
        for b in batches:
            yield _strain(b, planar)

    six = ("xx", "yy", "zz", "xy", "xz", "yz")
    schema = "frame int, idx long, valid boolean, shear_strain double, volumetric_strain double, d2min double, " + ", ".join([f"{n}_{c} double" for n in ("strain", "stretch") for c in six] + [f"{n}{a}{b} double" for a in range(3) for b in range(3) for n in ("f", "rot")])
    flat = table.mapInPandas(run, schema)
    pack = lambda n: F.struct(*[F.col(f"{n}_{c}").alias(c) for c in six]).alias(f"{n}_tensor")
    nine = lambda n, name: F.struct(*[F.col(f"{n}{'xyz'.index(c[0])}{'xyz'.index(c[1])}").alias(c) for c in ("xx", "yx", "zx", "xy", "yy", "zy", "xz", "yz", "zz")]).alias(name)
    got = flat.select("frame", "idx", "valid", "shear_strain", "volumetric_strain", "d2min", pack("strain"), pack("stretch"), nine("f", "deformation_gradient"), nine("rot", "rotation_matrix"))
    return current.join(got, ["frame", "idx"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def wigner_seitz(current: DataFrame, sites: DataFrame, cell: Cell, type_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites with their ``occupancy`` in each frame (by type as a map with ``type_col``), and vacancies and interstitials by frame.

    ``sites`` are reference rows (frame 0 of them); every particle belongs to
    its nearest site.
    """
    # one table of sites serves all frames: a particle is searched under its frame and index together
    one = F.lit(0).alias("frame")
    asked = current.select(one, F.struct("frame", "idx").alias("idx"), "position")
    near = closest_site(asked, sites.select(one, "idx", "position"), cell).select("i.frame", F.col("i.idx").alias("i"), "site")
    near = written(near, "nearest-sites")
    counts = near.groupBy("frame", F.col("site").alias("idx")).agg(F.count("*").cast("int").alias("occupancy"))
    every = current.select("frame").distinct().crossJoin(sites.drop("frame"))  # the result has each site in each frame
    out = every.join(counts, ["frame", "idx"], "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0)))
    if type_col:
        types = current.select("frame", F.col("idx").alias("i"), F.col(type_col).alias("t"))
        by = near.join(types, ["frame", "i"]).groupBy("frame", "site", "t").agg(F.count("*").cast("int").alias("n"))
        by = by.groupBy("frame", F.col("site").alias("idx")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("occupancy_by_type"))
        out = out.join(by, ["frame", "idx"], "left")
    # vacancies are the sites that no particle took, so they need no row for each site
    taken = counts.groupBy("frame").agg(F.count("*").alias("taken"), F.sum(F.col("occupancy") - 1).alias("extra"))
    total = sites.agg(F.count("*").alias("sites"))
    defects = current.select("frame").distinct().join(taken, "frame", "left").crossJoin(total)  # one row beside each frame
    defects = defects.select("frame", (F.col("sites") - F.coalesce("taken", F.lit(0))).alias("vacancy_count"), F.coalesce("extra", F.lit(0)).cast("long").alias("interstitial_count"))
    return out, defects
