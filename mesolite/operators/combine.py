"""Merging and multiplying datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell, image, vec

ID = "particle_identifier"


def merge_types(first: dict[int, str], second: dict[int, str]) -> tuple[dict[int, str], dict[int, int]]:
    """Type names of both and the second's new ids: equal names share an id, conflicting ids get new ones."""
    names, moved = dict(first), {}
    by_name = {v: k for k, v in first.items() if v}
    for i, n in second.items():
        if n in by_name:
            moved[i] = by_name[n]
        elif i not in names:
            names[i] = n
            moved[i] = i
        else:
            moved[i] = max([*names, *second], default=0) + 1
            names[moved[i]] = n
    return names, moved


def combine(first: DataFrame, second: DataFrame, type_map: dict[str, dict[int, int]] | None = None, bonds: tuple[DataFrame, DataFrame] | None = None, id_col: str = ID, molecule_col: str = "molecule_identifier"):
    """All rows of both tables by column name, in each frame; the second's come last.

    Columns that only one has are 0 (or null structs) for the other; the
    second's ids continue after the first's greatest, in order of index, its
    molecule ids move by the first's greatest, its indices by the first's count.
    """
    size = first.groupBy("frame").agg(F.count("*").alias("n__"), *([F.max(id_col).alias("m__")] if id_col in first.columns else []), *([F.max(molecule_col).alias("mm__")] if molecule_col in first.columns else []))
    moved = second.join(F.broadcast(size), "frame", "left")  # one row for each frame
    if id_col in first.columns:
        moved = moved.withColumn(id_col, F.coalesce("m__", F.lit(0)) + 1 + F.col("idx"))
    if molecule_col in first.columns and molecule_col in second.columns:
        moved = moved.withColumn(molecule_col, F.col(molecule_col) + F.coalesce("mm__", F.lit(0)))
    for c, mapping in (type_map or {}).items():
        if mapping:
            pairs = [F.lit(x) for kv in mapping.items() for x in kv]
            moved = moved.withColumn(c, F.coalesce(F.element_at(F.create_map(*pairs), F.col(c)), F.col(c)))
    moved = moved.withColumn("idx", F.col("idx") + F.coalesce("n__", F.lit(0))).drop("n__", "m__", "mm__")
    kinds = dict(first.dtypes) | dict(second.dtypes)
    other = {c for c, k in first.dtypes if c in dict(second.dtypes) and dict(second.dtypes)[c] != k}
    out = first.unionByName(moved.drop(*other), allowMissingColumns=True)
    plain = {c: F.coalesce(F.col(c), F.lit(0).cast(k)) for c, k in kinds.items() if k in ("int", "bigint", "double", "float") and c not in ("frame", "idx")}
    out = out.withColumns(plain) if plain else out
    if bonds is None:
        return out
    shifted = bonds[1].join(F.broadcast(size.select("frame", "n__")), "frame", "left").withColumns({c: F.col(c) + F.coalesce("n__", F.lit(0)) for c in ("a", "b")}).drop("n__")
    return out, bonds[0].unionByName(shifted, allowMissingColumns=True)


def replicate(df: DataFrame, cell: Cell, n: tuple[int, int, int], adjust_box: bool = True, unique_ids: bool = True, bonds: DataFrame | None = None, id_col: str = ID):
    """Copies of all rows along the cell vectors, the first vector slowest; bonds cross to the copy their image names.

    Images run from -(n - 1) / 2 to n / 2 (whole division).
    """
    if min(n) < 1:
        raise ValueError("there must be one copy at least")
    lo = [-((k - 1) // 2) for k in n]
    total = n[0] * n[1] * n[2]
    copies = F.explode(F.sequence(F.lit(0), F.lit(total - 1)))
    size = df.groupBy("frame").agg(F.count("*").alias("n__"), *([F.min(id_col).alias("lo__"), F.max(id_col).alias("hi__")] if id_col in df.columns else []))
    out = df.join(F.broadcast(size), "frame").withColumn("c__", copies)  # one row for each frame
    place = [F.floor(F.col("c__") / (n[1] * n[2])), F.floor(F.col("c__") / n[2]) % n[1], F.col("c__") % n[2]]
    s = cell.shift([(place[d] + lo[d]).cast("double") for d in range(3)])
    out = out.withColumn("position", vec(*[F.col(f"position.{c}") + s[d] for d, c in enumerate("xyz")]))
    if unique_ids and id_col in df.columns:
        out = out.withColumn(id_col, F.col(id_col) + (F.col("hi__") - F.col("lo__") + 1) * F.col("c__"))
    out = out.withColumn("idx", (F.col("idx") + F.col("n__") * F.col("c__")).cast("long")).drop("n__", "lo__", "hi__", "c__").select(df.columns)
    m = cell.array
    origin = tuple(float(o + sum(m[r, d] * lo[d] for d in range(3))) for r, o in enumerate(cell.origin))
    new_cell = Cell(tuple(tuple(float(m[r, d] * n[d]) for d in range(3)) for r in range(3)), origin, cell.pbc, cell.is2d) if adjust_box else cell
    if bonds is None:
        return out, new_cell
    b = bonds.join(F.broadcast(size.select("frame", "n__")), "frame").withColumn("c__", copies)
    target = [place[d] + F.col(f"image.{c}") for d, c in enumerate("xyz")]
    to = [F.pmod(target[d], F.lit(n[d])) for d in range(3)]
    where = (to[0] * n[1] + to[1]) * n[2] + to[2]
    b = b.withColumns({"to__": where, "img__": image(*[F.floor(target[d] / n[d]) for d in range(3)])})
    b = b.withColumns({"a": (F.col("a") + F.col("n__") * F.col("c__")).cast("long"), "b": (F.col("b") + F.col("n__") * F.col("to__")).cast("long"), "image": F.col("img__")})
    return out, new_cell, b.select(bonds.columns)


def load_trajectory(topology: DataFrame, trajectory: DataFrame, id_col: str = ID) -> DataFrame:
    """Topology rows (static) with the columns of each frame of a trajectory, by id.

    Trajectory columns win.  Ids missing in a frame are an error; ids that only
    the trajectory has are appended.
    """
    static = topology.drop("frame")
    frames = trajectory.select("frame").distinct()
    held = trajectory.select("frame", id_col).distinct().join(static.select(id_col).distinct(), id_col, "left_semi").groupBy("frame").count()
    if not frames.join(held.filter(F.col("count") >= static.select(id_col).distinct().count()), "frame", "left_anti").isEmpty():
        raise ValueError("an id of the topology is missing in the trajectory")
    own = [c for c in static.columns if c not in trajectory.columns]
    return trajectory.join(static.select(id_col, *own), id_col, "left")
