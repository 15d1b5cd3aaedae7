"""Writers: a folder for each frame, whose lines come from one sorted partition.

``write`` deals rows by frame and sorts by index; a frame is one file, as the
formats ask, so a task holds no more than the sort's buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mesolite.cell import Cell


def _write(lines: DataFrame, path: str) -> None:
    """``lines`` (frame, part, idx, value), ordered within each frame."""
    lines.repartition("frame").sortWithinPartitions("frame", "part", "idx").select("frame", "value").write.partitionBy("frame").text(path)


def _number(c: str | F.Column) -> F.Column:
    return F.format_string("%.17g", c) if isinstance(c, F.Column) else F.format_string("%.17g", F.col(c))


def write_dump(df: DataFrame, path: str, cell: Cell, extra: tuple[str, ...] = ()) -> None:
    """LAMMPS dump frames; the cell has to be lower triangular, its outer box is written."""
    m, o = cell.array, cell.origin
    if m[1][0] or m[2][0] or m[2][1] or min(m[0][0], m[1][1], m[2][2]) <= 0:
        raise ValueError("the cell has to be lower triangular with positive edges")
    xy, xz, yz = float(m[0][1]), float(m[0][2]), float(m[1][2])
    flags = " ".join("pp" if p else "ff" for p in cell.pbc)
    tilted = bool(xy or xz or yz)
    outer = [(o[0] + min(0, xy, xz, xy + xz), o[0] + m[0][0] + max(0, xy, xz, xy + xz), xy), (o[1] + min(0, yz), o[1] + m[1][1] + max(0, yz), xz), (o[2], o[2] + m[2][2], yz)]
    box = "\n".join(f"{lo!r} {hi!r}" + (f" {t!r}" if tilted else "") for lo, hi, t in [(float(a), float(b), c) for a, b, c in outer])
    names = " ".join(["id", "type", "x", "y", "z", *extra])
    head = df.groupBy("frame").agg(F.count("*").alias("n"))
    head = head.select("frame", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("idx"), F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("frame").cast("string"), F.lit("\nITEM: NUMBER OF ATOMS\n"), F.col("n").cast("string"), F.lit(f"\nITEM: BOX BOUNDS {'xy xz yz ' if tilted else ''}{flags}\n{box}\nITEM: ATOMS {names}")).alias("value"))
    body = F.concat_ws(" ", F.col("particle_identifier").cast("string"), F.coalesce("particle_type", F.lit(0)).cast("int").cast("string"), *[_number(f"position.{c}") for c in "xyz"], *[_number(F.col(c).cast("double")) for c in extra])
    _write(head.unionByName(df.select("frame", F.lit(1).alias("part"), "idx", body.alias("value"))), path)


def write_xyz(df: DataFrame, path: str, cell: Cell, names: dict[int, str] | None = None) -> None:
    """Extended XYZ frames; blanks in type names become underscores."""
    m = cell.array.T.ravel()
    comment = f'Lattice="{" ".join(repr(float(x)) for x in m)}" Origin="{" ".join(map(repr, cell.origin))}" Properties=species:S:1:pos:R:3'
    kind = F.col("particle_type").cast("string")
    if names:
        kind = F.coalesce(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v.replace(" ", "_"))])[F.col("particle_type").cast("int")], kind)
    head = df.groupBy("frame").agg(F.count("*").alias("n")).select("frame", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("idx"), F.concat(F.col("n").cast("string"), F.lit("\n" + comment)).alias("value"))
    body = F.concat_ws(" ", kind, *[_number(f"position.{c}") for c in "xyz"])
    _write(head.unionByName(df.select("frame", F.lit(1).alias("part"), "idx", body.alias("value"))), path)


def write_table(df: DataFrame, path: str) -> None:
    """A data table as text with blanks between columns and a header."""
    df.write.option("sep", " ").option("header", True).csv(path)


def write_frames(df: DataFrame, path: str) -> None:
    """Parquet, partitioned by frame."""
    df.repartition("frame").sortWithinPartitions("frame", "idx").write.partitionBy("frame").parquet(path)


def write_data(df: DataFrame, path: str, cell: Cell, bonds: DataFrame | None = None) -> None:
    """Data files of atomic style (bond style with ``bonds``), one for each frame; the cell has to be lower triangular."""
    m, o = cell.array, cell.origin
    if m[1][0] or m[2][0] or m[2][1] or min(m[0][0], m[1][1], m[2][2]) <= 0:
        raise ValueError("the cell has to be lower triangular with positive edges")
    xy, xz, yz = float(m[0][1]), float(m[0][2]), float(m[1][2])
    box = "\n".join(f"{float(o[d])!r} {float(o[d] + m[d][d])!r} {c}lo {c}hi" for d, c in enumerate("xyz"))
    box += f"\n{xy!r} {xz!r} {yz!r} xy xz yz" if xy or xz or yz else ""
    counts = df.groupBy("frame").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.max(F.coalesce("particle_type", F.lit(1)))).cast("string").alias("types"))
    lines = [F.concat(F.col("n").cast("string"), F.lit(" atoms")), F.concat(F.col("types"), F.lit(" atom types"))]
    style, molecule = "atomic", []
    if bonds is not None:
        style, molecule = "bond", [F.lit("0")]
        listed = bonds.groupBy("frame").agg(F.count("*").alias("nb"), F.max(F.coalesce("bond_type", F.lit(1))).alias("tb"))
        counts = counts.join(listed, "frame", "left").na.fill({"nb": 0, "tb": 1})
        lines += [F.concat(F.col("nb").cast("string"), F.lit(" bonds")), F.concat(F.col("tb").cast("string"), F.lit(" bond types"))]
    start = F.lit(-1).cast("long")
    head = counts.select("frame", F.lit(0).alias("part"), start.alias("idx"), F.concat_ws("\n", F.lit("data file\n"), *lines, F.lit(f"{box}\n\nAtoms # {style}\n")).alias("value"))
    body = F.concat_ws(" ", F.col("particle_identifier").cast("string"), *molecule, F.coalesce("particle_type", F.lit(1)).cast("int").cast("string"), *[_number(f"position.{c}") for c in "xyz"])
    out = head.unionByName(df.select("frame", F.lit(1).alias("part"), "idx", body.alias("value")))
    if bonds is not None:
        ids = df.select("frame", F.col("idx").alias("k__"), F.col("particle_identifier").alias("id__"))
        named = bonds.join(ids.withColumnsRenamed({"k__": "a", "id__": "ia"}), ["frame", "a"]).join(ids.withColumnsRenamed({"k__": "b", "id__": "ib"}), ["frame", "b"])
        value = F.concat_ws(" ", (F.col("bond_idx") + 1).cast("string"), F.coalesce("bond_type", F.lit(1)).cast("string"), F.col("ia").cast("string"), F.col("ib").cast("string"))
        out = out.unionByName(listed.select("frame", F.lit(2).alias("part"), start.alias("idx"), F.lit("\nBonds\n").alias("value")))
        out = out.unionByName(named.select("frame", F.lit(3).alias("part"), F.col("bond_idx").cast("long").alias("idx"), value.alias("value")))
    _write(out, path)


def write_poscar(df: DataFrame, path: str, cell: Cell, names: dict[int, str], reduced: bool = False) -> None:
    """Structure files, one for each frame, atoms by falling type order of ``names``; positions in the cell's vectors where ``reduced``."""
    order = {k: i for i, k in enumerate(names)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("particle_type").cast("int")]
    sides = "\n".join(" ".join(repr(float(x)) for x in cell.array[:, k]) for k in range(3))
    rows = df.withColumn("place", place)
    counts = rows.groupBy("frame").agg(*[F.count_if(F.col("place") == i).cast("string").alias(f"n{i}") for i in order.values()])
    head = F.concat_ws("\n", F.lit(f"positions\n1.0\n{sides}\n{' '.join(names.values())}"), F.concat_ws(" ", *[f"n{i}" for i in order.values()]), F.lit("Direct" if reduced else "Cartesian"))
    at = cell.reduced(F.col("position")) if reduced else [F.col(f"position.{c}") - float(cell.origin[d]) for d, c in enumerate("xyz")]
    body = rows.filter("place IS NOT NULL").select("frame", (F.col("place") + 1).alias("part"), "idx", F.concat_ws(" ", *[_number(x) for x in at]).alias("value"))
    _write(counts.select("frame", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("idx"), head.alias("value")).unionByName(body), path)


def write_attributes(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """A table of global attributes, one line for each frame in order, with a commented header of quoted names.

    Values with a blank are quoted; a value that is missing in a frame is an error.
    """
    head = df.sparkSession.createDataFrame([(-1, "# " + " ".join(f'"{c}"' for c in columns))], "frame long, value string")

    def shown(c: str) -> Column:
        missing = F.raise_error(F.concat(F.lit(f"the attribute {c!r} is missing in frame "), F.col("frame").cast("string")))
        text = F.coalesce(F.col(c).cast("string"), missing)
        return F.when(F.contains(text, F.lit(" ")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    body = df.select(F.col("frame").cast("long").alias("frame"), F.concat_ws(" ", *[shown(c) for c in columns]).alias("value"))
    head.unionByName(body).repartitionByRange("frame").sortWithinPartitions("frame").select("value").write.text(path)


def write_vtk_grid(df: DataFrame, path: str, cell: Cell, shape: tuple[int, int, int], fields: tuple[str, ...]) -> None:
    """Structured points of VTK, a file for each frame, from voxels (frame, vx, vy, vz, ``fields``); x runs fastest, a value in each line.

    Fields are numbers or structs of up to four numbers, written as int, long or
    double; three doubles are vectors, structs with more members are left out.  Blanks in
    names go; nulls are NaN or 0.
    """
    kinds = {"int": "int", "bigint": "long"}
    parts = {c: [f"{c}.{m.name}" for m in df.schema[c].dataType] if isinstance(df.schema[c].dataType, T.StructType) else [c] for c in fields}
    fields = tuple(c for c in fields if len(parts[c]) <= 4)
    member = lambda c: df.select(F.col(c)).dtypes[0][1]
    nx, ny, nz = shape
    spacing = [float((cell.array[:, d] ** 2).sum() ** 0.5) / n for d, n in enumerate(shape)]
    head = "\n".join(["# vtk DataFile Version 3.0", "Voxel grid", "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", f"ORIGIN {' '.join(map(repr, cell.origin))}", f"SPACING {' '.join(map(repr, spacing))}", f"POINT_DATA {nx * ny * nz}"])
    frames = df.select("frame").distinct()
    title = lambda part, text: F.struct(F.lit(part).alias("part"), F.lit(-1).cast("long").alias("idx"), F.lit(text).alias("value"))
    named = {c: [f"`{c}`.`{p.split('.', 1)[1]}`" if len(parts[c]) > 1 or p != c else f"`{c}`" for p in parts[c]] for c in fields}
    types = {c: kinds.get(member(named[c][0]), "double") if len({member(p) for p in named[c]}) == 1 else "double" for c in fields}
    section = lambda c: f"\nVECTORS {c.replace(' ', '')} double" if len(named[c]) == 3 and types[c] == "double" else f"\nSCALARS {c.replace(' ', '')} {types[c]} {len(named[c])}\nLOOKUP_TABLE default"
    heads = [title(0, head)] + [title(k, section(c)) for k, c in enumerate(fields, 1)]
    one = lambda p, kind: F.coalesce(F.col(p), F.lit(0)).cast("string") if kind != "double" else _number(F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))))
    value = lambda c: F.concat_ws(" ", *[one(p, types[c]) for p in named[c]])
    place = F.col("vx").cast("long") + nx * (F.col("vy").cast("long") + ny * F.col("vz").cast("long"))
    each = F.array(*[F.struct(F.lit(k).alias("part"), place.alias("idx"), value(c).alias("value")) for k, c in enumerate(fields, 1)])
    _write(frames.select("frame", F.inline(F.array(*heads))).unionByName(df.select("frame", F.inline(each))), path)
