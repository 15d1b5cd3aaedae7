"""LAMMPS text dumps, read with Spark's text source: one record for each frame.

The section title that opens a frame is the record separator, so a large file
is split over tasks at any byte.  A record is taken apart by column functions:
header fields by regular expressions, atoms by exploding the lines.  gzip files
are read whole, as Spark does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.cell import vec

SEPARATOR = "ITEM: TIMESTEP"  # lines may end in either way
INTEGERS = {"id": "particle_identifier", "type": "particle_type", "mol": "molecule_identifier"}
REALS = {"q": "charge", "mass": "mass", "radius": "radius"}
POSITION = [("x", "y", "z"), ("xu", "yu", "zu"), ("xs", "ys", "zs"), ("xsu", "ysu", "zsu")]


def frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, timestep, n, pbc, tilt, bounds, columns, atoms) of each complete frame; ``atoms`` is the text of its lines.

    A frame whose atom lines are fewer than announced is dropped.
    """
    reader = (spark.readStream if stream else spark.read).option("lineSep", SEPARATOR)
    t = (reader.text(path) if stream else reader.text(path)).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value")).filter(F.length("value") > 0)
    number = r"([-+0-9.eE]+)"
    bounds = F.split(F.trim(F.regexp_extract("value", r"ITEM: BOX BOUNDS[^\n]*\n([^\n]+\n[^\n]+\n[^\n]+)\n", 1)), r"\s+").cast("array<double>")
    t = t.select(
        "file",
        F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("timestep"),
        F.regexp_extract("value", r"ITEM: TIME\n\s*" + number, 1).try_cast("double").alias("time"),
        F.regexp_extract("value", r"ITEM: NUMBER OF ATOMS\n\s*(\d+)", 1).try_cast("long").alias("n"),
        F.regexp_extract_all("value", F.lit(r"(?<=\s)([pfsm]{2})(?=[\s])"), 1).alias("flags"),
        (F.instr("value", "ITEM: BOX BOUNDS xy xz yz") > 0).alias("tilted"),
        bounds.alias("bounds"),
        F.split(F.trim(F.regexp_extract("value", r"ITEM: ATOMS([^\n]*)\n", 1)), r"\s+").alias("columns"),
        # what follows the line of column names, up to the next section
        F.substring_index(F.regexp_replace(F.expr("substr(value, instr(value, 'ITEM: ATOMS'))"), r"^[^\n]*\n", ""), "ITEM:", 1).alias("atoms"),
    )
    lines = F.filter(F.split("atoms", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return t.withColumn("lines", lines).filter((F.size("lines") == F.col("n")) & F.col("n").isNotNull()).drop("atoms")


def cell_columns(t: DataFrame) -> DataFrame:
    """Cell vectors ax ... cz, origin and periodic flags of ``frames``; bounds of tilted boxes are shrunk by the tilt."""
    b = lambda k: F.element_at("bounds", k + 1)
    step = F.when(F.col("tilted"), F.lit(3)).otherwise(F.lit(2))
    lo = [F.element_at("bounds", step * d + 1) for d in range(3)]
    hi = [F.element_at("bounds", step * d + 2) for d in range(3)]
    tilt = [F.when(F.col("tilted"), b(k)).otherwise(F.lit(0.0)) for k in (2, 5, 8)]
    t = t.withColumns({"xy": tilt[0], "xz": tilt[1], "yz": tilt[2]})
    xs, ys = [F.lit(0.0), F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")], [F.lit(0.0), F.col("yz")]
    t = t.withColumns({"ox": lo[0] - F.least(*xs), "oy": lo[1] - F.least(*ys), "oz": lo[2], "hx": hi[0] - F.greatest(*xs), "hy": hi[1] - F.greatest(*ys), "hz": hi[2]})
    zero = F.lit(0.0)
    t = t.withColumns({"ax": F.col("hx") - F.col("ox"), "ay": zero, "az": zero, "bx": F.col("xy"), "by": F.col("hy") - F.col("oy"), "bz": zero, "cx": F.col("xz"), "cy": F.col("yz"), "cz": F.col("hz") - F.col("oz")})
    on = lambda d: F.coalesce(F.try_element_at("flags", F.lit(d + 1)) == "pp", F.lit(False))
    return t.withColumns({f"pbc_{c}": on(d) for d, c in enumerate("xyz")}).drop("xy", "xz", "yz", "hx", "hy", "hz")


CELL = [*(f"{v}{c}" for v in "abc" for c in "xyz"), "ox", "oy", "oz", "pbc_x", "pbc_y", "pbc_z"]


def _column(names: tuple[str, ...] | str) -> Column:
    """The value of the first line column of these names, NULL where there is none."""
    at = F.array_position("columns", names)
    return F.when(at > 0, F.try_element_at("v", at.cast("int")))


def atoms(t: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each atom of ``frames``: timestep, idx, identifier, type, position; ``extra`` names further columns.

    Of the columns for a coordinate the last one mapped wins; scaled
    coordinates are multiplied by the cell.  A diameter is halved.
    """
    t = cell_columns(t)
    keep = [c for c in ("frame", "file") if c in t.columns]
    rows = t.select(*keep, "timestep", "columns", *CELL, F.posexplode("lines").alias("idx", "line")).withColumn("v", F.split(F.trim("line"), r"\s+"))
    real = lambda n: _column(n).try_cast("double")
    plain = [F.coalesce(real(POSITION[1][d]), real(POSITION[0][d])) for d in range(3)]
    scaled = [F.coalesce(real(POSITION[3][d]), real(POSITION[2][d])) for d in range(3)]
    rows = rows.withColumns({f"p{d}": plain[d] for d in range(3)} | {f"s{d}": scaled[d] for d in range(3)})
    full = [F.col(f"o{c}") + F.col(f"a{c}") * F.col("s0") + F.col(f"b{c}") * F.col("s1") + F.col(f"c{c}") * F.coalesce("s2", F.lit(0.0)) for c in "xyz"]
    position = vec(*[F.coalesce(F.when(F.col("s0").isNotNull(), full[d]), F.col(f"p{d}"), F.lit(0.0)) for d in range(3)])
    radius = F.coalesce(real("radius"), real("diameter") / 2)
    found = {v: _column(k).try_cast("long") for k, v in INTEGERS.items()} | {v: real(k) for k, v in REALS.items()} | {"radius": radius} | {c: real(c) for c in extra}
    wanted = ["particle_identifier", "particle_type", *extra]
    return rows.select(*keep, "timestep", F.col("idx").cast("long").alias("idx"), *[found[c].alias(c) for c in wanted], position.alias("position"), radius.alias("radius"))


def numbered(t: DataFrame) -> DataFrame:
    """``frames`` with ``frame`` 0, 1, ... in order of file (numbers in names by value) and timestep; equal steps of one file count once.

    The window is over frames, of which a trajectory has few, without their lines.
    """
    natural = F.regexp_replace(F.regexp_replace("file", r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")
    keys = t.select("file", "timestep", natural.alias("order")).distinct()
    keys = keys.select("file", "timestep", (F.row_number().over(Window.orderBy("order", "timestep")) - 1).cast("int").alias("frame"))
    return t.join(F.broadcast(keys) if keys.count() < 100_000 else keys, ["file", "timestep"])


def read(spark: SparkSession, path: str, extra: tuple[str, ...] = (), sort_by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Particles and cells (one row for each frame) of dump files; the path may hold wildcards."""
    t = numbered(frames(spark, path))
    cells = cell_columns(t).select("frame", "timestep", "time", *CELL)
    rows = atoms(t, extra)
    if sort_by_id:
        place = F.row_number().over(Window.partitionBy("frame").orderBy("particle_identifier", "idx")) - 1
        rows = rows.withColumn("idx", place.cast("long"))
    return rows, cells
