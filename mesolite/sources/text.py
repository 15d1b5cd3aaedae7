"""Line-based formats, taken apart by column functions: XYZ, PDB, GRO, POSCAR and triangle meshes.

Files are read whole, one record each (Spark's limit is 2 GB for one), and
their lines exploded; formats with fixed columns are cut by substring.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.cell import vec


def whole(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line)"""
    return whole(spark, path).select("file", F.posexplode(F.split("value", "\n")).alias("no", "line"))


def _words(c: str = "line") -> F.Column:
    return F.split(F.trim(c), r"\s+")


def _at(k: int, c: str = "v") -> F.Column:
    return F.try_element_at(c, F.lit(k))


def xyz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Particles (file, frame, idx, species, position) and frames (file, frame, n, comment, lattice, attributes).

    The helper only finds where frames begin, which needs the file in order; a
    truncated last frame is dropped.  ``Lattice="..."`` gives the nine numbers
    of the cell, other ``key=value`` pairs of the comment are attributes.
    ``Properties=`` says in which column species and positions are.
    """

    def cut(batches):
        for b in batches:
            for file, value in zip(b["file"], b["value"], strict=True):
                rows, at, frame = value.split("\n"), 0, 0
                while at < len(rows) and rows[at].strip().isdigit() and at + 2 + int(rows[at]) <= len(rows):
                    n = int(rows[at])
                    yield pd.DataFrame({"file": [file], "frame": [frame], "n": [n], "comment": [rows[at + 1] if n or at + 1 < len(rows) else ""], "body": ["\n".join(rows[at + 2 : at + 2 + n])]})
                    at, frame = at + 2 + n, frame + 1

    t = whole(spark, path).mapInPandas(cut, "file string, frame int, n long, comment string, body string")
    lattice = F.split(F.trim(F.regexp_extract("comment", r'Lattice="([^"]*)"', 1)), r"\s+")
    pairs = F.transform(F.regexp_extract_all("comment", F.lit(r'(\w+=(?:"[^"]*"|\S+))'), 1), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)=", 1), F.regexp_replace(F.regexp_extract(x, r"=(.*)$", 1), '"', "")))
    attributes = F.map_filter(F.map_from_entries(F.array_distinct(pairs)), lambda k, _: ~k.isin("Lattice", "Properties"))
    t = t.withColumn("lattice", F.when(F.size(lattice) == 9, lattice.cast("array<double>"))).withColumn("attributes", attributes)
    spec = F.split(F.regexp_extract("comment", r"Properties=(\S+)", 1), ":")
    # (name, first column) of each property, from name:type:count triples
    places = F.expr("""aggregate(sequence(0, greatest(size(spec) div 3 - 1, 0)), struct(1 AS at, map('', 0) AS m),
        (a, k) -> struct(a.at + coalesce(try_cast(get(spec, 3 * k + 2) AS int), 0) AS at, map_concat(map_filter(a.m, (n, _) -> n <> coalesce(get(spec, 3 * k), '')), map(coalesce(get(spec, 3 * k), ''), a.at)) AS m)).m""")
    rows = t.withColumn("spec", spec).withColumn("places", places)
    rows = rows.withColumn("sp", F.coalesce(F.try_element_at("places", F.lit("species")), F.lit(1))).withColumn("pp", F.coalesce(F.try_element_at("places", F.lit("pos")), F.lit(2)))
    rows = rows.filter("n > 0").select("file", "frame", "sp", "pp", F.posexplode(F.split("body", "\n")).alias("idx", "line")).withColumn("v", _words())
    get = lambda k: F.try_element_at("v", F.col("pp") + k).try_cast("double")
    particles = rows.select("file", "frame", F.col("idx").cast("long").alias("idx"), F.try_element_at("v", "sp").alias("species"), vec(get(0), get(1), get(2)).alias("position"))
    return particles, t.drop("body")


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records: file, no, serial, name, residue, chain, residue_number, position, element."""
    t = lines(spark, path).filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    num = lambda a, n: cut(a, n).try_cast("double")
    return t.select("file", "no", cut(7, 5).try_cast("long").alias("particle_identifier"), cut(13, 4).alias("name"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("residue_number"), vec(num(31, 8), num(39, 8), num(47, 8)).alias("position"), cut(77, 2).alias("element"))


def gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first frame of each file: residue_number, residue, name, identifier, position (lengths times 10)."""
    t = lines(spark, path)
    n = t.filter("no = 1").select(F.col("file").alias("f"), F.trim("line").try_cast("long").alias("n"))
    t = t.join(F.broadcast(n), F.col("file") == F.col("f")).filter((F.col("no") >= 2) & (F.col("no") < F.col("n") + 2))
    cut = lambda a, k: F.trim(F.substring("line", a, k))
    num = lambda a: cut(a, 8).try_cast("double") * 10
    return t.select("file", (F.col("no") - 2).cast("long").alias("idx"), cut(1, 5).try_cast("int").alias("residue_number"), cut(6, 5).alias("residue"), cut(11, 5).alias("name"), cut(16, 5).try_cast("long").alias("particle_identifier"), vec(num(21), num(29), num(37)).alias("position"))


def poscar(spark: SparkSession, path: str) -> DataFrame:
    """Atoms (file, idx, particle_type, species, position) of structure files with element names; the scale has to be positive."""
    t = whole(spark, path).withColumn("l", F.split("value", "\n"))
    row = lambda k: _words_of(F.try_element_at("l", F.lit(k)))
    named = ~F.trim(F.try_element_at("l", F.lit(6))).rlike(r"^\d")
    t = t.withColumns({"scale": F.try_element_at("l", F.lit(2)).try_cast("double"), "a": row(3), "b": row(4), "c": row(5), "species": F.when(named, row(6)).otherwise(row(1)), "counts": F.when(named, row(7)).otherwise(row(6)).cast("array<int>"), "at": F.when(named, F.lit(8)).otherwise(F.lit(7))})
    t = t.withColumn("at", F.col("at") + F.element_at("l", F.col("at")).rlike(r"^\s*[sS]").cast("int"))
    t = t.withColumn("cartesian", F.element_at("l", F.col("at")).rlike(r"^\s*[cCkK]"))
    kinds = F.expr("flatten(transform(sequence(1, size(counts)), k -> array_repeat(k, element_at(counts, k))))")
    t = t.filter("scale > 0").withColumn("kinds", kinds)
    rows = t.select("file", "scale", "a", "b", "c", "species", "cartesian", F.posexplode(F.expr("zip_with(kinds, slice(l, at + 1, size(kinds)), (k, x) -> struct(k AS kind, x AS line))")).alias("idx", "x"))
    rows = rows.select("*", F.col("x.kind").alias("particle_type"), _words_of(F.col("x.line")).alias("v"))
    p = lambda k: _at(k).try_cast("double")
    side = lambda v, k: F.element_at(v, k).cast("double")
    put = [F.col("scale") * F.when(F.col("cartesian"), p(d)).otherwise(side("a", d) * p(1) + side("b", d) * p(2) + side("c", d) * p(3)) for d in (1, 2, 3)]
    return rows.select("file", F.col("idx").cast("long").alias("idx"), "particle_type", F.try_element_at("species", "particle_type").alias("species"), vec(*put).alias("position"))


def _words_of(c: F.Column) -> F.Column:
    return F.split(F.trim(c), r"\s+")


def obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, no, position) and faces (file, no, corners from 1) of OBJ meshes."""
    t = lines(spark, path).withColumn("v", _words())
    d = lambda k: _at(k).try_cast("double")
    faces = F.transform(F.slice("v", 2, F.size("v")), lambda x: F.split(x, "/")[0].cast("int"))
    return t.filter(_at(1) == "v").select("file", "no", vec(d(2), d(3), d(4)).alias("position")), t.filter(_at(1) == "f").select("file", "no", faces.alias("corners"))


def stl(spark: SparkSession, path: str) -> DataFrame:
    """Corners (file, facet, corner, position) of ASCII STL meshes."""
    facets = whole(spark, path).select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"outer loop([\s\S]*?)endloop"), 1)).alias("facet", "body"))
    rows = facets.select("file", "facet", F.posexplode(F.regexp_extract_all("body", F.lit(r"vertex\s+(\S+\s+\S+\s+\S+)"), 1)).alias("corner", "line")).withColumn("v", _words())
    return rows.select("file", "facet", "corner", vec(*[_at(k).cast("double") for k in (1, 2, 3)]).alias("position"))


def dump_local(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file, timestep, no, values by column name) of local dumps, such as bonds, and the entries announced by frame."""
    t = spark.read.option("lineSep", "ITEM: TIMESTEP").text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value")).filter(F.length("value") > 0)
    body = F.regexp_replace(F.expr("substr(value, instr(value, 'ITEM: ENTRIES'))"), r"^[^\n]*\n", "")
    t = t.select("file", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("timestep"), F.regexp_extract("value", r"ITEM: NUMBER OF ENTRIES\s*(\d+)", 1).try_cast("long").alias("n"), _words_of(F.regexp_extract("value", r"ITEM: ENTRIES([^\n]*)", 1)).alias("columns"), F.filter(F.split(F.substring_index(body, "ITEM:", 1), "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    t = t.filter(F.size("lines") == F.col("n"))
    rows = t.select("file", "timestep", "columns", F.posexplode("lines").alias("no", "line")).withColumn("v", F.transform(_words(), lambda x: x.try_cast("double")))
    return rows.filter(F.size("v") == F.size("columns")).select("file", "timestep", F.col("no").cast("long").alias("no"), F.map_from_arrays("columns", "v").alias("values")), t.select("file", "timestep", "n", "columns")


def cfg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (file, idx, mass, species, position, rest) and header (file, n, unit, h: the cell's nine numbers by row, names of the auxiliary columns).

    In the extended form a line of one number sets the mass and a line of one
    word the species of the atoms after it; in the plain form they begin each line.  ``rest`` holds
    the columns after the position: velocities, then auxiliary ones.
    """
    t = whole(spark, path)
    number = r"([-+0-9.eE]+)"
    h = F.array(*[F.regexp_extract("value", rf"H0\({a},{b}\)\s*=\s*{number}", 1).try_cast("double") for a in (1, 2, 3) for b in (1, 2, 3)])
    unit = F.coalesce(F.regexp_extract("value", rf"(?m)^A\s*=\s*{number}", 1).try_cast("double"), F.lit(1.0))
    head = t.select("file", F.regexp_extract("value", r"Number of particles\s*=\s*(\d+)", 1).try_cast("long").alias("n"), unit.alias("unit"), h.alias("h"), F.regexp_extract_all("value", F.lit(r"auxiliary\[\d+\]\s*=\s*(\S+)"), 1).alias("names"), F.regexp_like("value", F.lit(r"(?m)^entry_count")).alias("extended"))
    rows = lines(spark, path).filter(~F.col("line").rlike(r"=|^\s*(#|\.NO_VELOCITY|$)")).withColumn("v", _words()).join(head, "file")
    w = Window.partitionBy("file").orderBy("no")
    rows = rows.withColumns({"mass": F.last(F.when(F.size("v") == 1, _at(1).try_cast("double")), True).over(w), "species": F.last(F.when((F.size("v") == 1) & _at(1).try_cast("double").isNull(), _at(1)), True).over(w)})
    rows = rows.filter(F.size("v") > 2)
    rows = rows.withColumns({"mass": F.when(F.col("extended"), F.col("mass")).otherwise(_at(1).try_cast("double")), "species": F.when(F.col("extended"), F.col("species")).otherwise(_at(2)), "p": F.when(F.col("extended"), F.col("v")).otherwise(F.slice("v", 3, 1_000))})
    s = [_at(k, "p").try_cast("double") for k in (1, 2, 3)]
    put = [F.col("unit") * sum((s[a] * F.element_at("h", 3 * a + d + 1) for a in range(3)), F.lit(0.0)) for d in range(3)]
    rest = F.transform(F.slice("p", 4, 1_000), lambda x: x.try_cast("double"))
    return rows.select("file", (F.row_number().over(w) - 1).cast("long").alias("idx"), "mass", "species", vec(*put).alias("position"), rest.alias("rest")), head.drop("extended")


BOHR = 0.52917721067


def _cube_heads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    t = lines(spark, path).withColumn("v", _words())
    d = lambda k: _at(k).try_cast("double")
    head = t.filter(F.col("no").between(2, 5)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", d(1).alias("n"), F.array(d(2), d(3), d(4)).alias("side")))).alias("h"))
    of = lambda k: F.col("h")[k]["n"]
    unit = F.when((of(1) < 0) | (of(2) < 0) | (of(3) < 0), 1.0).otherwise(BOHR)
    return t, head.select("file", "h", F.abs(of(0)).cast("int").alias("atoms"), (of(0) < 0).alias("table"), *[F.abs(of(k)).cast("int").alias(c) for k, c in ((1, "nx"), (2, "ny"), (3, "nz"))], unit.alias("unit"))


def cube(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (file, idx, atomic_number, position) and grid values (file, x, y, z, value, component, name) of volume files, lengths in Angstrom.

    Positive numbers of voxels mean lengths in Bohr; one negative number is enough for
    Angstrom.  A negative number of atoms announces a table of fields: their
    number and labels, by which components are named; a single field has component 0 and no name.
    """
    t, head = _cube_heads(spark, path)
    t = t.join(head.drop("h"), "file")
    atoms = t.filter((F.col("no") >= 6) & (F.col("no") < 6 + F.col("atoms")))
    atoms = atoms.select("file", (F.col("no") - 6).cast("long").alias("idx"), _at(1).try_cast("int").alias("atomic_number"), vec(*[_at(k).try_cast("double") * F.col("unit") for k in (3, 4, 5)]).alias("position"))
    w = Window.partitionBy("file").orderBy("no")
    flat = t.filter((F.col("no") >= 6 + F.col("atoms")) & (F.length(F.trim("line")) > 0)).select("file", "no", "v", "ny", "nz", "table", (F.sum(F.size("v")).over(w) - F.size("v")).alias("before"))
    words = flat.select("file", "ny", "nz", "table", "before", F.posexplode("v").alias("k", "word")).withColumn("at", F.col("before") + F.col("k"))
    fields = words.filter("table AND at = 0").select("file", F.col("word").try_cast("int").alias("m"))
    words = words.join(fields, "file", "left").withColumns({"m": F.coalesce("m", F.lit(1)), "skip": F.when(F.col("table"), F.coalesce("m", F.lit(1)) + 1).otherwise(0)})
    names = words.filter((F.col("at") > 0) & (F.col("at") < F.col("skip"))).select("file", (F.col("at") - 1).cast("int").alias("component"), F.concat(F.lit("MO"), "word").alias("name"))
    values = words.filter(F.col("at") >= F.col("skip")).withColumn("at", F.col("at") - F.col("skip")).withColumns({"component": F.expr("int(at % m)"), "cell": F.expr("at div m")})
    grid = values.select("file", F.expr("int(cell div (ny * nz))").alias("x"), F.expr("int((cell div nz) % ny)").alias("y"), F.expr("int(cell % nz)").alias("z"), F.col("word").try_cast("double").alias("value"), "component")
    return atoms, grid.join(names, ["file", "component"], "left").select("file", "x", "y", "z", "value", "component", "name")


def cube_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, shape, origin, vectors) of volume files: the cell's origin and its three vectors (nine numbers), periodic in each direction."""
    _, head = _cube_heads(spark, path)
    scaled = lambda a, n: F.transform(a, lambda x: x * n * F.col("unit"))
    side = [scaled(F.col("h")[k]["side"], F.abs(F.col("h")[k]["n"])) for k in (1, 2, 3)]
    return head.select("file", F.array("nx", "ny", "nz").alias("shape"), scaled(F.col("h")[0]["side"], F.lit(1.0)).alias("origin"), F.concat(*side).alias("vectors"))


def xsf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structure files with sections: atoms (file, frame, idx, species, position, force), cells (file, frame, vectors: nine numbers) and grids (file, name, x, y, z, value).

    A section lasts until the next key word.  Species are names or atomic
    numbers, as written; files of one frame have frame 0.
    """
    t = lines(spark, path).withColumn("v", _words()).filter(~F.col("line").rlike(r"^\s*(#|$)"))
    word = F.upper(_at(1))
    key = word.rlike(r"^(ATOMS|PRIMCOORD|PRIMVEC|CONVVEC|CONVCOORD|CRYSTAL|SLAB|POLYMER|MOLECULE|ANIMSTEPS|DIM-GROUP|(BEGIN_|END_)?(BLOCK_)?DATAGRID.*|(BEGIN|END)_.*)$")
    w = Window.partitionBy("file").orderBy("no")
    t = t.withColumn("s", F.last(F.when(key, F.struct(F.col("no").alias("no"), word.alias("word"), _at(1).alias("written"), F.coalesce(_at(2).try_cast("int") - 1, F.lit(0)).alias("frame"))), True).over(w))
    # blank lines and comments do not count
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("file", "s.no").orderBy("no")) - 1).filter("s IS NOT NULL AND k > 0")
    d = lambda k: _at(k).try_cast("double")
    skipped = F.when(F.col("s.word") == "ATOMS", 1).when(F.col("s.word") == "PRIMCOORD", 2)
    atoms = t.filter((F.col("k") >= skipped) & F.size("v").isin(4, 7))
    atoms = atoms.select("file", "s.frame", (F.col("k") - skipped).cast("long").alias("idx"), _at(1).alias("species"), vec(d(2), d(3), d(4)).alias("position"), F.when(F.size("v") == 7, vec(d(5), d(6), d(7))).alias("force"))
    sides = t.filter((F.col("s.word") == "PRIMVEC") & (F.col("k") <= 3)).groupBy("file", "s.frame").agg(F.array_sort(F.collect_list(F.struct("k", F.array(d(1), d(2), d(3)).alias("side")))).alias("h"))
    cells = sides.select("file", "frame", F.flatten(F.col("h.side")).alias("vectors"))
    grid = t.filter(F.col("s.word").rlike("^(BEGIN_)?DATAGRID_3D_")).withColumn("section", F.col("s.no"))
    shape = grid.filter("k = 1").select("file", "section", _at(1).try_cast("int").alias("nx"), _at(2).try_cast("int").alias("ny"))
    inner = Window.partitionBy("file", "section").orderBy("no")
    flat = grid.filter("k > 5").withColumn("before", F.sum(F.size("v")).over(inner) - F.size("v"))
    values = flat.select("file", "section", F.regexp_replace("s.written", "(?i)^(BEGIN_)?DATAGRID_3D_", "").alias("name"), "before", F.posexplode("v").alias("p", "value")).join(shape, ["file", "section"]).withColumn("at", F.col("before") + F.col("p"))
    return atoms, cells, values.select("file", "name", F.expr("int(at % nx)").alias("x"), F.expr("int(at div nx % ny)").alias("y"), F.expr("int(at div (nx * ny))").alias("z"), F.col("value").try_cast("double").alias("value"))
