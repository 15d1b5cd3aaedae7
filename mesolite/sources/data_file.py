"""Data files with sections: header counts, atoms, velocities, masses and the topology lists.

A file is cut into its sections by one regular expression, each section is a
record, and its lines are exploded; no order of lines is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.cell import image, vec
from mesolite.sources.text import whole

#: Fixed values of the format: the columns of each atom style.
STYLES = {
    "atomic": ["id", "type", "x", "y", "z"],
    "charge": ["id", "type", "q", "x", "y", "z"],
    "bond": ["id", "molecule", "type", "x", "y", "z"],
    "angle": ["id", "molecule", "type", "x", "y", "z"],
    "molecular": ["id", "molecule", "type", "x", "y", "z"],
    "full": ["id", "molecule", "type", "q", "x", "y", "z"],
    "sphere": ["id", "type", "diameter", "density", "x", "y", "z"],
    "dipole": ["id", "type", "q", "x", "y", "z", "mux", "muy", "muz"],
}
#: Fixed values of the format: the topology lists and how many atoms each entry names.
LISTS = {"Bonds": 2, "Angles": 3, "Dihedrals": 4, "Impropers": 4}
SECTIONS = ["Atoms", "Velocities", "Masses", *LISTS]


def _sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, hint, body): the header has an empty name; sections that aren't known keep theirs."""
    cut = F.split("value", r"\n(?=[\x20\t]*[A-Z][A-Za-z]+(?:[\x20\t]+[A-Z][A-Za-z]+)*[\x20\t]*(?:#[^\n]*)?(?:\n|$))")
    t = whole(spark, path).select("file", F.posexplode(cut).alias("no", "part"))
    title = F.regexp_extract("part", r"^([^\n]*)", 1)
    name = F.when(F.col("no") == 0, "").otherwise(F.trim(F.regexp_replace(title, "#.*", "")))
    hint = F.trim(F.regexp_extract(title, r"#\s*(\w+)", 1))
    return t.select("file", name.alias("name"), hint.alias("hint"), F.when(F.col("no") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def _rows(sections: DataFrame, name: str) -> DataFrame:
    t = sections.filter(F.col("name") == name).select("file", "hint", F.explode(F.split("body", "\n")).alias("line"))
    return t.select("file", "hint", F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+").alias("v")).filter(F.get("v", F.lit(0)) != "")


def _number(k: int | F.Column, kind: str = "double") -> F.Column:
    return F.get("v", F.lit(k) if isinstance(k, int) else k).try_cast(kind)


def _style(style: str | None) -> F.Column:
    """The given style, else the section's hint, else what the number of columns (less three image flags) says.

    Six columns are molecules where the third one is an integer, else charges.
    """
    if style is not None:
        if style not in STYLES:
            raise ValueError(f"unknown atom style {style}")
        return F.lit(style)
    plain = F.when(F.size("v").isin(5, 8), "atomic").when(F.size("v").isin(7, 10), "full").when(F.size("v").isin(6, 9), F.when(F.get("v", F.lit(2)).rlike(r"^-?\d+$"), "bond").otherwise("charge"))
    return F.when(F.col("hint").isin(*STYLES), F.col("hint")).otherwise(plain)


def read(spark: SparkSession, path: str, style: str | None = None) -> dict[str, DataFrame]:
    """The containers of the files at ``path``: header, atoms, velocities, masses, bonds, angles, dihedrals, impropers.

    header has the counts and the cell (bounds and tilt, 0 where not given).
    Atoms carry ``radius`` (half the diameter) where the style has one and an
    image where three flags follow the style's columns.  Velocities and
    topology lists name atoms by id.  Types outside of 1..n are errors.
    """
    sections = _sections(spark, path)
    head = sections.filter(F.col("name") == "")
    count = lambda word: F.coalesce(F.regexp_extract("body", rf"(?m)^\s*(\d+)\s+{word}\b", 1).try_cast("long"), F.lit(0))
    bound = lambda d, k: F.regexp_extract("body", rf"(?m)^\s*(\S+)\s+(\S+)\s+{d}lo\s+{d}hi", k).try_cast("double")
    tilt = lambda k: F.coalesce(F.regexp_extract("body", r"(?m)^\s*(\S+)\s+(\S+)\s+(\S+)\s+xy\s+xz\s+yz", k).try_cast("double"), F.lit(0.0))
    counts = [count(w).alias(w) for w in ("atoms", "bonds", "angles", "dihedrals", "impropers")] + [count(f"{w} types").alias(f"{w}_types") for w in ("atom", "bond", "angle", "dihedral", "improper")]
    header = head.select("file", *counts, *(bound(d, k).alias(f"{d}{e}") for d in "xyz" for k, e in ((1, "lo"), (2, "hi"))), *(tilt(k).alias(n) for k, n in ((1, "xy"), (2, "xz"), (3, "yz"))))

    def checked(rows: DataFrame, kind: str) -> DataFrame:
        """Rows whose type lies in 1..n of the header; others raise."""
        known = header.select(F.col("file").alias("f__"), F.col(f"{kind}_types").alias("n__"))
        out = rows.join(known, F.col("file") == F.col("f__"), "left")
        bad = ~F.col("type").between(1, F.col("n__"))
        fail = F.raise_error(F.concat(F.lit(f"{kind} type out of range: "), F.col("type").cast("string"))).cast("int")
        return out.withColumn("type", F.when(bad & (F.col("n__") > 0), fail).otherwise(F.col("type"))).drop("f__", "n__")

    atoms = _rows(sections, "Atoms").withColumn("style", _style(style))
    place = lambda c: F.coalesce(*[F.when(F.col("style") == s, F.lit(cols.index(c))) for s, cols in STYLES.items() if c in cols])
    width = F.coalesce(*[F.when(F.col("style") == s, F.lit(len(cols))) for s, cols in STYLES.items()])
    flags = [_number(width + k, "int") for k in range(3)]
    atoms = atoms.select(
        "file",
        _number(place("id"), "long").alias("particle_identifier"),
        _number(place("type"), "int").alias("type"),
        _number(place("molecule"), "long").alias("molecule_identifier"),
        _number(place("q")).alias("charge"),
        (_number(place("diameter")) / 2).alias("radius"),
        vec(*[_number(place(c)) for c in "xyz"]).alias("position"),
        F.when(F.size("v") >= width + 3, image(*flags)).alias("image"),
    )
    out = {"header": header, "atoms": checked(atoms, "atom").withColumnRenamed("type", "particle_type")}
    out["velocities"] = _rows(sections, "Velocities").select("file", _number(0, "long").alias("particle_identifier"), vec(*[_number(k) for k in (1, 2, 3)]).alias("velocity"))
    out["masses"] = _rows(sections, "Masses").select("file", _number(0, "int").alias("particle_type"), _number(1).alias("mass"))
    for name, n in LISTS.items():
        rows = _rows(sections, name).select("file", _number(0, "long").alias("id"), _number(1, "int").alias("type"), F.slice("v", 3, n).cast("array<long>").alias("members"))
        out[name.lower()] = checked(rows, name.lower()[:-1])
    return out


def particles(data: dict[str, DataFrame]) -> DataFrame:
    """Atoms with their velocities (by id) and masses (by type)."""
    out = data["atoms"].join(data["velocities"], ["file", "particle_identifier"], "left")
    return out.join(data["masses"], ["file", "particle_type"], "left")
