"""Bonds: generation from cutoffs and the adjacency of particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell, image
from mesolite.operators.lists import expanded, run_pairs
from mesolite.operators.neighbors import neighbors


def create_bonds(df: DataFrame, cell: Cell, cutoff: float = 3.2, pair_cutoffs: dict[tuple[int, int], float] | None = None, type_col: str = "particle_type", min_cutoff: float = 0.0, molecule_col: str | None = None, existing: DataFrame | None = None, copies: bool = False, length: Column | None = None) -> DataFrame:
    """(frame, a, b, image, length): one bond per pair within the cutoff.

    Of a pair's two directions the one from the lower index stays; a bond of a
    particle with its own image keeps the lexicographically positive image.
    ``pair_cutoffs`` gives cutoffs by unordered pair of types (others form no
    bonds), ``molecule_col`` keeps bonds within molecules, ``existing`` bonds
    are kept and not doubled.  ``copies`` says that many particles share places:
    then pairs of places are found and judged first.  ``length`` replaces the
    root of ``d2``; it is taken once for all bonds of two places.
    """
    most = max(pair_cutoffs.values(), default=cutoff) if pair_cutoffs else cutoff
    rows = df.select("frame", "idx", "position", *([F.col(type_col).alias("t")] if pair_cutoffs else []), *([F.col(molecule_col).alias("m")] if molecule_col else []))
    keep = tuple(c for c in ("t", "m") if c in rows.columns)
    pairs = (run_pairs if copies else neighbors)(rows, cell, most, keep=keep).filter(F.col("d2") >= min_cutoff * min_cutoff)
    if pair_cutoffs:
        limit = F.lit(None).cast("double")
        for (a, b), c in pair_cutoffs.items():
            limit = F.when((F.least("t_i", "t_j") == min(a, b)) & (F.greatest("t_i", "t_j") == max(a, b)), F.lit(float(c) ** 2)).otherwise(limit)
        pairs = pairs.filter(F.col("d2") <= limit)
    if molecule_col:
        pairs = pairs.filter("m_i = m_j")
    sides = ["all_i", "all_j", "same"] if copies else ["i", "j"]
    pairs = pairs.select("frame", *sides, "image", (F.sqrt("d2") if length is None else length).alias("length"))
    zero = image(F.lit(0), F.lit(0), F.lit(0))
    pairs = (expanded(pairs) if copies else pairs).filter((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("image") > zero)))
    new = pairs.select("frame", F.col("i").alias("a"), F.col("j").alias("b"), "image", "length")
    return merge_bonds(existing, new) if existing is not None else new


def _canonical(bonds: DataFrame) -> DataFrame:
    """The same bond always from its lower index."""
    flip = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("image") < image(F.lit(0), F.lit(0), F.lit(0))))
    back = image(*[-F.col(f"image.{c}") for c in "xyz"])
    return bonds.withColumns({"ka": F.least("a", "b"), "kb": F.greatest("a", "b"), "ki": F.when(flip, back).otherwise(F.col("image"))})


def merge_bonds(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two bond tables; a bond counts once in either direction."""
    keys = ["frame", "ka", "kb", "ki"]
    fresh = _canonical(new).dropDuplicates(keys).join(_canonical(existing).select(*keys), keys, "left_anti").drop("ka", "kb", "ki")
    return existing.unionByName(fresh, allowMissingColumns=True)


def adjacency(bonds: DataFrame) -> DataFrame:
    """Both half-bonds of each bond, the image negated for the second."""
    back = image(*[-F.col(f"image.{c}") for c in "xyz"])
    one = bonds.select("frame", F.col("a").alias("i"), F.col("b").alias("j"), "image")
    return one.unionByName(bonds.select("frame", F.col("b").alias("i"), F.col("a").alias("j"), back.alias("image")))
