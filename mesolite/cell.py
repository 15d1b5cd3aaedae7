"""Simulation cells: three vectors, an origin and periodic flags, as literals for column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    """Columns of ``matrix`` are the cell vectors."""

    matrix: tuple[tuple[float, float, float], ...]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pbc: tuple[bool, bool, bool] = (True, True, True)
    is2d: bool = False

    @staticmethod
    def box(x: float, y: float, z: float, pbc=(True, True, True), origin=(0.0, 0.0, 0.0), is2d: bool = False) -> Cell:
        return Cell(((float(x), 0.0, 0.0), (0.0, float(y), 0.0), (0.0, 0.0, float(z))), tuple(map(float, origin)), tuple(pbc), is2d)

    @property
    def array(self) -> np.ndarray:
        return np.array(self.matrix, float)

    @property
    def inverse(self) -> np.ndarray:
        if abs(np.linalg.det(self.array)) < 1e-12:
            raise ValueError("the cell is degenerate")
        return np.linalg.inv(self.array)

    @property
    def periodic(self) -> tuple[bool, bool, bool]:
        """2D cells are never periodic along z."""
        return (self.pbc[0], self.pbc[1], self.pbc[2] and not self.is2d)

    @property
    def volume(self) -> float:
        """Volume, or the area of a 2D cell."""
        m = self.array
        return float(np.linalg.norm(np.cross(m[:, 0], m[:, 1]))) if self.is2d else abs(float(np.linalg.det(m)))

    def face_distances(self) -> np.ndarray:
        """Distances between opposite faces."""
        return 1.0 / np.linalg.norm(self.inverse, axis=1)

    def reduced(self, p: Column) -> list[Column]:
        """Cell coordinates of a point struct (x, y, z)."""
        return self._parts([p[c] - F.lit(o) for c, o in zip("xyz", self.origin, strict=True)])

    def reduced_vector(self, v: Column) -> list[Column]:
        return self._parts([v[c] for c in "xyz"])

    def _parts(self, d: list[Column]) -> list[Column]:
        """Parts of the cell vectors; along the axes by division, which is rounded once: half a cell is exactly that."""
        inverse = self.inverse
        if np.count_nonzero(self.array) == 3 and self.array.diagonal().all():
            return [v / F.lit(self.matrix[k][k]) for k, v in enumerate(d)]
        return [linear(row, d) for row in inverse]

    def shift(self, image: list[Column]) -> list[Column]:
        """The translation of an image triple."""
        return [linear(row, image) for row in self.array]


def linear(row, values: list[Column]) -> Column:
    """Sum of products without the terms that are zero."""
    out = None
    for k, v in zip(row, values, strict=True):
        if k == 0:
            continue
        term = v if k == 1 else F.lit(float(k)) * v
        out = term if out is None else out + term
    return F.lit(0.0) if out is None else out


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def image(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
