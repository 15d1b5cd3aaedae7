"""Correlation functions of two properties over all distances, by Fourier transforms of their grids.

The transform is dealt out by planes: one pass holds a plane (y, z) for each x
and transforms two directions, the next holds a plane (x, z) for each wave
number along y, finishes the transform, multiplies and goes back along x, the
last goes back along y and z.  A task holds one plane of the grid; the grid as a
whole is never in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.storage import written

RADIAL = None
_ROW = "frame int, x int, y int, spectrum binary, one binary, two binary, three binary"


def grid_shape(cell: Cell, spacing: float) -> tuple[int, int, int]:
    return tuple(max(1, int(np.linalg.norm(cell.array[:, d]) / spacing)) for d in range(3))


def property_grid(df: DataFrame, cell: Cell, shape: tuple[int, int, int], a: Column, b: Column, window: bool = False) -> DataFrame:
    """(frame, x, y, z, one, two, density): sums over the particles of each voxel that holds some.

    Null and NaN count as 0.  Particles beyond a face that isn't periodic are left out; with
    ``window`` those near it weigh less, by a cosine of mean square one.
    """
    r = cell.reduced(F.col("position"))
    weight = F.lit(1.0)
    rows = df.select(F.col("frame").cast("int").alias("frame"), *[x.alias(f"r{d}") for d, x in enumerate(r)], a.cast("double").alias("a__"), b.cast("double").alias("b__"))
    for d in range(3):
        at = F.floor(F.col(f"r{d}") * shape[d]).cast("int")
        rows = rows.withColumn("xyz"[d], F.pmod(at, F.lit(shape[d])) if cell.periodic[d] else at)
        if not cell.periodic[d]:
            rows = rows.filter(F.col("xyz"[d]).between(0, shape[d] - 1))
            if window:
                weight = weight * math.sqrt(2 / 3) * (1 - F.cos(2 * math.pi * F.col(f"r{d}")))
    sound = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)).otherwise(0.0)
    return rows.withColumn("w__", weight).groupBy("frame", "x", "y", "z").agg(F.sum(F.col("w__") * sound("a__")).alias("one"), F.sum(F.col("w__") * sound("b__")).alias("two"), F.sum("w__").alias("density"))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def _unpacked(table: pa.Table, column: str) -> np.ndarray:
    rows = table.column(column).to_pylist()
    return np.frombuffer(b"".join(rows), np.complex128).reshape(len(rows), -1)


def _rows(frame: int, x: np.ndarray, y: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array([frame] * len(x), pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), *map(_packed, arrays)], names=[c.split()[0] for c in _ROW.split(", ")])


def spectra(grid: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Written rows (frame, x, y, ...) of whole lines along z.

    ``spectrum`` is the product of the transforms of one and two (the second
    conjugate) at wave numbers x, y; ``one`` is that product and ``two`` that of density with
    itself after the way back along x, so at place x and wave number y.
    """
    nx, ny, nz = shape

    def planes(key, table):
        at = table.column("y").to_numpy(), table.column("z").to_numpy()
        out = []
        for c in ("one", "two", "density"):
            plane = np.zeros((ny, nz))
            plane[at] = table.column(c).to_numpy()
            out.append(np.fft.fft2(plane))
        return _rows(key[0].as_py(), np.full(ny, key[1].as_py()), np.arange(ny), out[0], out[0], out[1], out[2])

    def across(key, table):
        whole = []
        for c in ("one", "two", "three"):
            plane = np.zeros((nx, nz), complex)
            plane[table.column("x").to_numpy()] = _unpacked(table, c)
            whole.append(np.fft.fft(plane, axis=0))
        product, density = whole[0] * whole[1].conj(), whole[2] * whole[2].conj()
        back = lambda p: np.fft.ifft(p, axis=0) * nx
        return _rows(key[0].as_py(), np.arange(nx), np.full(nx, key[1].as_py()), product, back(product), back(density), np.zeros((nx, 0), complex))

    first = grid.groupBy("frame", "x").applyInArrow(planes, _ROW)
    return written(first.select("frame", "x", "y", F.lit(b"").alias("spectrum"), "one", "two", "three").groupBy("frame", "y").applyInArrow(across, _ROW).drop("three"), "spectra")


def _signed(i: np.ndarray, n: int) -> np.ndarray:
    """Wave numbers and places around zero."""
    return (i + n // 2) % n - n // 2


def grid_correlation(df: DataFrame, cell: Cell, a: Column, b: Column, spacing: float = 3.0, window: bool = False, axis: int | None = RADIAL) -> tuple[DataFrame, DataFrame]:
    """C(q) as (frame, bin, q, correlation, count), and (frame, bin, r, correlation, rdf, count) of C(r) and g(r).

    Radial means, without the origin, up to half the least distance of opposite
    faces.  With an ``axis`` C(q) is averaged along it and bins are pairs of the other two
    directions' wave numbers.  Bins without a value are left out.
    """
    if cell.is2d:
        raise ValueError("grid correlations need a three-dimensional cell")
    shape = grid_shape(cell, spacing)
    nx, ny, nz = shape
    across = float(min(cell.face_distances()))
    lines = spectra(property_grid(df, cell, shape, a, b, window), shape)
    inverse, matrix = cell.inverse, cell.array
    q_bins = int(1 / (2 * (1 / across) * spacing)) if axis is RADIAL else shape[(axis + 1) % 3] * shape[(axis + 2) % 3]
    r_bins = int(across / (2 * spacing))

    def wave_bins(batches):
        for t in batches:
            x, y = t.column("x").to_numpy()[:, None], t.column("y").to_numpy()[:, None]
            z = np.arange(nz)[None]
            value = _unpacked(t, "spectrum").real
            if axis is RADIAL:
                k = np.stack(np.broadcast_arrays(_signed(x, nx), _signed(y, ny), _signed(z, nz)), -1) @ inverse
                at = np.floor(np.linalg.norm(k, axis=-1) * across).astype(int)
                at = np.where((x == 0) & (y == 0) & (z == 0), q_bins, at)
            else:
                i = np.broadcast_arrays(x, y, z)
                at = i[(axis + 2) % 3] + shape[(axis + 2) % 3] * i[(axis + 1) % 3]
            yield from _binned(t.column("frame").to_numpy(), at, q_bins, value, value)

    def place_bins(key, table):
        y = table.column("y").to_numpy()
        grids = []
        for c in ("one", "two"):
            plane = np.zeros((ny, nz), complex)
            plane[y] = _unpacked(table, c)
            grids.append((np.fft.ifft2(plane) * (ny * nz)).real)
        x = key[1].as_py()
        i = np.stack(np.broadcast_arrays(_signed(np.array(x), nx) / nx, (_signed(np.arange(ny), ny) / ny)[:, None], (_signed(np.arange(nz), nz) / nz)[None]), -1)
        at = np.floor(np.linalg.norm(i @ matrix.T, axis=-1) / (across / (2 * r_bins))).astype(int) if r_bins else np.zeros((ny, nz), int)
        if x == 0:
            at[0, 0] = r_bins
        return pa.Table.from_batches(list(_binned(np.full(ny, key[0].as_py()), at, r_bins, *grids)), schema=_BINS)

    n = df.groupBy(F.col("frame").cast("int").alias("frame")).agg(F.count("*").cast("double").alias("n"))
    schema = "frame int, bin int, first double, second double, count long"
    total = lambda t: t.groupBy("frame", "bin").agg(F.sum("first").alias("first"), F.sum("second").alias("second"), F.sum("count").alias("count")).join(n, "frame")
    q = total(lines.select("frame", "x", "y", "spectrum").mapInArrow(wave_bins, schema))
    step = 2 * math.pi / across
    q = q.select("frame", "bin", ((F.col("bin") + 0.5) * step if axis is RADIAL else F.lit(None).cast("double")).alias("q"), (F.col("first") * cell.volume / (F.col("n") * F.col("n") * F.col("count"))).alias("correlation"), "count")
    r = total(lines.select("frame", "x", "y", "one", "two").groupBy("frame", "x").applyInArrow(place_bins, schema))
    mean = lambda c: F.col(c) / (F.col("n") * F.col("n") * F.col("count"))
    r = r.select("frame", "bin", ((F.col("bin") + 0.5) * (across / (2 * max(r_bins, 1)))).alias("r"), mean("first").alias("correlation"), mean("second").alias("rdf"), "count")
    return q, r


_BINS = pa.schema([("frame", pa.int32()), ("bin", pa.int32()), ("first", pa.float64()), ("second", pa.float64()), ("count", pa.int64())])


def _binned(frames: np.ndarray, at: np.ndarray, bins: int, first: np.ndarray, second: np.ndarray):
    """Sums and counts by frame and bin of rows of lines, bins beyond the last left out."""
    for f in np.unique(frames):
        own = frames == f
        k = np.where(at[own] < bins, at[own], bins).ravel()
        sums = [np.bincount(k, v[own].ravel(), bins + 1)[:bins] for v in (first, second)]
        count = np.bincount(k, minlength=bins + 1)[:bins]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), f, np.int32)), pa.array(some.astype(np.int32)), *[pa.array(s[some]) for s in sums], pa.array(count[some])], schema=_BINS)
