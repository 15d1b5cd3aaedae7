"""Isosurfaces of fields on voxel grids as triangle tables.

Voxels are dealt to blocks, with the next layer of voxels beside each block, so a
block's cubes are contoured without any other block; memory is bounded by the
block, and only voxels at a block's lower faces travel twice.  A vertex is named
by the grid edge that it lies on, so blocks agree on names without a join.

The cases are not a stored table: on each face of a cube the crossings are paired
by the signs of its corners, an ambiguous face by its saddle value, which both
cubes of the face see alike; the pairs close to loops and each loop is
triangulated.  So the mesh is closed for any field.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell
from mesolite.operators.fields import gaussian_density
from mesolite.operators.mesh import FACES

BLOCK = 32
LOWEST = np.finfo(np.float64).min
#: Corner c of a cube is at (c & 1, c >> 1 & 1, c >> 2); a grid edge is a lower corner and an axis.
CORNERS = np.array([[c & 1, c >> 1 & 1, c >> 2] for c in range(8)])
EDGES = [(c, a) for a in range(3) for c in range(8) if not CORNERS[c][a]]
_BETWEEN = {frozenset((c, c | 1 << a)): k for k, (c, a) in enumerate(EDGES)}


def _quads() -> list[list[int]]:
    """The corners of each face, counterclockwise from outside."""
    out = []
    for a in range(3):
        b, c = 1 << (a + 1) % 3, 1 << (a + 2) % 3
        out += [[0, c, b | c, b], [1 << a | x for x in (0, b, b | c, c)]]
    return out


QUADS = _quads()


@lru_cache(maxsize=None)
def triangles(case: int, joined: int) -> np.ndarray:
    """(n, 3) edges of the triangles of a cube: bit c of ``case`` is set for a corner inside, bit f of ``joined`` where the inside corners of an ambiguous face f hang together."""
    inside = [bool(case >> c & 1) for c in range(8)]
    after = {}
    for f, quad in enumerate(QUADS):
        edge = lambda i: _BETWEEN[frozenset((quad[i % 4], quad[(i + 1) % 4]))]  # noqa: E731, B023
        leaves = [i for i in range(4) if inside[quad[i]] and not inside[quad[(i + 1) % 4]]]
        enters = [i for i in range(4) if not inside[quad[i]] and inside[quad[(i + 1) % 4]]]
        for i in leaves:
            # the crossing that cuts off the same inside corners, or the same outside ones
            step = 1 if joined >> f & 1 and len(leaves) == 2 else -1
            k = next(j % 4 for j in range(i + step, i + 5 * step, step) if j % 4 in enters)
            after[edge(k)] = edge(i)
    out, left = [], set(after)
    while left:
        loop = [min(left)]
        while after[loop[-1]] != loop[0]:
            loop.append(after[loop[-1]])
        left -= set(loop)
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def _saddles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of six faces of cubes with corner values ``v`` (n, 8) over the level are ambiguous with inside corners that hang together."""
    s = v >= 0
    bits = np.zeros(len(v), np.int64)
    for f, q in enumerate(QUADS):
        even, odd = s[:, q[0]] & s[:, q[2]] & ~s[:, q[1]] & ~s[:, q[3]], s[:, q[1]] & s[:, q[3]] & ~s[:, q[0]] & ~s[:, q[2]]
        with np.errstate(over="ignore"):
            turn = v[:, q[0]] * v[:, q[2]] - v[:, q[1]] * v[:, q[3]]
        bits |= ((even & (turn > 0)) | (odd & (turn < 0))).astype(np.int64) << f
    return (s << np.arange(8)).sum(1), bits


def _part(v0: np.ndarray, v1: np.ndarray) -> np.ndarray:
    """Where between two values the level 0 lies, 0 to 1."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        t = v0 / (v0 - v1)
    return np.where(np.isfinite(t), np.clip(t, 0.0, 1.0), np.where(np.abs(v0) > np.abs(v1), 1.0, 0.0))


def contour(value: np.ndarray, cubes: tuple[int, int, int], fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triangles of a block: lower voxels (n, 3, 3), axes (n, 3), corners (n, 3, 3) in voxels and fields (n, 3, m) of their corners."""
    view = [value[x : x + cubes[0], y : y + cubes[1], z : z + cubes[2]] for x, y, z in CORNERS]
    inside = np.stack([v >= 0 for v in view]).sum(0)
    at = np.argwhere((inside > 0) & (inside < 8))
    v = np.stack([value[tuple((at + c).T)] for c in CORNERS], 1).reshape(-1, 8)
    case, bits = _saddles(v)
    lows, axes = [np.zeros((0, 3, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    for c, b in np.unique(np.stack([case, bits], 1), axis=0):
        who, t = at[(case == c) & (bits == b)], triangles(int(c), int(b))
        low, axis = np.array([CORNERS[EDGES[e][0]] for e in t.ravel()]).reshape(-1, 3, 3), np.array([EDGES[e][1] for e in t.ravel()]).reshape(-1, 3)
        lows.append((who[:, None, None] + low[None]).reshape(-1, 3, 3))
        axes.append(np.broadcast_to(axis, (len(who), *axis.shape)).reshape(-1, 3))
    low, axis = np.concatenate(lows), np.concatenate(axes)
    high = low + np.eye(3, dtype=np.int64)[axis]
    a, b = (value[tuple(np.moveaxis(x, -1, 0))] for x in (low, high))
    t = _part(a, b)
    of = np.zeros((*t.shape, len(fields)))
    for k, f in enumerate(fields):
        x, y = (f[tuple(np.moveaxis(p, -1, 0))] for p in (low, high))
        x, y = np.where(np.isnan(x), y, x), np.where(np.isnan(y), x, y)
        of[..., k] = x + (y - x) * t
    return low, axis, low + np.eye(3)[axis] * t[..., None], of


def filled(value: np.ndarray, cubes: tuple[int, int, int]) -> float:
    """The volume inside, in voxels, of the polyhedra that the triangles bound."""
    view = np.stack([value[x : x + cubes[0], y : y + cubes[1], z : z + cubes[2]] for x, y, z in CORNERS], -1).reshape(-1, 8)
    n = (view >= 0).sum(1)
    cut = view[(n > 0) & (n < 8)]
    total = float((n == 8).sum())
    if len(cut):
        low, _, corners, _ = contour_of(cut)
        total += float(np.einsum("ni,ni->n", corners[:, 0], np.cross(corners[:, 1], corners[:, 2])).sum()) / 6
        # the parts of the three upper faces that are inside, a third each: the lower ones go through the origin
        for f in (1, 3, 5):
            total += _covered(cut[:, QUADS[f]]).sum() / 3
    return total


def contour_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``contour`` of separate cubes (n, 8), each with its own origin."""
    case, bits = _saddles(v)
    corners = []
    for c, b in np.unique(np.stack([case, bits], 1), axis=0):
        own, t = v[(case == c) & (bits == b)], triangles(int(c), int(b))
        low = np.array([EDGES[e][0] for e in t.ravel()], int)
        axis = np.array([EDGES[e][1] for e in t.ravel()], int)
        part = _part(own[:, low], own[:, low | 1 << axis])
        corners.append((CORNERS[low][None] + np.eye(3)[axis][None] * part[..., None]).reshape(-1, 3, 3))
    return None, None, np.concatenate(corners), None


def _covered(v: np.ndarray) -> np.ndarray:
    """The area of a unit square that is inside, from the values (n, 4) around it."""
    at = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    s = v >= 0
    nxt = np.roll(v, -1, 1)
    t = _part(v, nxt)
    cross = at[None] + t[..., None] * (np.roll(at, -1, 0) - at)[None]
    points = np.stack([np.broadcast_to(at, cross.shape), cross], 2).reshape(len(v), 8, 2)
    there = np.stack([s, s != np.roll(s, -1, 1)], 2).reshape(len(v), 8)
    # a point that isn't there is the next one that is
    for _ in range(2):
        for k in range(7, -1, -1):
            points[:, k] = np.where(there[:, k, None], points[:, k], points[:, (k + 1) % 8])
            there[:, k] |= there[:, (k + 1) % 8]
    nx = np.roll(points, -1, 1)
    area = 0.5 * (points[..., 0] * nx[..., 1] - points[..., 1] * nx[..., 0]).sum(1)
    area = np.where(s.any(1), area, 0.0)
    with np.errstate(over="ignore"):
        turn = v[:, 0] * v[:, 2] - v[:, 1] * v[:, 3]
    for k, apart in ((0, s[:, 0] & s[:, 2] & ~s[:, 1] & ~s[:, 3] & ~(turn > 0)), (1, s[:, 1] & s[:, 3] & ~s[:, 0] & ~s[:, 2] & ~(turn < 0))):
        alone = sum(0.5 * t[:, i] * (1 - t[:, i - 1]) for i in (k, k + 2))
        area = np.where(apart, alone, area)
    return area


def _blocks(grid: DataFrame, cell: Cell, shape: tuple[int, int, int], columns: list[str]) -> DataFrame:
    """Voxels with the block (b0, b1, b2) and the place in it (l0, l1, l2); those of a block's lower faces also beside the block before."""
    out = grid.select("frame", *columns, *[(F.col(f"v{c}") + (0 if cell.periodic[d] else 1)).cast("int").alias(f"p{d}") for d, c in enumerate("xyz")])
    for d in range(3):
        length = shape[d] if cell.periodic[d] else shape[d] + 2
        last = (length - 1) // BLOCK
        p = F.col(f"p{d}")
        own = F.struct((p / BLOCK).cast("int").alias(f"b{d}"), (p % BLOCK).alias(f"l{d}"))
        before = F.struct(F.when(p == 0, last).otherwise((p / BLOCK).cast("int") - 1).alias(f"b{d}"), F.when(p == 0, length - last * BLOCK).otherwise(BLOCK).alias(f"l{d}"))
        out = out.select("*", F.inline(F.when(p % BLOCK == 0, F.array(own, before)).otherwise(F.array(own))))
    return out.drop("p0", "p1", "p2")


def _kernel(cell: Cell, shape: tuple[int, int, int], fields: list[str], level: float, run):
    """A function of a block's rows for ``applyInArrow``: ``run(key, origin, value, cubes, arrays)``."""
    length = [shape[d] if cell.periodic[d] else shape[d] + 2 for d in range(3)]

    def of(key, table):
        frame, *block = (k.as_py() for k in key)
        origin = np.array(block) * BLOCK
        cubes = tuple(int(min(BLOCK, (length[d] if cell.periodic[d] else length[d] - 1) - origin[d])) for d in range(3))
        at = tuple(table.column(f"l{d}").to_numpy() for d in range(3))
        value, arrays = np.full([BLOCK + 1] * 3, LOWEST), []
        given = np.nan_to_num(table.column("value").to_numpy().astype(float) - level, nan=LOWEST, neginf=LOWEST, posinf=-LOWEST)
        value[at] = given
        for f in fields:
            a = np.full([BLOCK + 1] * 3, np.nan)
            a[at] = table.column(f).to_numpy()
            arrays.append(a)
        return run(frame, origin, value, cubes, arrays)

    return of


def _places(cell: Cell, shape: tuple[int, int, int], centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """Origin and step of grid points in space, a step in each column."""
    n = np.array([shape[d] if centred or cell.periodic[d] else max(shape[d] - 1, 1) for d in range(3)], float)
    pad = np.array([0.0 if cell.periodic[d] else 1.0 for d in range(3)])
    step = cell.array / n
    return np.array(cell.origin) + step @ ((0.5 if centred else 0.0) - pad), step


def isosurface(grid: DataFrame, cell: Cell, shape: tuple[int, int, int], level: float, value: str = "value", fields: tuple[str, ...] = (), centred: bool = True) -> DataFrame:
    """Triangles (frame, face, a, b, c, corners, values) of the surface where the field of (frame, vx, vy, vz, ``value``) passes ``level``.

    Normals point to lower values.  ``a``, ``b``, ``c`` name vertices; ``corners`` are their
    places, in one piece even across periodic faces; ``values`` are the corners' interpolated ``fields``.
    Voxels are points at the middle of their boxes, or, without ``centred``, as
    ``fields.voxels`` lays them.  Beyond the faces of a cell that aren't periodic
    the field counts as lowest, so the surface is closed there.  Null and NaN
    count as lowest too; a voxel that stands twice has either value.
    """
    if cell.is2d:
        raise ValueError("isosurfaces need a three-dimensional grid")
    zero, step = _places(cell, shape, centred)
    length = np.array([shape[d] if cell.periodic[d] else shape[d] + 2 for d in range(3)])
    mirrored = np.linalg.det(step) < 0
    names = [f"field{k}" for k in range(len(fields))]

    def run(frame, origin, values, cubes, arrays):
        low, axis, corners, of = contour(values, cubes, arrays)
        keys = (low + origin) % length
        keys = ((keys[..., 0] * length[1] + keys[..., 1]) * length[2] + keys[..., 2]) * 3 + axis
        if mirrored:
            keys, corners, of = keys[:, ::-1], corners[:, ::-1], of[:, ::-1]
        # triangles without area, where the surface goes through a grid point, stay: they keep the mesh closed
        where = (corners + origin) @ step.T + zero
        n = len(keys)
        face = (int((origin / BLOCK) @ [(length[1] // BLOCK + 1) * (length[2] // BLOCK + 1), length[2] // BLOCK + 1, 1]) << 32) + np.arange(n)
        points = pa.StructArray.from_arrays([pa.array(where[..., d].ravel()) for d in range(3)], names=["x", "y", "z"])
        threes = pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(3 * n + 1, dtype=np.int32) * len(fields)), pa.array(of.ravel(), pa.float64()))
        return pa.Table.from_arrays([pa.array([frame] * n, pa.int32()), pa.array(face), *[pa.array(np.ascontiguousarray(keys[:, k])) for k in range(3)], pa.ListArray.from_arrays(threes, points), pa.ListArray.from_arrays(threes, inner)], names=["frame", "face", "a", "b", "c", "corners", "values"])

    rows = _blocks(grid.select(F.col("frame").cast("int").alias("frame"), "vx", "vy", "vz", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"), *[F.col(c).cast("double").alias(k) for c, k in zip(fields, names, strict=True)]), cell, shape, ["value", *names])
    return rows.groupBy("frame", "b0", "b1", "b2").applyInArrow(_kernel(cell, shape, names, level, run), FACES + ", values array<array<double>>")


def volume_inside(grid: DataFrame, cell: Cell, shape: tuple[int, int, int], level: float, value: str = "value", centred: bool = True) -> DataFrame:
    """(frame, volume) of the bodies that ``isosurface`` bounds, holes taken off, in periodic cells too."""
    _, step = _places(cell, shape, centred)
    unit = abs(float(np.linalg.det(step)))

    def run(frame, origin, values, cubes, arrays):
        return pa.table({"frame": pa.array([frame], pa.int32()), "volume": [filled(values, cubes) * unit]})

    rows = _blocks(grid.select(F.col("frame").cast("int").alias("frame"), "vx", "vy", "vz", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value")), cell, shape, ["value"])
    return rows.groupBy("frame", "b0", "b1", "b2").applyInArrow(_kernel(cell, shape, [], level, run), "frame int, volume double").groupBy("frame").agg(F.sum("volume").alias("volume"))


def gaussian_surface(df: DataFrame, cell: Cell, shape: tuple[int, int, int], radius: float, level: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """The surface of the particles' Gaussian densities, and the grid that it was taken from."""
    grid = gaussian_density(df, cell, shape, radius)
    return isosurface(grid, cell, shape, level, "density", centred=False), grid


def field_histogram(grid: DataFrame, value: str = "value", bins: int = 64) -> DataFrame:
    """(frame, bin, x, count) of the field's values over each frame's range, as shown beside an isosurface."""
    rows = grid.select("frame", F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    range_ = rows.groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))).otherwise(0)
    found = rows.join(range_, "frame").groupBy("frame", at.alias("bin")).agg(F.count("*").alias("count"))
    every = range_.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, ["frame", "bin"], "left").select("frame", "bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("x"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
