"""Surfaces of solids from particles: the alpha shape of their Delaunay tessellation.

A tetrahedron is solid if its circumsphere is empty and smaller than the probe
sphere.  The centre of that sphere is a corner of the Voronoi cells of its four
particles, no farther from them than the probe's radius, so each particle's list
of neighbours within two radii tells all solid tetrahedra and all their facets
around it: an edge of its cell is a facet, the edge's two ends are the
tetrahedra on both sides.  No tessellation of the whole and no exchange between
blocks is needed; every facet and tetrahedron is given by the least of its
particles.  Positions are shifted by up to 1e-10 of the cell's size, by a hash of
the index, so that all particles see the same decisions in regular lattices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell, vec
from mesolite.operators import mesh
from mesolite.operators.clusters import components
from mesolite.operators.lists import neighbor_lists
from mesolite.operators.polyhedra import bounding_planes, cut_cells, padded
from mesolite.storage import written

TETRAHEDRON, FACET, INNER = range(3)
SCHEMA = "frame int, kind int, a long, b long, c long, tetrahedron long, beside long, volume double, corners array<struct<x: double, y: double, z: double>>"
CHUNK = 128
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _before(own: np.ndarray, ids: np.ndarray, images: np.ndarray) -> np.ndarray:
    """Whether a particle in image 0 comes before others (by id, then image)."""
    x, y, z = np.moveaxis(images, -1, 0)
    later = (x > 0) | ((x == 0) & ((y > 0) | ((y == 0) & (z > 0))))
    return (own < ids) | ((own == ids) & later)


def _names(own: np.ndarray, ids: np.ndarray, images: np.ndarray) -> np.ndarray:
    """A name of four particles (own in image 0, three others) that does not depend on which of them is asked."""
    ids = np.concatenate([own[:, None], ids], 1)
    images = np.concatenate([np.zeros((len(own), 1, 3), np.int64), images], 1)
    order = np.lexsort((images[..., 2], images[..., 1], images[..., 0], ids), axis=1)
    ids, images = np.take_along_axis(ids, order, 1), np.take_along_axis(images, order[:, :, None], 1)
    images = images - images[:, :1]
    h = np.full(len(own), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(4):
        for part, mix in zip((ids[:, k], *images[:, k].T), _MIX, strict=True):
            h = (h ^ part.astype(np.int64).view(np.uint64)) * mix
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _around(b: pa.RecordBatch, radius: float) -> list[pa.RecordBatch]:
    lists = b.column("near")
    ends = lists.offsets.to_numpy()
    flat, count = lists.flatten(), b.num_rows
    row = np.repeat(np.arange(count), np.diff(ends))
    get = lambda c: flat.field(c).to_numpy()
    d = np.stack([get("dx"), get("dy"), get("dz")], 1)
    ids, images = get("j"), np.stack([get("ix"), get("iy"), get("iz")], 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=count))[:-1]])
    length = np.linalg.norm(d, axis=1)
    n, o = padded(row, count, d / length[:, None], length / 2)
    n[np.isinf(n)] = 0
    # just beyond the probe, so that its corners are never solid
    wn, wo = bounding_planes(radius * 1.001)
    m = o.shape[1]
    cells = cut_cells(np.concatenate([n, np.broadcast_to(wn, (count, 6, 3))], 1), np.concatenate([o, np.broadcast_to(wo, (count, 6))], 1), split=0.0)
    own, place = b.column("idx").to_numpy(), np.stack([b.column(f"own_p{c}").to_numpy() for c in "xyz"], 1)
    solid = (np.linalg.norm(cells.corners, axis=1) < radius) & (cells.corner_planes < m).all(1)
    at = lambda cell, plane: first[cell] + plane  # noqa: E731  where a cell's plane stands in the flat list

    three = at(cells.corner_cell[:, None], np.minimum(cells.corner_planes, 0 if not len(d) else m - 1))
    three = np.where(solid[:, None], three, 0) if len(d) else np.zeros((len(solid), 3), int)
    p = cells.corner_cell
    name = np.zeros(len(p), np.int64)
    s = np.flatnonzero(solid)
    name[s] = _names(own[p[s]], ids[three[s]], images[three[s]])
    frame = b.column("frame").to_numpy()

    def rows(kind, cell, b_, c_, tetrahedron, beside, volume, corners):
        k = len(cell)
        points = pa.StructArray.from_arrays([pa.array(corners[..., x].ravel()) for x in range(3)], names=["x", "y", "z"])
        sizes = pa.array(np.arange(k + 1, dtype=np.int32) * corners.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(frame[cell]), pa.array(np.full(k, kind, np.int32)), pa.array(own[cell]), pa.array(b_), pa.array(c_), pa.array(tetrahedron), pa.array(beside), pa.array(volume), pa.ListArray.from_arrays(sizes, points)], names=[x.split()[0] for x in SCHEMA.split(", ")[:8]] + ["corners"])

    none = lambda k: np.zeros(k, np.int64)
    s = s[_before(own[p[s]][:, None], ids[three[s]], images[three[s]]).all(1)]
    e = d[three[s]]
    volume = np.abs(np.linalg.det(e)) / 6 if len(s) else np.zeros(0)
    out = [rows(TETRAHEDRON, p[s], none(len(s)), none(len(s)), name[s], none(len(s)), volume, np.zeros((len(s), 0, 3)))]
    # facets: edges between two neighbours' planes with a solid end, given by the least of the three particles
    x, y = cells.edge_planes.T
    v, w = cells.edge_ends.T
    f = np.flatnonzero((x < m) & (y < m) & (solid[v] | solid[w]))
    q = cells.edge_cell[f]
    two = np.stack([at(q, x[f]), at(q, y[f])], 1)
    least = _before(own[q][:, None], ids[two], images[two]).all(1) if len(f) else np.zeros(0, bool)
    f, q, two, x, y, v, w = f[least], q[least], two[least], x[f][least], y[f][least], v[f][least], w[f][least]
    both = solid[v] & solid[w]
    out.append(rows(INNER, q[both], none(both.sum()), none(both.sum()), name[v[both]], name[w[both]], np.zeros(both.sum()), np.zeros((int(both.sum()), 0, 3))))
    q, two, x, y, v, w = q[~both], two[~both], x[~both], y[~both], v[~both], w[~both]
    end = np.where(solid[v], v, w)
    planes = cells.corner_planes[end]
    fourth = d[at(q, planes.sum(1) - x - y)] if len(q) else np.zeros((0, 3))
    one, other = d[two[:, 0]] if len(q) else fourth, d[two[:, 1]] if len(q) else fourth
    turn = np.einsum("ni,ni->n", np.cross(one, other), fourth) > 0
    two[turn] = two[turn][:, ::-1]
    corners = place[q][:, None] + np.stack([np.zeros((len(q), 3)), d[two[:, 0]] if len(q) else fourth, d[two[:, 1]] if len(q) else fourth], 1)
    out.append(rows(FACET, q, ids[two[:, 0]] if len(q) else none(0), ids[two[:, 1]] if len(q) else none(0), name[end], none(len(q)), np.zeros(len(q)), corners))
    return [r for r in out if r.num_rows]


def apart(b: pa.RecordBatch) -> pa.RecordBatch:
    """The lists without neighbours at distance zero, and without the particles that have none left."""
    near = b.column("near")
    zero = near.flatten().field("d2").to_numpy() == 0
    length = np.diff(near.offsets.to_numpy())
    if zero.any():
        row = np.repeat(np.arange(b.num_rows), length)
        length = np.bincount(row[~zero], minlength=b.num_rows)
        ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        b = b.set_column(b.schema.get_field_index("near"), "near", pa.ListArray.from_arrays(ends, near.flatten().filter(pa.array(~zero))))
    return b.filter(pa.array(length > 0))


def alpha_complex(df: DataFrame, cell: Cell, radius: float = 4.0) -> DataFrame:
    """The solid tetrahedra (kind 0: tetrahedron, volume), their outer facets (kind 1: a, b, c, corners, tetrahedron) and inner ones (kind 2: tetrahedron, beside).

    A particle's neighbours within two radii are held at a time.  Particles at one
    place count as apart by the shift.
    """
    if cell.is2d:
        raise ValueError("surfaces need a three-dimensional cell")
    most = 1e-10 * float(np.linalg.norm(cell.array.sum(1)))
    shift = lambda d: (F.pmod(F.xxhash64("idx", F.lit(d)), F.lit(1 << 30)) / float(1 << 29) - 1) * F.lit(most)
    points = df.select(F.col("frame").cast("int").alias("frame"), "idx", vec(*[F.col(f"position.{c}") + shift(d) for d, c in enumerate("xyz")]).alias("position"))
    points = points.withColumns({f"p{c}": F.col(f"position.{c}") for c in "xyz"})

    def then(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        b = apart(b)
        return [r for at in range(0, b.num_rows, CHUNK) for r in _around(b.slice(at, CHUNK), radius)]

    # the complex is cut where the lists are made
    return neighbor_lists(points, cell, 2 * radius, own=("px", "py", "pz"), then=then, schema=SCHEMA)


class AlphaShape:
    """A written alpha complex and what is read from it."""

    def __init__(self, df: DataFrame, cell: Cell, radius: float = 4.0, only_selected: bool = False):
        self.cell, self.points = cell, df
        self.complex = written(alpha_complex(df.filter(F.col("selection") != 0) if only_selected else df, cell, radius), "alpha-complex")

    def faces(self, smoothing: int = 8) -> DataFrame:
        """The surface, normals away from the solid, vertices named by particle; with the tetrahedron inside each face."""
        facets = self.complex.filter(F.col("kind") == FACET)
        named = facets.select("frame", F.xxhash64("tetrahedron", "a", "b", "c").alias("face"), "a", "b", "c", "corners", "tetrahedron")
        return mesh.smooth(named, self.cell, smoothing)

    def select_surface(self) -> DataFrame:
        """The particles with selection 1 for corners of the surface, 0 for others."""
        corner = self.complex.filter(F.col("kind") == FACET).select("frame", F.explode(F.array("a", "b", "c")).alias("idx")).distinct().withColumn("selection", F.lit(1))
        return self.points.drop("selection").join(corner, ["frame", "idx"], "left").withColumn("selection", F.coalesce("selection", F.lit(0)))

    def totals(self, smoothing: int = 8) -> DataFrame:
        """(frame, surface_area, solid_volume, empty_volume, solid_fraction); the volumes are those before smoothing."""
        area = mesh.surface_area(self.faces(smoothing))
        volume = self.complex.filter(F.col("kind") == TETRAHEDRON).groupBy("frame").agg(F.sum("volume").alias("solid_volume"))
        frames = self.points.select(F.col("frame").cast("int").alias("frame")).distinct()
        whole = self.cell.volume
        both = frames.join(area, "frame", "left").join(volume, "frame", "left").select("frame", F.coalesce("area", F.lit(0.0)).alias("surface_area"), F.coalesce("solid_volume", F.lit(0.0)).alias("solid_volume"))
        return both.select("*", (F.lit(whole) - F.col("solid_volume")).alias("empty_volume"), (F.col("solid_volume") / whole).alias("solid_fraction"))

    def regions(self, smoothing: int = 8) -> DataFrame:
        """(frame, region, volume, surface_area, tetrahedra): solid bodies, connected through facets and named by their least tetrahedron."""
        solid = self.complex.filter(F.col("kind") == TETRAHEDRON).select("frame", F.col("tetrahedron").alias("idx"), "volume")
        links = self.complex.filter(F.col("kind") == INNER).select("frame", F.col("tetrahedron").alias("i"), F.col("beside").alias("j"))
        root = written(components(solid, links), "alpha-regions")
        volume = solid.join(root, ["frame", "idx"]).groupBy("frame", F.col("root").alias("region")).agg(F.sum("volume").alias("volume"), F.count("*").alias("tetrahedra"))
        areas = mesh.normals(self.faces(smoothing)).join(root.withColumnRenamed("idx", "tetrahedron"), ["frame", "tetrahedron"]).groupBy("frame", F.col("root").alias("region")).agg(F.sum("area").alias("surface_area"))
        return volume.join(areas, ["frame", "region"], "left").select("frame", "region", "volume", F.coalesce("surface_area", F.lit(0.0)).alias("surface_area"), "tetrahedra")
