"""Coordination polyhedra: convex hulls of bonded neighbours as a triangle table.

Seen from the mean of its points a hull is the polar body of a cell whose planes
stand at the points' inverse distances, so the cells' walk serves here too: each
corner of the polar body is a triangle of the hull.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.operators import mesh
from mesolite.operators.polyhedra import bounding_planes, cut_cells, padded

SCHEMA = mesh.FACES + ", center long"
CHUNK = 512
FAR = 1e6


def hull_triangles(row: np.ndarray, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``count`` sets, and the three points (places in the ragged list), of each outward triangle of the sets' hulls.

    ``row`` names each point's set, in order.  Flat sets have no triangles; flat faces are split.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    n = np.bincount(row, minlength=count)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = np.stack([np.bincount(row, points[:, k], count) for k in range(3)], 1) / np.maximum(n, 1)[:, None]
    p = points - mean[row]
    size = np.linalg.norm(p, axis=1)
    scale = np.zeros(count)
    np.maximum.at(scale, row, size)
    p, size = p / np.maximum(scale, 1e-300)[row][:, None], size / np.maximum(scale, 1e-300)[row]
    inner = size < 1e-9
    normals, offsets = padded(row, count, p / np.maximum(size, 1e-300)[:, None], np.where(inner, np.inf, 1 / np.maximum(size, 1e-300)))
    normals[~np.isfinite(normals)] = 0
    wn, wo = bounding_planes(FAR)
    m = offsets.shape[1]
    cells = cut_cells(np.concatenate([normals, np.broadcast_to(wn, (count, 6, 3))], 1), np.concatenate([offsets, np.broadcast_to(wo, (count, 6))], 1))
    flat = np.bincount(cells.corner_cell, (cells.corner_planes >= m).any(1), count) > 0
    keep = ~flat[cells.corner_cell] & cells.whole[cells.corner_cell]
    which, three = cells.corner_cell[keep], cells.corner_planes[keep]
    three = first[which][:, None] + three
    a, b, c = (p[three[:, k]] for k in range(3))
    odd = np.einsum("ni,ni->n", np.cross(a, b), c) < 0
    three[odd] = three[odd][:, [0, 2, 1]]
    return which, three


def coordination_polyhedra(df: DataFrame, bond_vectors: DataFrame) -> DataFrame:
    """Faces with their ``center``: the hull of each selected particle and its bonded neighbours.

    ``df`` has a selection; ``bond_vectors`` (frame, i, j, dx, dy, dz) both senses of the bonds.
    Particles with fewer than three bonds, or all of them in a plane with the
    particle, have no faces.  Vertices are named by particle; hulls do not share them.
    """
    own = df.filter(F.col("selection") != 0).select("frame", F.col("idx").alias("i"), "position")
    near = bond_vectors.groupBy("frame", "i").agg(F.collect_list(F.struct("j", "dx", "dy", "dz")).alias("near"))
    rows = own.join(near, ["frame", "i"]).filter(F.size("near") >= 3).select(F.col("frame").cast("int").alias("frame"), F.col("i").alias("idx"), *[F.col(f"position.{c}").alias(f"p{c}") for c in "xyz"], F.concat(F.array(F.struct(F.col("i").alias("j"), *[F.lit(0.0).alias(f"d{c}") for c in "xyz"])), "near").alias("near"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                lists = b.column("near")
                ends, flat = lists.offsets.to_numpy(), lists.flatten()
                row = np.repeat(np.arange(b.num_rows), np.diff(ends))
                place = np.stack([b.column(f"p{c}").to_numpy() for c in "xyz"], 1)
                points = np.stack([flat.field(f"d{c}").to_numpy() for c in "xyz"], 1)
                which, three = hull_triangles(row, points, b.num_rows)
                ids, center = flat.field("j").to_numpy(), b.column("idx").to_numpy()[which]
                corners = place[which][:, None] + points[three]
                order = np.argsort(which, kind="stable")
                which, three, center, corners = which[order], three[order], center[order], corners[order]
                step = np.arange(len(which)) - np.searchsorted(which, which)
                structs = pa.StructArray.from_arrays([pa.array(corners[..., k].ravel()) for k in range(3)], names=["x", "y", "z"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(which) + 1, 3, dtype=np.int32)), structs)
                yield pa.RecordBatch.from_arrays([pa.array(b.column("frame").to_numpy()[which]), pa.array(step), *[pa.array(ids[three[:, k]]) for k in range(3)], lists, pa.array(center)], names=["frame", "face", "a", "b", "c", "corners", "center"])

    return rows.mapInArrow(run, SCHEMA)


def polyhedron_table(faces: DataFrame) -> DataFrame:
    """(frame, center, faces, area, volume) of each polyhedron."""
    size = faces.groupBy("frame", "center").agg(F.count("*").alias("faces"))
    return size.join(mesh.surface_area(faces, "center"), ["frame", "center"]).join(mesh.enclosed_volume(faces, "center"), ["frame", "center"])
