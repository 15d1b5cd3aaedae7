"""Triangle meshes as tables.

A face is a row (frame, face, a, b, c, corners): three vertex names and the three places
in one piece, so that a face across a periodic boundary isn't torn.  A vertex
that two faces see in different images is one name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.cell import Cell, vec
from mesolite.operators.clusters import components
from mesolite.storage import counted, written

FACES = "frame int, face long, a long, b long, c long, corners array<struct<x: double, y: double, z: double>>"


def _edge(to: int) -> list[F.Column]:
    p, q = F.col("corners")[0], F.col("corners")[to]
    return [q[c] - p[c] for c in "xyz"]


def normals(faces: DataFrame) -> DataFrame:
    """``faces`` with nx, ny, nz (twice the area long, outward) and area."""
    u, v = _edge(1), _edge(2)
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return faces.withColumns({f"n{c}": n[d] for d, c in enumerate("xyz")}).withColumn("area", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / 2)


def surface_area(faces: DataFrame, *by: str) -> DataFrame:
    return normals(faces).groupBy("frame", *by).agg(F.sum("area").alias("area"))


def enclosed_volume(faces: DataFrame, *by: str) -> DataFrame:
    """Volume of bodies that lie in one piece, from their faces; negative for holes."""
    p = F.col("corners")[0]
    return normals(faces).groupBy("frame", *by).agg((F.sum(p["x"] * F.col("nx") + p["y"] * F.col("ny") + p["z"] * F.col("nz")) / 6).alias("volume"))


def _directed(faces: DataFrame) -> DataFrame:
    """(frame, face, u, v, from, to): each face's three edges in its sense, with the places of their ends."""
    k = F.col("corners")
    edges = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"), k[i].alias("from"), k[j].alias("to")) for x, y, i, j in (("a", "b", 0, 1), ("b", "c", 1, 2), ("c", "a", 2, 0))])
    return faces.select("frame", "face", F.inline(edges))


def open_edges(faces: DataFrame) -> DataFrame:
    """(frame, u, v, surplus): edges that faces don't pass as often in one sense as in the other; none if the mesh is closed."""
    sense = F.when(F.col("u") < F.col("v"), 1).otherwise(-1)
    e = _directed(faces).filter("u != v").groupBy("frame", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return e.agg(F.sum(sense).alias("surplus")).filter("surplus != 0")


def vertices(faces: DataFrame, cell: Cell) -> DataFrame:
    """(frame, vertex, position, faces): each vertex once, in the cell where that is periodic."""
    named = F.array(*[F.struct(F.col(x).alias("vertex"), F.col("corners")[i].alias("p")) for i, x in enumerate("abc")])
    at = faces.select("frame", F.inline(named)).groupBy("frame", "vertex").agg(F.min("p").alias("p"), F.count("*").alias("faces"))
    turns = [F.floor(r + 1e-9).cast("double") if cell.periodic[d] else F.lit(0.0) for d, r in enumerate(cell.reduced(F.col("p")))]
    s = cell.shift(turns)
    return at.select("frame", "vertex", vec(*[F.col(f"p.{c}") - s[d] for d, c in enumerate("xyz")]).alias("position"), "faces")


def _images(cell: Cell, at: F.Column, home: F.Column) -> list[F.Column]:
    """How many cell vectors a place lies from its vertex's position."""
    d = F.struct(*[(at[c] - home[c]).alias(c) for c in "xyz"])
    return [F.round(r).cast("double") if cell.periodic[k] else F.lit(0.0) for k, r in enumerate(cell.reduced_vector(d))]


def smooth(faces: DataFrame, cell: Cell, rounds: int = 8, pass_band: float = 0.1, factor: float = 0.5) -> DataFrame:
    """Taubin's smoothing (1995): each round moves every vertex by ``factor`` towards the mean of its neighbours, then by a larger negative factor.

    A round is two joins of edges and positions; positions are written after each, so a lost executor costs one.
    """
    if rounds <= 0:
        return faces
    at = written(vertices(faces, cell).select("frame", "vertex", "position"), "mesh-vertices")
    here = lambda c, p: at.select("frame", F.col("vertex").alias(c), F.col("position").alias(p))
    placed = faces.join(here("a", "pa"), ["frame", "a"]).join(here("b", "pb"), ["frame", "b"]).join(here("c", "pc"), ["frame", "c"])
    placed = written(placed.withColumn("images", F.array(*[F.array(*_images(cell, F.col("corners")[i], F.col(f"p{c}"))) for i, c in enumerate("abc")])).drop("pa", "pb", "pc"), "mesh-faces")
    # an edge goes from u to the image n of v
    around = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.zip_with(F.col("images")[j], F.col("images")[i], lambda p, q: p - q).alias("n")) for i, x in enumerate("abc") for j, y in enumerate("abc") if i != j])
    edges = written(placed.select("frame", F.inline(around)).distinct(), "mesh-edges")
    back = 1.0 / (pass_band - 1.0 / factor)
    for _ in range(rounds):
        for f in (factor, back):
            s = cell.shift([F.col("n")[d] for d in range(3)])
            means = edges.join(at.withColumnRenamed("vertex", "v"), ["frame", "v"]).groupBy("frame", F.col("u").alias("vertex")).agg(*[F.avg(F.col(f"position.{c}") + s[d]).alias(f"m{c}") for d, c in enumerate("xyz")])
            moved = vec(*[F.col(f"position.{c}") + F.lit(f) * (F.col(f"m{c}") - F.col(f"position.{c}")) for c in "xyz"])
            at = written(at.join(means, ["frame", "vertex"]).select("frame", "vertex", moved.alias("position")), "mesh-vertices")
    out = placed
    for i, c in enumerate("abc"):
        s = cell.shift([F.col("images")[i][d] for d in range(3)])
        out = out.join(at.select("frame", F.col("vertex").alias(c), F.col("position").alias("p")), ["frame", c])
        out = out.withColumn(f"p{c}", vec(*[F.col(f"p.{x}") + s[d] for d, x in enumerate("xyz")])).drop("p")
    return out.withColumn("corners", F.array("pa", "pb", "pc")).select(*faces.columns)


def shells(faces: DataFrame) -> DataFrame:
    """``faces`` with shell: the lowest vertex of the connected piece that a face belongs to."""
    nodes = faces.select("frame", F.explode(F.array("a", "b", "c")).alias("idx")).distinct()
    links = faces.select("frame", F.inline(F.array(*[F.struct(F.col(x).alias("i"), F.col(y).alias("j")) for x, y in (("a", "b"), ("a", "c"))])))
    found = components(nodes, links).select("frame", F.col("idx").alias("a"), F.col("root").alias("shell"))
    return faces.join(found, ["frame", "a"]).select(*faces.columns, "shell")


def triangle_distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of points (n, 3) from triangles (n, 3) each: that of the plane above the inside, else the least of the edges'."""
    best = np.full(len(p), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        e = v - u
        t = np.clip(np.einsum("ni,ni->n", p - u, e) / np.maximum(np.einsum("ni,ni->n", e, e), 1e-300), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - u - t[:, None] * e, axis=1))
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    n = n / np.maximum(size, 1e-300)[:, None]
    above = size > 0
    for u, v in ((a, b), (b, c), (c, a)):
        above &= np.einsum("ni,ni->n", np.cross(v - u, p - u), n) >= 0
    return np.where(above, np.minimum(best, np.abs(np.einsum("ni,ni->n", p - a, n))), best)


def surface_distance(points: DataFrame, faces: DataFrame, cell: Cell, start: float | None = None) -> DataFrame:
    """``points`` with surface_distance, from the nearest face, periodic images included; null without faces.

    Points and the boxes around faces meet in bins as wide as the search radius;
    only points without a face within the radius are searched again with twice as much.
    """
    widths = cell.face_distances()
    most = 2.0 * float(np.abs(cell.array).sum())
    radius = start or float(cell.volume ** (1 / 3)) / 25
    left = points.select("frame", "idx", "position")
    solid, n = counted(faces.select("frame", "corners"), "distance-faces")
    found = None

    def run(batches):
        for b in batches:
            get = lambda name: np.stack([b.column(f"{name}{c}").to_numpy() for c in "xyz"], 1)
            d = triangle_distances(get("p"), get("u"), get("v"), get("w"))
            yield pa.RecordBatch.from_arrays([b.column("frame"), b.column("idx"), pa.array(d)], names=["frame", "idx", "d"])

    while n:
        bins = [int(np.clip(w / radius, 1, 512)) for w in widths]
        r = cell.reduced(F.col("position"))
        turn = [F.floor(r[d]) if cell.periodic[d] else F.lit(0) for d in range(3)]
        in_cell = [r[d] - turn[d] for d in range(3)]
        s = cell.shift([turn[d].cast("double") for d in range(3)])
        low_bin = lambda x, d: F.floor(x * bins[d]).cast("long")  # noqa: E731, B023
        clip = lambda x, d: x if cell.periodic[d] else F.least(F.lit(bins[d] - 1), F.greatest(F.lit(0), x))  # noqa: E731, B023
        at = left.select("frame", "idx", *[(F.col(f"position.{c}") - s[d]).alias(f"p{c}") for d, c in enumerate("xyz")], *[(F.pmod(low_bin(in_cell[d], d), F.lit(bins[d])) if cell.periodic[d] else clip(low_bin(r[d], d), d)).cast("long").alias(f"k{d}") for d in range(3)])
        boxes = solid
        for d in range(3):
            own = [cell.reduced(F.col("corners")[i])[d] for i in range(3)]
            span = F.sequence(clip(low_bin(F.least(*own) - F.lit(radius / widths[d]), d), d), clip(low_bin(F.greatest(*own) + F.lit(radius / widths[d]), d), d))
            boxes = boxes.withColumn(f"q{d}", F.explode(span))
            boxes = boxes.withColumn(f"k{d}", F.pmod(f"q{d}", F.lit(bins[d])).cast("long")).withColumn(f"t{d}", F.floor(F.col(f"q{d}") / bins[d]).cast("double") if cell.periodic[d] else F.lit(0.0))
        back = cell.shift([F.col(f"t{d}") for d in range(3)])
        boxes = boxes.select("frame", "k0", "k1", "k2", *[(F.col("corners")[i][c] - back[d]).alias(f"{x}{c}") for i, x in enumerate("uvw") for d, c in enumerate("xyz")])
        pairs = at.join(boxes.hint("shuffle_hash"), ["frame", "k0", "k1", "k2"]).drop("k0", "k1", "k2")
        best = pairs.mapInArrow(run, f"frame {left.schema['frame'].dataType.simpleString()}, idx long, d double").groupBy("frame", "idx").agg(F.min("d").alias("surface_distance"))
        best = written(best if radius >= most else best.filter(F.col("surface_distance") <= radius), "distances")
        found = best if found is None else found.unionByName(best)
        if radius >= most:
            break
        left, n = counted(left.join(best, ["frame", "idx"], "left_anti"), "distance-points")
        radius *= 2
    points = points.drop("surface_distance")
    if found is None:
        return points.withColumn("surface_distance", F.lit(None).cast("double"))
    return points.join(found, ["frame", "idx"], "left")
