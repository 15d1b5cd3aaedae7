"""Queries over crystals, surfaces and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from mesolite.operators import alpha as AS
from mesolite.operators import correlation as CF
from mesolite.operators import fields as D
from mesolite.operators import grains as GR
from mesolite.operators import hulls as H
from mesolite.operators import isosurface as I
from mesolite.operators import lists as L
from mesolite.operators import mesh as M
from mesolite.operators import neighbors as N
from mesolite.operators import templates as PT
from mesolite.operators import voronoi as V
from mesolite.plans.registry import query
from mesolite.plans.tables import BOX, ORDERS_SQL, PARTS_SQL, crystals, crystals_sql, orders, parts
from mesolite.storage import written

EVERY = tuple(PT.SIZES)


def _matched(spark, sf):
    p, box = crystals(spark, sf)
    return PT.template_matching(p, box, EVERY, type_col="particle_type")


@query()
def template_matching(spark, sf):
    o = F.col("orientation")
    return _matched(spark, sf).select("frame", "idx", "structure_type", "ordering_type", F.round("rmsd", 6).alias("rmsd"), F.round("interatomic_distance", 6).alias("interatomic_distance"), F.round(o["w"], 5).alias("qw"), F.round(F.aggregate("deformation", F.lit(0.0), lambda a, x: a + x * x), 5).alias("stretch"))


@query()
def template_order(spark, sf):
    return PT.template_order(_matched(spark, sf)).select("frame", "i", "place", "j", *[F.round(c, 4).alias(c) for c in ("tx", "ty", "tz")])


@query()
def template_rmsd_histogram(spark, sf):
    return PT.rmsd_histogram(_matched(spark, sf)).select("frame", "bin", F.round("rmsd", 6).alias("rmsd"), "count")


DENSITY = f"""WITH {PARTS_SQL}, d AS (SELECT a.range AS vx, b.range AS vy, c.range AS vz, x - 5 * a.range AS ex, y - 5 * b.range AS ey, z - 5 * c.range AS ez FROM range(20) a, range(20) b, range(20) c, pp),
m AS (SELECT vx, vy, vz, power(ex - 100 * round(ex / 100), 2) + power(ey - 100 * round(ey / 100), 2) + power(ez - 100 * round(ez / 100), 2) AS d2 FROM d),
g AS (SELECT vx, vy, vz, coalesce(sum(exp(-d2 / (2 * 3.1::DOUBLE * 3.1))) FILTER (d2 <= 9.3::DOUBLE * 9.3), 0) >= 1.5 AS s FROM m GROUP BY 1, 2, 3)"""
LEVEL = 1.5


def _density(spark, sf):
    return D.gaussian_density(parts(spark, sf), BOX, (20, 20, 20), 3.1)


# every grid edge that the level passes carries a vertex
@query(f"""{DENSITY}, e AS (SELECT a.vx, a.vy, a.vz, k AS axis FROM g a, (SELECT unnest([0, 1, 2]) AS k) JOIN g b ON b.vx = (a.vx + (k = 0)::INT) % 20 AND b.vy = (a.vy + (k = 1)::INT) % 20 AND b.vz = (a.vz + (k = 2)::INT) % 20 WHERE a.s <> b.s)
SELECT cast(((vx * 20 + vy) * 20 + vz) * 3 + axis AS BIGINT) AS vertex FROM e""")
def isosurface_vertices(spark, sf):
    return M.vertices(I.isosurface(_density(spark, sf), BOX, (20, 20, 20), LEVEL, "density", centred=False), BOX).select("vertex")


@query("SELECT true AS closed, true AS complete")
def isosurface_closed(spark, sf):
    """The mesh has no open edge, and what it bounds and what the same field upside down bounds fill the box."""
    grid = written(_density(spark, sf), "density")
    faces = I.isosurface(grid, BOX, (20, 20, 20), LEVEL, "density", centred=False)
    above = I.volume_inside(grid, BOX, (20, 20, 20), LEVEL, "density", centred=False).select("volume")
    below = I.volume_inside(grid.withColumn("density", -F.col("density")), BOX, (20, 20, 20), -LEVEL, "density", centred=False).select(F.col("volume").alias("below"))
    n = M.open_edges(faces).agg(F.count("*").alias("open"))
    return n.crossJoin(above).crossJoin(below).select((F.col("open") == 0).alias("closed"), (F.abs(F.col("volume") + F.col("below") - BOX.volume) < 1e-3).alias("complete"))  # one row each


@query()
def surface_distance(spark, sf):
    faces = written(I.isosurface(_density(spark, sf), BOX, (20, 20, 20), LEVEL, "density", centred=False), "isosurface")
    return M.surface_distance(orders(spark, sf), M.smooth(faces, BOX, 2), BOX).select("idx", F.round("surface_distance", 4).alias("surface_distance"))


#: Sums of price and place over eight voxels a side.
GRID = f"""WITH {ORDERS_SQL}, g AS (SELECT least(7, floor(x / 100 * 8))::INT AS gx, least(7, floor(y / 100 * 8))::INT AS gy, least(7, floor(z / 100 * 8))::INT AS gz, sum(v / 1000) AS one, sum(x) AS two, count(*) AS n FROM p GROUP BY 1, 2, 3),
c AS (SELECT power(count(*), 2) AS n2 FROM p)"""


def _correlated(spark, sf):
    return CF.grid_correlation(orders(spark, sf), BOX, F.col("total_price") / 1000, F.col("position.x"), 12.0)


@query(f"""{GRID}, k AS (SELECT a.range AS kx, b.range AS ky, c.range AS kz FROM range(8) a, range(8) b, range(8) c WHERE a.range + b.range + c.range > 0),
f AS (SELECT kx, ky, kz, sum(one * cos(h)) AS r1, sum(one * sin(h)) AS i1, sum(two * cos(h)) AS r2, sum(two * sin(h)) AS i2 FROM (SELECT *, 2 * pi() * (kx * gx + ky * gy + kz * gz) / 8 AS h FROM g, k) GROUP BY 1, 2, 3),
b AS (SELECT floor(sqrt(power((kx + 4) % 8 - 4, 2) + power((ky + 4) % 8 - 4, 2) + power((kz + 4) % 8 - 4, 2)))::INT AS bin, r1 * r2 + i1 * i2 AS s FROM f)
SELECT bin, round(2 * pi() / 100 * (bin + 0.5), 6) AS q, round(avg(s) * 1e6::DOUBLE / any_value(n2), 3) AS correlation, count(*) AS count FROM b, c WHERE bin < 4 GROUP BY 1""")
def grid_correlation_q(spark, sf):
    return _correlated(spark, sf)[0].select("bin", F.round("q", 6).alias("q"), F.round("correlation", 3).alias("correlation"), "count")


@query(f"""{GRID}, s AS (SELECT (a.gx - b.gx + 12) % 8 - 4 AS sx, (a.gy - b.gy + 12) % 8 - 4 AS sy, (a.gz - b.gz + 12) % 8 - 4 AS sz, sum(a.one * b.two) * 512 AS s, sum(a.n * b.n) * 512 AS d FROM g a, g b GROUP BY 1, 2, 3),
b AS (SELECT floor(sqrt(sx * sx + sy * sy + sz * sz))::INT AS bin, s, d FROM s WHERE sx <> 0 OR sy <> 0 OR sz <> 0)
SELECT bin, round((bin + 0.5) * 12.5, 6) AS r, round(avg(s) / any_value(n2), 2) AS correlation, round(avg(d) / any_value(n2), 6) AS rdf, count(*) AS count FROM b, c WHERE bin < 4 GROUP BY 1""")
def grid_correlation_r(spark, sf):
    return _correlated(spark, sf)[1].select("bin", F.round("r", 6).alias("r"), F.round("correlation", 2).alias("correlation"), F.round("rdf", 6).alias("rdf"), "count")


@query()
def alpha_totals(spark, sf):
    p, box = crystals(spark, sf)
    return AS.AlphaShape(p, box, 3.6).totals(2).select("frame", *[F.round(c, 4).alias(c) for c in ("surface_area", "solid_volume", "empty_volume")])


@query()
def alpha_regions(spark, sf):
    p, box = crystals(spark, sf)
    return AS.AlphaShape(p, box, 1.6).regions(0).select("frame", F.round("volume", 4).alias("volume"), F.round("surface_area", 4).alias("surface_area"), "tetrahedra")


@query()
def alpha_surface_particles(spark, sf):
    p, box = crystals(spark, sf)
    return AS.AlphaShape(p, box, 3.6).select_surface().select("frame", "idx", "selection")


def _grained(spark, sf):
    p, box = crystals(spark, sf)
    matched = PT.template_matching(p, box, EVERY).select("frame", "idx", "structure_type", "orientation", "template_neighbors")
    return GR.grain_segmentation(written(matched, "matched"), 10.0, 1, near=L.neighbor_pairs(p, box, 3.0))


@query()
def grain_segmentation(spark, sf):
    return _grained(spark, sf).select("frame", "idx", "grain")


@query()
def grain_table(spark, sf):
    o = F.col("orientation")
    return GR.grain_table(_grained(spark, sf)).select("frame", "grain", "structure_type", "size", F.round(o["w"], 4).alias("qw"), F.round("spread", 3).alias("spread"))


@query()
def elastic_strain(spark, sf):
    return GR.elastic_strain(_matched(spark, sf), PT.FCC, 4.0).select("frame", "idx", F.round("volumetric_strain", 6).alias("volumetric_strain"), F.round("strain.xy", 6).alias("strain_xy"))


# the nearest other site is always across a face of the cell
@query(f"""WITH {crystals_sql()}, d AS (SELECT a.idx, min(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2)) AS d2 FROM cr a JOIN cr b ON a.frame = b.frame AND a.idx <> b.idx GROUP BY 1)
SELECT idx, round(d2, 6) AS d2 FROM d""")
def voronoi_nearest_crystals(spark, sf):
    p, box = crystals(spark, sf)
    faces = V.voronoi(p, box).select("frame", "idx", F.explode("faces.j").alias("j"), "position").filter("j >= 0")
    both = faces.join(p.select("frame", F.col("idx").alias("j"), F.col("position").alias("other")), ["frame", "j"])
    d2 = sum(((F.col(f"other.{c}") - F.col(f"position.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.groupBy("idx").agg(F.round(F.min(d2), 6).alias("d2"))


@query()
def voronoi_topology(spark, sf):
    p, box = crystals(spark, sf)
    return V.voronoi(p, box, topology=True).select("frame", "idx", "topology", "symmetry")


@query()
def coordination_polyhedra(spark, sf):
    p, box = crystals(spark, sf)
    p = p.withColumn("selection", F.when(F.col("particle_type") == 1, 1).otherwise(0))
    table = H.polyhedron_table(H.coordination_polyhedra(p, N.neighbors(p, box, 3.1)))
    return table.select("frame", "center", "faces", F.round("area", 5).alias("area"), F.round("volume", 5).alias("volume"))
