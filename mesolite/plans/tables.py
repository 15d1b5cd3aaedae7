"""The driver's tables as particle containers, and the same as SQL for the oracles.

Orders are particles in a periodic box of 100: positions are fixed by hashing
the keys, on a lattice of 0.1 (no cutoff used here lies on a lattice distance).
Events are a trajectory: a particle for each user, a frame for each event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.cell import Cell, vec

BOX = Cell.box(100, 100, 100)
STATUS = {"F": 1, "O": 2, "P": 3}
CUTOFF = 2.95
TRACK = Cell.box(500, 500, 500)


def _hash(key, factor):
    return (key * factor % 1000).cast("double") / 10


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("o_orderstatus"))
    return t.select(
        F.lit(0).alias("frame"),
        F.col("o_orderkey").alias("idx"),
        F.col("o_orderkey").alias("particle_identifier"),
        kind.alias("particle_type"),
        vec(_hash(F.col("o_orderkey"), 7919), _hash(F.col("o_orderkey"), 104729), _hash(F.col("o_custkey"), 1299709)).alias("position"),
        F.col("o_totalprice").alias("total_price"),
        F.col("o_custkey").alias("molecule_identifier"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    return t.select(
        F.lit(0).alias("frame"),
        F.col("p_partkey").alias("idx"),
        F.col("p_partkey").alias("particle_identifier"),
        vec(_hash(F.col("p_partkey"), 7919), _hash(F.col("p_partkey"), 104729), _hash(F.col("p_partkey"), 1299709)).alias("position"),
        F.col("p_size").alias("particle_type"),
        F.col("p_retailprice").alias("total_price"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return t.select(
        frame.cast("int").alias("frame"),
        F.col("event_id").alias("idx"),
        F.col("user_id").alias("particle_identifier"),
        vec(*[(F.col("value") * k % 500.0 + 500.0) % 500.0 for k in (7, 11)], F.lit(0.0)).alias("position"),  # rounded as in EVENTS_SQL
        F.col("value"),
    )


#: Lattices as frames: sides of an orthogonal cell and its sites in parts of them, the first half of the sites of one type where an alloy is told apart.
_R2, _R3, _R6 = 2**0.5, 3**0.5, 6**0.5
_FCC = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
_HEX = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 5 / 6, 0.5), (0, 1 / 3, 0.5)]
LATTICES = [
    ("fcc", (4.0, 4.0, 4.0), _FCC),
    ("hcp", (2.8, 2.8 * _R3, 2.8 * 2 * _R6 / 3), _HEX),
    ("bcc", (3.2, 3.2, 3.2), [(0, 0, 0), (0.5, 0.5, 0.5)]),
    ("sc", (2.6, 2.6, 2.6), [(0, 0, 0)]),
    ("cubic_diamond", (5.4, 5.4, 5.4), [*_FCC, *[(x + 0.25, y + 0.25, z + 0.25) for x, y, z in _FCC]]),
    ("hex_diamond", (3.8, 3.8 * _R3, 3.8 * 2 * _R6 / 3), [*_HEX, *[(x, y, z + 0.375) for x, y, z in _HEX]]),
    ("graphene", (2.46, 2.46 * _R3, 3.35), [(0, 0, 0), (0.5, 0.5, 0), (0, 1 / 3, 0), (0.5, 5 / 6, 0)]),
]


def crystals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Cell]:
    """Parts as the sites of seven finite crystals, a frame for each lattice of ``LATTICES``, shaken by hashes of the key; and the open box around them.

    The sizes of the crystals follow from the number of parts.
    """
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    kinds = len(LATTICES)
    each = -(-t.count() // kinds)
    site = F.expr(f"p_partkey div {kinds}")
    rows = t.select((F.col("p_partkey") % kinds).cast("int").alias("frame"), F.col("p_partkey").alias("idx"), site.alias("n"))
    facts, most = [], [1.0, 1.0, 1.0]
    for k, (_, sides, sites) in enumerate(LATTICES):
        across, per = max(1, round((-(-each // len(sites))) ** (1 / 3))), len(sites)
        deep = -(-each // (per * across * across)) + 1
        most = [max(m, s * c) for m, s, c in zip(most, sides, (deep, across, across), strict=True)]
        # fcc as L12, hcp and sc of one type, the others by sublattice
        one = 1 if k == 0 else per if k in (1, 3) else per // 2
        facts.append(f"struct({per} AS per, {across} AS across, {one} AS one, array({', '.join(f'{x}D' for x in sides)}) AS sides, array({', '.join('array(' + ', '.join(f'{x}D' for x in p) + ')' for p in sites)}) AS sites)")
    rows = rows.withColumn("f", F.expr(f"array({', '.join(facts)})")[F.col("frame")])
    rows = rows.withColumns({"s": F.expr("cast(n % f.per AS int)"), "c": F.expr("n div f.per")})
    rows = rows.withColumn("at", F.expr("array(c div (f.across * f.across), c div f.across % f.across, c % f.across)"))
    shaken = [F.expr(f"(at[{d}] + f.sites[s][{d}]) * f.sides[{d}] + (idx * {a} % {m} / {m}D - 0.5D) * 0.2D") for d, (a, m) in enumerate(((7919, 997), (104729, 1009), (15485863, 1013)))]
    rows = rows.withColumn("particle_type", F.when(F.col("s") < F.col("f.one"), 1).otherwise(2))
    return rows.select("frame", "idx", F.col("idx").alias("particle_identifier"), "particle_type", vec(*shaken).alias("position")), Cell.box(*[m + 1.0 for m in most], pbc=(False, False, False), origin=(-0.5, -0.5, -0.5))


def crystals_sql() -> str:
    """CTE ``cr`` (frame, idx, t, x, y, z): the places of ``crystals``."""
    ones = [1 if k == 0 else len(sites) if k in (1, 3) else len(sites) // 2 for k, (_, _, sites) in enumerate(LATTICES)]
    rows = ", ".join(f"({k}, {len(sites)}, {ones[k]}, [{', '.join(f'{x}::DOUBLE' for x in sides)}], [{', '.join('[' + ', '.join(f'{x}::DOUBLE' for x in p) + ']' for p in sites)}])" for k, (_, sides, sites) in enumerate(LATTICES))
    kinds = len(LATTICES)
    shaken = ", ".join(f"(place[{d + 1}] + sites[s + 1][{d + 1}]) * sides[{d + 1}] + ((idx * {a} % {m}) / {m}::DOUBLE - 0.5::DOUBLE) * 0.2::DOUBLE AS {c}" for d, (c, a, m) in enumerate((("x", 7919, 997), ("y", 104729, 1009), ("z", 15485863, 1013))))
    return f"""lt(frame, per, one, sides, sites) AS (VALUES {rows}),
  ea AS (SELECT (count(*) + {kinds - 1}) // {kinds} AS each FROM part),
  la AS (SELECT *, greatest(1, round(power((each + per - 1) // per, 1.0::DOUBLE / 3)))::BIGINT AS across FROM lt, ea),
  si AS (SELECT frame, p_partkey AS idx, sides, sites, one, across, (p_partkey // {kinds}) % per AS s, p_partkey // {kinds} // per AS c FROM part JOIN la ON frame = p_partkey % {kinds}),
  pl AS (SELECT *, [c // (across * across), c // across % across, c % across] AS place FROM si),
  cr AS (SELECT frame, idx, CASE WHEN s < one THEN 1 ELSE 2 END AS t, {shaken} FROM pl)"""


ORDERS_SQL = """p AS (
  SELECT o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS t, o_totalprice AS v, o_custkey AS mol,
         (o_orderkey * 7919 % 1000)::DOUBLE / 10 AS x, (o_orderkey * 104729 % 1000)::DOUBLE / 10 AS y, (o_custkey * 1299709 % 1000)::DOUBLE / 10 AS z
  FROM orders)"""

PARTS_SQL = """pp AS (
  SELECT p_partkey AS idx, p_size AS t, p_retailprice AS v,
         (p_partkey * 7919 % 1000)::DOUBLE / 10 AS x, (p_partkey * 104729 % 1000)::DOUBLE / 10 AS y, (p_partkey * 1299709 % 1000)::DOUBLE / 10 AS z
  FROM part)"""

EVENTS_SQL = """e AS (
  SELECT cast(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS frame, event_id AS idx, user_id AS id, value AS v,
         ((value * 7) % 500.0::DOUBLE + 500) % 500.0::DOUBLE AS x, ((value * 11) % 500.0::DOUBLE + 500) % 500.0::DOUBLE AS y
  FROM events)"""


def neighbors_sql(cutoff: float = CUTOFF, source: str = "p", bins: int = 33) -> str:
    """CTEs ``nb`` (i, j, dx, dy, dz, d2): pairs within the cutoff (at most the width of a bin) in the periodic box."""
    return f"""bn AS (SELECT *, least({bins - 1}, floor(x / 100 * {bins}))::INT AS bx, least({bins - 1}, floor(y / 100 * {bins}))::INT AS by_, least({bins - 1}, floor(z / 100 * {bins}))::INT AS bz FROM {source}),
  st AS (SELECT a.d AS sx, b.d AS sy, c.d AS sz FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b, (SELECT unnest([-1, 0, 1]) AS d) c),
  nr AS (SELECT a.idx AS i, b.idx AS j, b.x - a.x - 100 * round((b.x - a.x) / 100) AS dx, b.y - a.y - 100 * round((b.y - a.y) / 100) AS dy, b.z - a.z - 100 * round((b.z - a.z) / 100) AS dz
         FROM (SELECT bn.*, (bx + sx + {bins}) % {bins} AS kx, (by_ + sy + {bins}) % {bins} AS ky, (bz + sz + {bins}) % {bins} AS kz FROM bn, st) a
         JOIN bn b ON a.kx = b.bx AND a.ky = b.by_ AND a.kz = b.bz WHERE a.idx <> b.idx),
  nb AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM nr WHERE dx * dx + dy * dy + dz * dz <= {cutoff} * {cutoff})"""
