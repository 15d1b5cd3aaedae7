"""Operator 3: personal data by bootstrapped contextual extraction.

Four fixed patterns give the base spans.  They are the seeds of a bootstrap:
the contexts of seeds form a graph of patterns and instances.  Instances are
words with a digit or an @ and groups of numbers, of any length from ``SHORT``
on.  Patterns are the one to three words to the left or to the right, both
neighbours, and what is written on to the value, as in ``card=``; those that
``SEEDS`` different seeds stand in are induced.  A value that a seed covers
scores 1.  Patterns and instances then score each other in turn for ``ROUNDS``
rounds: a pattern the (smoothed) mean over its distinct values in all rows, any
other value the mean over its induced patterns.  The values in a pattern of
high confidence are new spans, of kind ``context``.

DataFrame functions only.

Defined cases: null text is empty and has no spans; texts and values of any
length are scanned whole; repeated rows are scanned each, but equal values
count once for a pattern; patterns of equal confidence are all taken; other
columns, nulls and names like an output's among them, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm import _spans as S
from mesolite.llm._spark import documents, written

KINDS = ["email", "ip", "card", "phone", "context"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
VALUE = r"(?<![A-Za-z0-9@._%+/-])(?:\+?\(?[0-9]++\)?(?:[\x20-]\(?[0-9]++\)?)++(?![A-Za-z0-9@_%+/])|(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9@._%+/-]*[A-Za-z0-9])"

SHORT = 5
ROUNDS, CONFIDENCE, SEEDS = 3, 0.6, 5


def _digits(value: F.Column) -> F.Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    return f"aggregate(sequence(1, length({digits})), 0, (a, k) -> a + element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substr({digits}, length({digits}) - k + 1, 1)) + 1 + 10 * ((k - 1) % 2))) % 10 = 0"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``, the spans of the four fixed patterns."""
    few = f"if(instr({text}, '@') > 0, {text}, '')"
    digits = rf"if({text} rlike '[0-9]', {text}, '')"
    out = docs.withColumn("at__", F.expr(few)).withColumn("num__", F.expr(digits))
    email = S.spans(0, "at__", EMAIL)
    ip = F.filter(S.spans(1, "num__", IP), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.rlike(BYTE)))
    long_enough = r"if(num__ rlike '[0-9](?:[\\x20-]?[0-9]){12}', num__, '')"
    out = out.withColumn("long__", F.expr(long_enough)).withColumn("cards__", F.filter(S.spans(2, "long__", CARD), lambda x: F.length(_digits(x["value"])).between(13, 19)))
    passes = luhn("regexp_replace(x.value, '[^0-9]', '')")
    card = F.expr(f"filter(cards__, x -> {passes})")
    phone = F.filter(S.spans(3, "num__", PHONE), lambda x: F.length(_digits(x["value"])).between(9, 15))
    return out.withColumn("base", F.concat(email, ip, card, phone)).drop("at__", "num__", "long__", "cards__")


def with_instances(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (with ``base``) with ``instances``: (h, s, e, seed, patterns), the patterns as hashes."""
    value = S.quoted(VALUE)
    out = found.withColumn("has__", F.expr(f"if({text} rlike '[0-9@]', {text}, '')")).withColumn("values__", S.spans(4, "has__", VALUE))
    gaps = rf"if(size(values__) > 0, transform(split(has__, {value}, -1), g -> lower(regexp_replace(g, '\\s+', ' '))), cast(array() AS array<string>))"
    # the words up to the value before or after, which counts as the word char(1)
    words = """transform(values__, (v, i) -> struct(v.s AS s, v.e AS e, v.value AS value,
        split(substring_index(concat(if(i = 0, '', char(1)), gaps__[i]), ' ', -4), ' ') AS l,
        split(substring_index(concat(gaps__[i + 1], if(i + 1 = size(values__), '', char(1))), ' ', 4), ' ') AS r))"""
    patterns = r"""concat(
        transform(filter(sequence(0, 3), k -> size(x.l) > k), k -> concat('l', k, array_join(slice(x.l, -(k + 1), k + 1), ' '))),
        transform(filter(sequence(0, 3), k -> size(x.r) > k), k -> concat('r', k, array_join(slice(x.r, 1, k + 1), ' '))),
        if(size(x.l) > 1 and size(x.r) > 1, array(concat('b', array_join(slice(x.l, -2, 2), ' '), char(1), array_join(slice(x.r, 1, 2), ' '))), cast(array() AS array<string>)))"""
    instances = rf"""transform(filter(words__, x -> length(x.value) >= {SHORT}), x -> struct(xxhash64(x.value) AS h, x.s AS s, x.e AS e,
        exists(base, b -> b.s < x.e and x.s < b.e) AS seed,
        array_distinct(transform(filter({patterns}, p -> substr(p, 2) rlike '\\p{{L}}'), p -> xxhash64(p))) AS patterns))"""
    out = out.withColumn("gaps__", F.expr(gaps)).withColumn("words__", F.expr(words))
    return out.withColumn("instances", F.expr(instances)).drop("has__", "values__", "gaps__", "words__")


def confident_patterns(edges: DataFrame) -> DataFrame:
    """Patterns whose values are personal data, from (label, h, seed): the bootstrap over the pattern-instance graph."""
    induced = edges.filter("seed").select("label", "h").distinct().groupBy("label").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= SEEDS)
    graph = written(edges.join(induced, "label", "left_semi").groupBy("label", "h").agg(F.max(F.col("seed").cast("double")).alias("seed")), "graph")
    scores = graph.withColumn("value", F.col("seed"))
    for _ in range(ROUNDS):
        patterns = scores.groupBy("label").agg((F.sum("value") / (F.count("*") + 1)).alias("p"), F.sum("seed").alias("seeds"))
        instances = graph.join(patterns.select("label", "p"), "label").groupBy("h").agg(F.avg("p").alias("mean"))
        scores = graph.join(instances, "h").withColumn("value", F.greatest("seed", "mean")).drop("mean")
    return patterns.filter((F.col("p") >= CONFIDENCE) & (F.col("seeds") >= SEEDS)).select("label")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, base, added), arrays of (kind, s, e)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_instances(with_base(rows))
    plain = "x -> struct(x.kind AS kind, x.s AS s, x.e AS e)"
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr(f"transform(base, {plain})").alias("base"), "instances")
    found = written(found, "personal")
    each = found.filter(F.size("instances") > 0).select("row", F.inline("instances")).select("row", "h", "s", "e", "seed", F.explode("patterns").alias("label"))
    fresh = each.filter(~F.col("seed")).join(confident_patterns(each.select("label", "h", "seed")), "label", "left_semi")
    added = fresh.groupBy("row").agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "s", "e")).alias("added"))
    none = F.expr("cast(array() AS array<struct<kind: int, s: int, e: int>>)")
    return found.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(S.count("base", k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.expr(f"sha2({S.shown('base', KINDS, by_start=False)}, 256)").alias("base_sha256"),
        F.expr(S.shown("concat(base, added)", KINDS, by_start=False)).alias("spans"),
    )
