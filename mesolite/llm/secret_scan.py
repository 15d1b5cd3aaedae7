"""Operator 7: secret scans with corpus-wide ownership frequency.

Base matches are found by three fixed patterns.  Beside them every long token
of mixed letters and digits is a candidate.  The hashes of all candidates'
values are counted over the corpus by distinct owners (sources): a value that
many owners hold is a copied example, one of one or two owners looks live, in
however many of their documents it stands, so copies of a document do not
change what is found in it while they stay with their owner.  A candidate that no
base match covers becomes a span of kind ``owned`` if it looks live.

DataFrame functions only.  Values leave the scan as hashes.  A value held by a
large part of all rows is pre-aggregated by owner.

Defined cases: null text is empty; null source is one owner; texts and tokens
of any length are scanned whole; repeated rows are scanned each; equal texts of
different owners count for each owner; spans with one start are ordered by
kind; columns called like an output are not read (``mask_found`` keeps them);
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesolite.llm import _spans as S
from mesolite.llm._spark import documents, written

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: A value of at most so many owners looks live, if it has so many different characters.
LIVE_OWNERS, LIVE_CHARACTERS = 2, 8


def base_spans(text: str = "text") -> F.Column:
    assign = F.filter(S.spans(0, text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    return F.concat(assign, S.spans(1, text, ACCESS), S.spans(2, text, HEX))


def _found(docs: DataFrame, id_col: str, text_col: str, owner_col: str, *carry: F.Column) -> DataFrame:
    """The written scan: (row, doc_id, owner, base, tokens) and ``carry``; ``row`` numbers its rows, ``tokens`` are those that no base match covers."""
    rows = docs.select(*carry, F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = [c for c in rows.columns if c not in ("doc_id", "owner", "text")]
    found = rows.select(*kept, "doc_id", "owner", base_spans().alias("base"), F.filter(S.spans(3, "text", TOKEN), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")).alias("tokens"))
    free = "filter(tokens, t -> not exists(base, b -> b.s < t.e and t.s < b.e))"
    mark = "x -> struct(x.kind AS kind, x.s AS s, x.e AS e, xxhash64(x.value) AS h, size(array_distinct(split(x.value, ''))) AS variety)"
    found = found.select(F.monotonically_increasing_id().alias("row"), *kept, "doc_id", "owner", F.expr(f"transform(base, {mark})").alias("base"), F.expr(f"transform({free}, {mark})").alias("tokens"))
    return written(found, "secrets")


def _judged(found: DataFrame) -> DataFrame:
    """(row, added, n_live, n_example) of the rows of the written scan that have spans."""
    each = found.filter((F.size("base") > 0) | (F.size("tokens") > 0)).select("row", "owner", F.explode(F.concat("base", "tokens")).alias("x"))

    held = each.select(F.col("x.h").alias("h"), "owner").distinct().groupBy("h").agg(F.count("*").alias("owners"))
    live = F.col("owners") <= LIVE_OWNERS
    judged = each.join(held.select("h", live.alias("rare")), F.col("x.h") == F.col("h"))
    judged = judged.withColumn("live", F.col("rare") & (F.col("x.variety") >= LIVE_CHARACTERS))
    return judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("x.kind") == 3) & F.col("live"), F.col("x"))).alias("added"), F.count_if("live").alias("n_live"), F.count_if(~F.col("rare")).alias("n_example")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: (row, doc_id, base, added, n_live, n_example); spans are (kind, s, e, h).

    ``row`` numbers the rows of the written scan.
    """
    found = _found(docs, id_col, text_col, owner_col)
    out = found.join(_judged(found), "row", "left")
    none = F.expr("cast(array() AS array<struct<kind: int, s: int, e: int, h: bigint, variety: int>>)")
    return out.select("row", "doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def report(found: DataFrame) -> DataFrame:
    base = S.shown("base", KINDS, by_start=True)
    every = S.shown("concat(base, added)", KINDS, by_start=True)
    return found.select(
        "doc_id",
        *(S.count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(every).alias("spans"),
        "n_live",
        "n_example",
    )


def _cut(name: str) -> F.Column:
    """``text__`` with its ``spans__`` (ordered by start) replaced by ``name``; spans that overlap are one."""
    return F.expr(f"""aggregate(spans__, struct(0 AS at, cast(array() AS array<string>) AS out),
        (a, x) -> if(x.s < a.at, struct(greatest(a.at, x.e) AS at, a.out AS out), struct(x.e AS at, concat(a.out, array(substr(text__, a.at + 1, x.s - a.at), {S.quoted(name)})) AS out)),
        a -> concat(array_join(a.out, ''), substr(text__, a.at + 1)))""")


def _places(spans: F.Column) -> F.Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))


def mask(docs: DataFrame, text_col: str = "text", name: str = "<SECRET>") -> DataFrame:
    """``docs`` with each base match in the text replaced by ``name``; other columns as they are.

    Spans that overlap are masked as one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("text__", text).withColumn("spans__", _places(base_spans("text__")))
    return marked.withColumn(text_col, F.when(F.size("spans__") == 0, F.col(text_col)).otherwise(_cut(name))).select(docs.columns)


def mask_found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", name: str = "<SECRET>") -> DataFrame:
    """``docs`` with what ``scan`` finds, base matches and live owned values, replaced in the text by ``name``.

    The texts are written with the scan.  Only the texts of rows with candidates are joined with what was judged.
    """
    found = _found(docs, id_col, text_col, owner_col, F.struct(*docs.columns).alias("doc"))
    added = _judged(found).filter(F.size("added") > 0).select("row", "added")
    some = found.filter(F.size("tokens") > 0).join(added, "row", "left").select("doc", "base", "added")
    none = F.expr("cast(array() AS array<struct<kind: int, s: int, e: int, h: bigint, variety: int>>)")
    rest = found.filter(F.size("tokens") == 0).select("doc", "base", none.alias("added"))
    every = some.withColumn("added", F.coalesce("added", none)).unionByName(rest)
    marked = every.select("doc", F.coalesce(F.col("doc")[text_col].cast("string"), F.lit("")).alias("text__"), _places(F.concat("base", "added")).alias("spans__"))
    text = F.when(F.size("spans__") == 0, F.col("doc")[text_col]).otherwise(_cut(name))
    return marked.select(*((text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))
