"""Places of regular expression matches, with DataFrame functions only.

``split`` gives what lies between the matches that ``regexp_extract_all``
gives; running sums of both lengths are the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind: int, s: int, e: int, value: string>"
NO_SPANS = f"cast(array() AS array<{SPAN}>)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(kind: int, text: str, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as ``array<SPAN>``; the value is ``group``'s text. Null text has none."""
    p = quoted(pattern)
    found = f"""aggregate(
        zip_with(regexp_extract_all({text}, {p}, 0), slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), (h, b) -> struct(length(b) AS gap, length(h) AS len, h AS hit)),
        struct(0 AS at, {NO_SPANS} AS out),
        (a, x) -> struct(a.at + x.gap + x.len AS at, concat(a.out, array(struct({kind} AS kind, a.at + x.gap AS s, a.at + x.gap + x.len AS e, x.hit AS value))) AS out),
        a -> a.out)"""
    if group:
        found = f"zip_with({found}, regexp_extract_all({text}, {p}, {group}), (x, v) -> struct(x.kind AS kind, x.s AS s, x.e AS e, v AS value))"
    return F.expr(f"if(coalesce({text} rlike {p}, false), {found}, {NO_SPANS})")


def shown(column: str, kinds: list[str], by_start: bool) -> str:
    """SQL for ``kind:start:end`` of an array of spans, comma-joined, ordered by start and kind or by kind and start."""
    names = "array(" + ", ".join(quoted(k) for k in kinds) + ")"
    first, second = ("s", "kind") if by_start else ("kind", "s")
    ordered = f"array_sort(transform({column}, x -> struct(x.{first} AS {first}, x.{second} AS {second}, x.e AS e)))"
    return f"array_join(transform({ordered}, x -> concat(element_at({names}, x.kind + 1), ':', x.s, ':', x.e)), ',')"


def count(column: str, kind: int) -> Column:
    return F.expr(f"cast(size(filter({column}, x -> x.kind = {kind})) AS bigint)")
