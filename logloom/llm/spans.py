"""Spans of regular expressions in whole texts, as column expressions (code points, end exclusive).

A span is a struct ``(s int, e int, m string)``. Patterns run in the JVM; the start of a match is the length of what
``split`` leaves before it, so nothing but built-in functions is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
NAMED = "array<struct<s:int,k:int,e:int,kind:string>>"


def none(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as {kind})")


def matches(text: Column, pattern: str, hint: Column | None = None, group: int = 0) -> Column:
    """Matched strings, leftmost and non-overlapping; ``hint`` is a cheap test that must hold where there is a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if hint is None else F.when(hint, found).otherwise(F.expr("cast(array() as array<string>)"))


def located(text: Column, pattern: str, found: Column) -> Column:
    """The spans of ``found``, which is what ``matches`` gave for the same text and pattern."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zero = F.struct(F.lit(0).alias("pos"), none().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(zipped, zero, step, lambda acc: acc["spans"])).otherwise(none())


def named(spans: Column, kind: str, rank: int) -> Column:
    """Spans as ``(s, k, e, kind)``: they sort by start, then by the rank of the kind."""
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of named spans by start, then rank, comma-joined; empty if there are none."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column, label) -> Column:
    """``text`` with each named span replaced by ``label(span)``; a span that begins inside a replaced one is swallowed."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]
        kept = F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], kept, label(x))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), zero, step, rest)).otherwise(text)
