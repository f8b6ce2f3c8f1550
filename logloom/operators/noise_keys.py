"""Noise rules over the keys of a document: matches span keys, touched keys merge, a map leads back to the old ones.

A line is the text of its keys with a space between. Rules are searched line by line; a match takes its characters, and the keys
it touches become one key: placeholders for matched text, the rest as it was. Matches and keys are two lists of disjoint ranges
over one line, so they are laid over each other by a sweep: one ordered pass in which every event carries the last key and the
last match before it. A document's rows meet once, by one shuffle on its id; nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .noise import GUARD, LINE_CAP, taken_spans

EVENTS = "array<struct<at:int,kind:int,pos:bigint,e:int,text:string,rule:int>>"
# Order of events at one place: a match ends before a key begins, a key begins before a match does.
ENDS, KEY, STARTS = 0, 1, 2


def _pieces(text: Column, keys: Column, cap: int | None) -> Column:
    """ARRAY<STRUCT<b,e>>: the line cut at key boundaries into ranges of at most ``cap`` characters; longer keys are cut inside."""
    whole = F.array(F.struct(F.lit(0).alias("b"), F.length(text).alias("e")))
    if cap is None:
        return whole

    def step(acc: Column, k: Column) -> Column:
        end = k["s"] + F.length(k["key"])
        fresh = (end - acc["c"] > cap) & (k["s"] > acc["c"])
        begin = F.when(fresh, k["s"]).otherwise(acc["c"])
        done = F.when(fresh, F.concat(acc["done"], F.array(F.struct(acc["c"].alias("b"), acc["e"].alias("e"))))).otherwise(acc["done"])
        more = F.greatest(F.lit(0), F.ceil((end - begin) / cap).cast("int") - 1)
        inside = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.struct(
            (begin + (i - 1) * cap).alias("b"), (begin + i * cap).alias("e")))
        return F.struct((begin + more * cap).alias("c"), end.alias("e"), F.concat(done, F.slice(inside, F.lit(1), more)).alias("done"))

    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"), F.expr("cast(array() as array<struct<b:int,e:int>>)").alias("done"))
    cut = F.aggregate(keys, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["c"].alias("b"), acc["e"].alias("e")))))
    return F.when(F.length(text) <= cap, whole).otherwise(cut)


def _lines(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, line, keys): the keys of each line in order, with the places where they begin in the line's text."""
    w = Window.partitionBy(*by).orderBy("pos")
    d = keys.select(*by, F.col("pos").cast("bigint").alias("pos"), "key", F.coalesce("ends_line", F.lit(False)).cast("int").alias("_end"))
    d = d.withColumn("_end", F.coalesce(F.lag("_end").over(w), F.lit(0))).withColumn("line", F.sum("_end").over(w))
    wl = Window.partitionBy(*by, "line").orderBy("pos")
    d = d.withColumn("s", F.coalesce(F.sum(F.length("key") + 1).over(wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return d.groupBy(*by, "line").agg(F.array_sort(F.collect_list(F.struct("s", "pos", "key"))).alias("keys"))


def _events(lines: DataFrame, rules: Sequence[tuple[str, str]], by: Sequence[str], cap: int | None) -> DataFrame:
    """(by…, line, at, kind, …): where keys begin and matches begin and end, in the text of each line."""
    text = F.array_join(F.transform("keys", lambda k: k["key"]), " ")
    d = lines.withColumn("text", text)
    d = d.select(*by, "line", "keys", "text", F.posexplode(_pieces(F.col("text"), F.col("keys"), cap)).alias("piece", "cut"))
    begin, end = F.col("cut.b"), F.col("cut.e")
    # placeholders of earlier stages are never matched again: their characters count as taken
    own = F.filter("keys", lambda k: k["key"].startswith(GUARD) & (k["s"] < end) & (k["s"] + F.length(k["key"]) > begin))
    held = F.transform(own, lambda k: F.struct((k["s"] - begin).alias("s"), (k["s"] + F.length(k["key"]) - begin).alias("e"), F.lit(-1).alias("rule")))
    d = d.withColumn("part", F.substring(F.col("text"), begin + 1, end - begin)).withColumn(
        "_t", held.cast("array<struct<s:int,e:int,rule:int>>"))
    d = taken_spans(d, "part", rules, touching=True).withColumn("_t", F.filter("_t", lambda x: x["rule"] >= 0))
    event = lambda **c: F.struct(*[(c[n] if n in c else F.lit(None)).alias(n) for n in ("at", "kind", "pos", "e", "text", "rule")])
    starts = F.transform("_t", lambda x: event(at=x["s"] + begin, kind=F.lit(STARTS), e=x["e"] + begin, rule=x["rule"]))
    ends = F.transform("_t", lambda x: event(at=x["e"] + begin, kind=F.lit(ENDS)))
    first = F.when(F.col("piece") == 0, F.transform("keys", lambda k: event(
        at=k["s"], kind=F.lit(KEY), pos=k["pos"], e=k["s"] + F.length(k["key"]), text=k["key"]))).otherwise(F.array())
    return d.select(*by, "line", F.inline(F.concat(first.cast(EVENTS), starts.cast(EVENTS), ends.cast(EVENTS))))


def noise_over_keys(keys: DataFrame, rules: Sequence[tuple[str, str]], by: Sequence[str] = ("doc",),
                    cap: int | None = LINE_CAP) -> DataFrame:
    """(by…, n, key, first, end, hits): the final keys, each with its range ``[first, end)`` of the keys before noise.

    ``keys`` is (by…, pos, key, ends_line): ``pos`` counts from 0 without holes, a key has no blanks and is not empty. The
    first rule wins; a match that touches text taken before it, a placeholder's or none but spaces is no match. ``hits`` are the
    matches that begin in the key's range: ARRAY<STRUCT<first,last,rule>>, ``rule`` a name, in text order.
    """
    by = list(by)
    marks = F.array(*[F.lit(f"{GUARD}NOISE:{name}") for name, _p in rules]) if rules else F.array().cast("array<string>")
    names = F.array(*[F.lit(name) for name, _p in rules]) if rules else F.array().cast("array<string>")
    w = Window.partitionBy(*by, "line").orderBy("at", "kind")
    until, before = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    # read backwards, what follows is carried along as well
    after = Window.partitionBy(*by, "line").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    is_key, is_start = F.col("kind") == KEY, F.col("kind") == STARTS
    here = F.when(is_key, F.struct(F.col("pos"), F.col("at").alias("s"), "e", "text"))
    d = _events(_lines(keys, by), rules, by, cap).select(
        "*", F.last(here, ignorenulls=True).over(until).alias("word"), F.last(F.when(is_key, F.col("e")), ignorenulls=True).over(before).alias("_stop"),
        F.last(F.when(is_start, F.struct(F.col("at").alias("s"), "e", "rule")), ignorenulls=True).over(before).alias("match"),
        F.last(F.when(is_start, F.col("at")), ignorenulls=True).over(after).alias("_next"))
    # a key goes with the one before it where a match begins before the end of that and ends behind the start of this
    tied = F.coalesce((F.col("match.e") > F.col("at")) & (F.col("match.s") < F.col("_stop")), F.lit(False))
    late = is_start & (F.col("at") >= F.col("word.e"))  # begins in the space before the next key
    d = d.withColumn("_g", F.sum(F.when(is_key & ~tied, 1).otherwise(0)).over(until) + late.cast("int"))
    rest_from = F.when(is_key, F.greatest("at", F.coalesce("match.e", F.lit(0)))).otherwise(F.col("e"))
    rest_to = F.least("word.e", F.coalesce("_next", F.col("word.e")))
    rest = F.substring(F.col("word.text"), rest_from - F.col("word.s") + 1, F.greatest(rest_to - rest_from, F.lit(0)))
    # matches of one rule side by side inside a key are one placeholder
    again = F.coalesce((F.col("match.e") == F.col("at")) & (F.col("match.rule") == F.col("rule")) & (F.col("at") > F.col("word.s")) & ~late, F.lit(False))
    text = F.when(is_key, rest).when(is_start, F.concat(F.when(again, "").otherwise(F.get(marks, F.col("rule"))), F.when(late, "").otherwise(rest)))
    d = d.withColumn("_text", text)
    begun = F.when(is_start, F.struct("at", (F.col("word.pos") + late.cast("int")).alias("first"), F.get(names, F.col("rule")).alias("rule")))
    ended = F.when(F.col("kind") == ENDS, F.struct("at", F.col("word.pos").alias("last")))
    g = d.groupBy(*by, "line", "_g").agg(
        F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct("at", "kind", F.col("_text").alias("text"))))).alias("_p"),
        F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"),
        F.array_sort(F.collect_list(begun)).alias("_b"), F.array_sort(F.collect_list(ended)).alias("_e"))
    hits = F.zip_with("_b", "_e", lambda b, e: F.struct(b["first"].alias("first"), e["last"].alias("last"), b["rule"].alias("rule")))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1
    return g.select(*by, n.cast("bigint").alias("n"), F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("key"), "first", "end", hits.alias("hits"))


def key_hits(final: DataFrame, by: Sequence[str] = ("doc",)) -> DataFrame:
    """(by…, first, last, rule): one row per match, in the numbering before noise."""
    return final.select(*by, F.inline("hits"))


def back_to_keys(final: DataFrame, spans: DataFrame, by: Sequence[str] = ("doc",), first: str = "i1", end: str = "i2") -> DataFrame:
    """``spans`` over final keys (``[first, end)``) with the same ranges of the keys before noise.

    An empty range stands where its key begins, or behind the last key.
    """
    by = list(by)
    at = final.select(*by, F.col("n").alias("_n"), F.col("first").alias("_from"), F.col("end").alias("_to"))
    size = final.groupBy(*by).agg(F.max("end").alias("_all"))
    a = at.select(*by, F.col("_n").alias(first), F.col("_from").alias("_first"))
    b = at.select(*by, (F.col("_n") + 1).alias(end), F.col("_to").alias("_end"))
    j = spans.join(a, [*by, first], "left").join(b, [*by, end], "left").join(size, by, "left")
    begin = F.coalesce("_first", "_all", F.lit(0))
    return j.withColumn("_new", F.when(F.col(first) == F.col(end), begin).otherwise(F.col("_end"))).withColumn(first, begin).withColumn(
        end, F.col("_new")).drop("_first", "_end", "_all", "_new").select(*spans.columns)
