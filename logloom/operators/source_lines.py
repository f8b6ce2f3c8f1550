"""Where differences sit in a document's source: an ordered search with a moving cursor, carried along the differences.

Each side of a document is one row: its visible text, and its differences in order. The cursor is state over that order, so a
fold inside the row carries it: a text is searched from the end of the hit before, then from the start. Texts that occur again and
again map to successive places that way. Lines of hits come from an interval join, whole-word counts from an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import marked, within

SIDE = ["doc", "side"]
HITS = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("at", "end", "way")]]))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def visible_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, side, stream) and (doc, side, line, start, end): the lines' texts, blanks collapsed, joined by one blank each."""
    t = lines.select(*SIDE, "line", F.array_join(_words(F.col("text")), " ").alias("t")).where(F.col("t") != "")
    w = Window.partitionBy(*SIDE).orderBy("line")
    n = F.length("t") + 1
    spans = t.select(*SIDE, "line", (F.sum(n).over(w) - n).cast("int").alias("start"), F.sum(n).over(w).cast("int").alias("end"))
    stream = t.groupBy(*SIDE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("stream"))
    return stream, spans


def needles(differences: DataFrame, stream: DataFrame) -> DataFrame:
    """(doc, side, id, needles): what is searched for each difference, in order of preference.

    ``differences`` (doc, side, id, text, before, after). The whole text, its first three words, its longest word if it stands once in
    the source; for a text that is not there its three words before, its three words after. ``way`` 3 marks the words before: the
    difference sits where they end.
    """
    d = differences.select(*SIDE, "id", _words(F.col("text")).alias("w"), _words(F.col("before")).alias("b"), _words(F.col("after")).alias("a"))
    long = F.reduce("w", F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    d = d.withColumn("word", F.when(F.size("w") >= 2, long))
    counts = stream.select(*SIDE, F.explode(F.split("stream", " ")).alias("word")).groupBy(*SIDE, "word").agg(F.count("*").alias("n"))
    alone = counts.where("n = 1").select(*SIDE, "word", F.lit(True).alias("_alone"))
    d = marked(d, alone, [*SIDE, "word"], "_alone")
    need = lambda way, text, test: F.when(test, F.struct(F.lit(way).alias("way"), text.alias("text")))
    join = lambda c: F.array_join(c, " ")
    last = F.slice("b", F.greatest(F.size("b") - 2, F.lit(1)), F.lit(3))
    every = F.array(
        need(0, join(F.col("w")), F.size("w") > 0), need(1, join(F.slice("w", 1, 3)), F.size("w") > 3), need(2, F.col("word"), F.col("_alone")),
        need(3, join(last), F.size("b") > 0), need(4, join(F.slice("a", 1, 3)), F.size("a") > 0))
    return d.select(*SIDE, "id", F.array_compact(every).alias("needles"))


@F.pandas_udf(HITS)
def _search(stream: pd.Series, todo: pd.Series) -> pd.Series:
    """The hit of each difference of a side, in order: at or behind the end of the hit before, else from the start; null if it is nowhere.

    The alternatives after a hit are not searched any more.
    """
    def one(text, differences):
        out, cursor = [], 0
        for d in differences:
            hit = {"id": d["id"], "at": None, "end": None, "way": None}
            for n in d["needles"]:
                at = text.find(n["text"], cursor)
                at = text.find(n["text"]) if at < 0 else at
                if at >= 0:
                    cursor = at + len(n["text"])
                    hit |= {"at": at, "end": cursor, "way": n["way"]}
                    break
            out.append(hit)
        return out

    return pd.Series([one(*x) for x in zip(stream, todo)])


def located(differences: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, side, id, at, line): the place of each difference in its side's visible text and the source line it stands in.

    ``differences`` (doc, side, id, text, before, after), searched by ``id``; ``lines`` (doc, side, line, text), hidden ones left
    out. Null where nothing is found; the cursor then stays.
    """
    stream, spans = visible_text(lines)
    order = needles(differences, stream).groupBy(*SIDE).agg(F.array_sort(F.collect_list(F.struct("id", "needles"))).alias("todo"))
    j = marked(order, stream, SIDE, "stream").withColumn("stream", F.coalesce("stream", F.lit("")))
    hits = j.select(*SIDE, F.inline(_search("stream", "todo")))
    hits = hits.withColumn("at", F.when(F.col("way") == 3, F.col("end") - 1).otherwise(F.col("at"))).drop("end", "way")
    on = within(spans, hits.where("at IS NOT NULL").select(*SIDE, "id", "at"), SIDE, ("start", "end"), "at", 4096)
    return hits.join(on.select(*SIDE, "id", "line"), [*SIDE, "id"], "left").select(*SIDE, "id", "at", "line")


def both_sides(differences: DataFrame, lines: DataFrame, texts: Sequence[str] = ("left_text", "right_text")) -> DataFrame:
    """(doc, id, left_line, right_line) of differences (doc, id, left_text, right_text, before, after)."""
    every = [differences.select("doc", F.lit(s).alias("side"), "id", F.col(t).alias("text"), "before", "after") for s, t in zip("LR", texts)]
    found = located(every[0].unionByName(every[1]), lines)
    return found.groupBy("doc", "id").agg(*[F.max(F.when(F.col("side") == s, F.col("line"))).alias(n) for s, n in (("L", "left_line"), ("R", "right_line"))])
