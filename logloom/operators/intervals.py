"""Interval joins by bins: ranges meet where they share a stretch, never by a product and a filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_merge

#: Width of a bin in the units of the ranges: positions, lines or points.
BIN = 64
#: Each level of bins is so many times as wide as the one below.
STEP = 8


def marked(rows: DataFrame, marks: DataFrame, key: Sequence[str], mark: str, deal: str | None = None) -> DataFrame:
    """``rows`` with the column ``mark`` of ``marks`` (key…, mark) where their key has one, else null; a null in a key meets nothing.

    A key has one mark. Rows and marks that lie together already, dealt by a part of the key, meet in a window without another
    shuffle, where a join would deal both anew. ``deal``: the part of the key that rows are dealt by where marks come out of Python,
    which forgets how they lay; one shuffle then serves this window and those that follow.
    """
    both = rows.withColumn("_row", F.lit(True)).unionByName(marks.select(*key, mark).dropna(subset=list(key)), allowMissingColumns=True)
    both = both.repartition(deal) if deal else both
    return both.withColumn(mark, F.max(mark).over(Window.partitionBy(*key))).where("_row").drop("_row")


def within(outer: DataFrame, inner: DataFrame, by: Sequence[str], hold: tuple[str, str], held: tuple[str, str] | str,
           width: float = BIN, wide: bool = False) -> DataFrame:
    """Rows of ``outer`` with each row of ``inner`` that its half-open range ``hold`` contains.

    ``held`` is a range (contained whole, not empty) or a place. An outer row stands in every bin that it covers, an inner one in the bin
    where it begins, so they meet by an equi join on (by…, bin) and exactly once: rows per bin are what really lies there,
    however long the document. Columns other than ``by`` must differ. ``wide``: ranges may be far longer than there are rows, so each
    stands in bins of its own size, a few of them, and an inner row looks into every size that the ranges of its group have.
    """
    by = list(by)
    lo, hi = hold
    if wide:
        level = F.greatest(F.lit(0), F.ceil(F.log((F.col(hi) - F.col(lo)) / width) / F.log(F.lit(float(STEP))) - 1e-9)).cast("int")
        outer = outer.withColumn("_level", F.when(F.col(hi) > F.col(lo), level).otherwise(0))
        inner = inner.join(by_merge(outer.select(*by, "_level").distinct()), by)
        by, width = [*by, "_level"], width * F.pow(F.lit(float(STEP)), F.col("_level"))
    bins = F.sequence(F.floor(F.col(lo) / width), F.greatest(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    binned = outer.withColumn("_bin", F.explode(bins))
    start = held if isinstance(held, str) else held[0]
    there = inner.withColumn("_bin", F.floor(F.col(start) / width))
    inside = (F.col(start) >= F.col(lo)) & (F.col(start) < F.col(hi))
    if not isinstance(held, str):
        inside = inside & (F.col(held[1]) <= F.col(hi)) & (F.col(held[1]) > F.col(start))
    return binned.join(by_merge(there), [*by, "_bin"]).where(inside).drop("_bin", "_level")
