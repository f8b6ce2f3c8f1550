"""Ranking that never needs one task to hold a whole hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1,
                  out: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group.

    A bounded ``row_number`` filter is planned with a group limit on both sides of the shuffle,
    so a task sends at most ``k`` rows per group, however hot the group is.
    """
    rn = out or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return ranked if out else ranked.drop(rn)


def two_level_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
                   out: str = "rank") -> DataFrame:
    """1..n inside each key when rows of one key come in ordered buckets (days, pages, chunks).

    Rank inside (key, bucket) plus the count of the earlier buckets: the counts are aggregated
    map-side, so only one bucket of a key is ever sorted in one task.
    """
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, bucket)]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    local = df.withColumn("_in", F.row_number().over(w))
    return (
        local.alias("l").join(offsets.alias("r"), on)
        .select("l.*", (F.col("r._before") + F.col("l._in")).cast("bigint").alias(out))
        .drop("_in")
    )


def first_spelling(df: DataFrame, keys: Sequence[str], ordinal: str = "ord") -> DataFrame:
    """One row per key: the one with the lowest ordinal (first wins), aggregated map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_s")).select(*keys, "_s.*")


def last_by(df: DataFrame, keys: Sequence[str], ordinal: Column | str) -> DataFrame:
    """One row per key: the one with the highest ordinal (last wins), aggregated map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_s")).select(*keys, "_s.*")
