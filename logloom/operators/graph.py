"""Connected components of edge tables by joins, kept apart by a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_merge, cut_lineage


def components(edges: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by…, node, component): every end of an edge with the smallest end it is tied to; ends are bigint, loops count as nodes.

    Star contraction: each round ties a vertex's larger neighbours to the smallest one it sees, then its smaller ones. A round
    is two minima per vertex and two joins on the vertex, and the paths halve, so no vertex's neighbours meet in one row and the number
    of rounds is logarithmic. Rounds are cut by reliable checkpoints.
    """
    by = list(by)
    key = [*by, "u"]
    ends = edges.select(*by, F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).distinct()
    loops = ends.where("u = v").select(*by, F.col("u").alias("node"))
    cur, mark = cut_lineage(ends.where("u <> v")), None
    while True:
        both = cur.unionByName(cur.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(by_merge(low), key).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            *by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(by_merge(least), key).where(F.col("v") != F.col("m")).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut_lineage(small.unionByName(least.select(*key, F.col("m").alias("v"))).where("u <> v").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = cur.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    tied = stars.unionByName(roots)
    return tied.unionByName(loops.join(by_merge(tied), [*by, "node"], "left_anti").select(*by, "node", F.col("node").alias("component")))
