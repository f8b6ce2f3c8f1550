"""Watermarks: large words clustered by nearness, clusters accepted when pale or repeated about the same place, compared across sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .layout import DIAGONAL, NEAR, WATERMARK

#: Height of the bands of a page in which large words look for each other, in points.
BAND = 64.0


def watermark_candidates(words: DataFrame, body: DataFrame) -> DataFrame:
    """Huge words, and large ones that are neither level nor upright."""
    large = (F.col("size") >= WATERMARK * F.col("body")) | ((F.col("angle") % 90 != 0) & (F.col("size") >= DIAGONAL * F.col("body")))
    return words.join(body, "doc").where(large).drop("body")


def clusters(large: DataFrame) -> DataFrame:
    """``large`` with ``cluster``: words of a page tied by a chain of neighbours within one font size of each other.

    A word stands in the bands its box covers, and in those its box covers when widened by its size; two near words share a
    band that one of them reaches by itself. So pairs come from equal bands, and chains from components.
    """
    box = ["pos", "x0", "y0", "x1", "y1", "size"]
    band = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BAND), F.floor(hi / BAND)))
    own = large.select("doc", "page", *[F.col(c).alias(f"b_{c}") for c in box], band(F.col("y0"), F.col("y1")).alias("band"))
    wide = large.select("doc", "page", *[F.col(c).alias(f"a_{c}") for c in box], band(F.col("y0") - F.col("size"), F.col("y1") + F.col("size")).alias("band"))
    reach = F.greatest("a_size", "b_size")
    meet = lambda p, q: (F.col(f"a_{p}") - reach <= F.col(f"b_{q}")) & (F.col(f"b_{p}") - reach <= F.col(f"a_{q}"))
    near = wide.join(own, ["doc", "page", "band"]).where(meet("x0", "x1") & meet("y0", "y1")).select(
        "doc", "page", F.col("a_pos").alias("a"), F.col("b_pos").alias("b")).distinct()
    of = components(near, ["doc", "page"], "a", "b").withColumnRenamed("node", "pos").withColumnRenamed("component", "cluster")
    return large.join(of, ["doc", "page", "pos"])


def marks(clustered: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, cluster, text, size, box, pale, diagonal, repeated, accepted): what the clusters are.

    ``clustered`` needs light and on_background. A mark repeats where another page has the same text at a size and a centre
    within a tenth. Marks are dealt to cells of that tolerance: two pages in one cell are near enough as they are, so only
    marks alone in their cell look at the marks of the cells around.
    """
    order = F.struct("y0", "x0", "pos", F.lower("text").alias("t"))
    pale = F.col("light") & ~F.coalesce("on_background", F.lit(False))
    m = clustered.groupBy("doc", "page", "cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["t"]), " ").alias("text"),
        F.percentile("size", F.lit(0.5)).alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.every(F.coalesce(pale, F.lit(False))).alias("pale"), F.every(F.col("angle") % 90 != 0).alias("diagonal")).join(
        pages.select("doc", "page", "width", "height"), ["doc", "page"])
    least = pages.groupBy("doc").agg(F.min("width").alias("_w"), F.min("height").alias("_h"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    m = m.join(least, "doc").withColumn("cx", cx).withColumn("cy", cy)
    m = m.withColumn("px", F.floor(cx / (NEAR * F.col("_w")))).withColumn("py", F.floor(cy / (NEAR * F.col("_h")))).withColumn(
        "ps", F.floor(F.log(F.greatest("size", F.lit(1e-6))) / -F.log(F.lit(1 - NEAR))))
    cell = ["doc", "text", "px", "py", "ps"]
    held = m.groupBy(*cell).agg((F.count_distinct("page") > 1).alias("_many"))
    m = m.join(held, cell)
    around = lambda c, reach: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)).alias(c)
    lone = m.where("NOT _many").select("doc", "text", "page", "cluster", "cx", "cy", "size", "width", "height", "ps",
                                       F.ceil(F.col("width") / F.col("_w")).alias("_rx"), F.ceil(F.col("height") / F.col("_h")).alias("_ry"), "px", "py")
    lone = lone.select("*", F.explode(F.sequence(F.col("px") - F.col("_rx"), F.col("px") + F.col("_rx"))).alias("nx")).select(
        "*", F.explode(F.sequence(F.col("py") - F.col("_ry"), F.col("py") + F.col("_ry"))).alias("ny")).drop("px", "py", "_rx", "_ry")
    lone = lone.withColumnRenamed("ps", "_ps").select("*", F.explode(F.sequence(F.col("_ps") - 1, F.col("_ps") + 1)).alias("ps")).drop("_ps")
    there = m.select("doc", "text", "ps", F.col("px").alias("nx"), F.col("py").alias("ny"), F.col("page").alias("o_page"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("size").alias("os"))
    close = (F.abs(F.col("os") - F.col("size")) <= NEAR * F.greatest("size", "os")) & (F.abs(F.col("ox") - F.col("cx")) <= NEAR * F.col("width")) & (
        F.abs(F.col("oy") - F.col("cy")) <= NEAR * F.col("height")) & (F.col("o_page") != F.col("page"))
    found = lone.join(there, ["doc", "text", "ps", "nx", "ny"]).where(close).select("doc", "page", "cluster").distinct().withColumn("_near", F.lit(True))
    repeated = F.col("_many") | F.coalesce("_near", F.lit(False))
    return m.join(found, ["doc", "page", "cluster"], "left").withColumn("repeated", repeated).withColumn(
        "accepted", F.col("pale") | (F.col("diagonal") & repeated)).select(
        "doc", "page", "cluster", "text", "size", "x0", "y0", "x1", "y1", "width", "height", "pale", "diagonal", "repeated", "accepted")


def shares_slot(a: str, b: str) -> Column:
    """Two boxes overlap, or begin at the same corner within a tenth of the page of ``a``."""
    c = lambda side, n: F.col(f"{side}.{n}")
    overlap = (c(a, "x0") <= c(b, "x1")) & (c(b, "x0") <= c(a, "x1")) & (c(a, "y0") <= c(b, "y1")) & (c(b, "y0") <= c(a, "y1"))
    corner = (F.abs(c(a, "x0") - c(b, "x0")) <= NEAR * c(a, "width")) & (F.abs(c(a, "y0") - c(b, "y0")) <= NEAR * c(a, "height"))
    return overlap | corner


def agreed(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks of both sides (doc is the pair); neither mark of a slot stays accepted where it holds other text on the other side.

    A page's marks are clusters of large words, so few meet on a page.
    """
    slot = lambda side, other: shares_slot(side, other) & F.col(f"{side}.accepted")
    clash = left.alias("l").join(right.alias("r"), (F.col("l.doc") == F.col("r.doc")) & (F.col("l.page") == F.col("r.page")) & (
        F.col("l.text") != F.col("r.text")) & (slot("l", "r") | slot("r", "l")))
    key = ["doc", "page", "cluster"]
    bad = [clash.select(*[F.col(f"{s}.{c}").alias(c) for c in key]).distinct().withColumn("_bad", F.lit(True)) for s in ("l", "r")]
    return tuple(side.join(b, key, "left").withColumn("accepted", F.col("accepted") & F.col("_bad").isNull()).drop("_bad")
                 for side, b in zip((left, right), bad))


def marked_words(clustered: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc, page, pos, zone): the words of accepted marks."""
    return clustered.join(accepted.where("accepted").select("doc", "page", "cluster"), ["doc", "page", "cluster"]).select(
        "doc", "page", "pos", F.lit("filigrana").alias("zone"))
