"""Column corridors of pages: a sweep over the cover of lines finds where few lines cross, line parts decide what is a gutter.

Rows are keyed by (doc, page); a page's lines bound every window and group. Corridors are looked for on all lines given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .intervals import marked
from .layout import COLUMN_SHARE, CORRIDOR_CHARS, CROSSING, MAX_CORRIDORS

# Lines that make a column, how near its lines come to the gutter, the share of lines an edge holds on, the
# tolerance of a column's left edge in points.
COLUMN_MIN_LINES, FILL, HOLD, EDGE = 3, 0.15, 0.9, 2.5
PAGE = ["doc", "page"]


def line_parts(words: DataFrame, char_width: DataFrame) -> DataFrame:
    """(doc, page, line, char, words, runs): each line's words by place, and their runs across gaps narrower than a corridor."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = marked(words, char_width.select("doc", F.struct("char").alias("_char")), ["doc"], "_char").where(F.col("_char").isNotNull())
    d = d.withColumn("char", F.col("_char.char")).drop("_char").withColumn("_new", F.coalesce(F.col("x0") - reach >= CORRIDOR_CHARS * F.col("char"), F.lit(True)))
    d = d.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    runs = d.groupBy(*PAGE, "line", "char", "_run").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list(F.struct("x0", "x1")).alias("_w"))
    return runs.groupBy(*PAGE, "line", "char").agg(
        F.array_sort(F.flatten(F.collect_list("_w"))).alias("words"), F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("runs"))


def _with_page(lines: DataFrame) -> DataFrame:
    """``lines`` with their page's number of lines, left and right edge and character width."""
    w = Window.partitionBy(*PAGE)
    facts = {"n": F.count("*"), "left": F.min(F.array_min(F.transform("words", lambda x: x["x0"]))),
             "right": F.max(F.array_max(F.transform("words", lambda x: x["x1"]))), "char": F.first("char")}
    return lines.dropna(subset=PAGE).select(*PAGE, "runs", *[c.over(w).alias(name) for name, c in facts.items()])


def candidates(lines: DataFrame) -> DataFrame:
    """(doc, page, …, b, cover, x): one place per stretch that at most a fifth of the lines cross, inside the page's text.

    A sweep over where runs begin and end gives the cover between events; stretches of low cover are islands, and their least
    crossed place (the middle one of equals) is counted out from the lengths, so nothing is spread over points.
    """
    page = _with_page(lines).where((F.col("n") >= 2 * COLUMN_MIN_LINES) & (F.col("char") > 0)).withColumn(
        "size", F.floor(F.col("right") - F.col("left")) + 1)
    known = [*PAGE, "n", "left", "right", "char", "size"]
    r = page.select(*known, F.inline("runs"))
    cut = lambda c, add: F.floor(F.col(c) - F.col("left")) + add
    ends = r.select(*known, F.inline(F.array(F.struct(cut("x0", 0).alias("at"), F.lit(1).alias("d")), F.struct(
        F.least(cut("x1", 1), F.col("size")).alias("at"), F.lit(-1).alias("d")))))
    events = ends.groupBy(*known, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("at")
    s = events.withColumn("cover", F.sum("d").over(w)).withColumn("to", F.lead("at").over(w)).where("to > at")
    s = s.withColumn("low", F.col("cover") <= CROSSING * F.col("n"))
    s = s.withColumn("_g", F.sum((~F.col("low")).cast("int")).over(w)).where("low")
    g = [*PAGE, "_g"]
    wg = Window.partitionBy(*g)
    s = s.withColumn("least", F.min("cover").over(wg)).withColumn("begin", F.min("at").over(wg)).withColumn("end", F.max("to").over(wg))
    s = s.where((F.col("cover") == F.col("least")) & (F.col("begin") > 0) & (F.col("end") < F.col("size")))
    length = F.col("to") - F.col("at")
    s = s.withColumn("upto", F.sum(length).over(wg.orderBy("at"))).withColumn("mid", F.floor(F.sum(length).over(wg) / 2))
    hit = s.where((F.col("mid") < F.col("upto")) & (F.col("mid") >= F.col("upto") - length))
    b = F.col("at") + F.col("mid") - (F.col("upto") - length)
    return hit.select(*PAGE, "n", "left", "right", "char", "size", b.alias("b"), "cover", (F.col("left") + b + 0.5).alias("x"))


def _some(words: Column, test) -> Column:
    return F.exists(words, test)


def measured(cand: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates that are corridors, with ``x0`` and ``x1``: the ends of the left parts, the starts of the right ones.

    A page's candidates come to its lines as one list; a line then stands once for each of them, and only numbers are grouped.
    """
    key = cand.columns
    given = cand.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in key if c not in PAGE])).alias("_c"))
    j = marked(lines.select(*PAGE, "words", "runs"), given, PAGE, "_c").where(F.col("_c").isNotNull()).select(*PAGE, "words", "runs", F.inline("_c"))
    clear = j.where(~F.exists("runs", lambda r: (r["x0"] <= F.col("x")) & (F.col("x") <= r["x1"])))
    before = F.array_max(F.transform(F.filter("runs", lambda r: r["x1"] < F.col("x")), lambda r: r["x1"]))
    after = F.array_min(F.transform(F.filter("runs", lambda r: r["x0"] > F.col("x")), lambda r: r["x0"]))
    w = Window.partitionBy(*key)
    g = clear.withColumn("ends", F.array_sort(F.collect_list(before).over(w))).withColumn("starts", F.array_sort(F.collect_list(after).over(w)))
    at = lambda a, share: F.get(a, F.floor(F.lit(share) * (F.size(a) - 1)).cast("int"))
    g = g.withColumn("x0", F.coalesce(at("ends", HOLD), F.col("left"))).withColumn("x1", F.coalesce(at("starts", 1 - HOLD), F.col("right")))
    x0, x1 = F.col("x0"), F.col("x1")
    g = g.where((x1 > x0) & (x1 - x0 >= CORRIDOR_CHARS * F.col("char")) & (x0 > F.col("left")) & (x1 < F.col("right")))
    left, right = F.filter("words", lambda w: w["x1"] <= x0), F.filter("words", lambda w: w["x0"] >= x1)
    g = g.groupBy(*key, "x0", "x1").agg(
        F.count("*").alias("clear"), F.count_if(F.size(left) > 0).alias("lefts"), F.count_if(F.size(right) > 0).alias("rights"),
        F.array_sort(F.collect_list(F.get(right, F.lit(0))["x0"])).alias("begin"), F.collect_list(F.array_max(F.transform(left, lambda w: w["x1"]))).alias("stop"))
    least = F.greatest(F.lit(COLUMN_MIN_LINES), F.floor(COLUMN_SHARE * F.col("clear")))
    # a column's left edge: enough lines start within twice the tolerance of one of them
    edge = F.exists(F.sequence(F.lit(0), F.greatest(F.size("begin") - COLUMN_MIN_LINES, F.lit(0))), lambda i: (
        F.get("begin", i + COLUMN_MIN_LINES - 1) - F.get("begin", i)) <= 2 * EDGE)
    full = F.size(F.filter("stop", lambda x: x >= x0 - FILL * (x0 - F.col("left"))))
    g = g.where((F.col("lefts") >= least) & (F.col("rights") >= least))
    return g.where((F.size("begin") >= COLUMN_MIN_LINES) & edge & (F.size("stop") > 0) & (full >= 0.5 * F.size("stop"))).select(*key, "x0", "x1")


def corridors(lines: DataFrame) -> DataFrame:
    """(doc, page, x0, x1): at most two page-wide corridors, the least crossed and most central first; they lie apart."""
    ok = cut_lineage(measured(candidates(lines), lines))
    order = [F.asc("cover"), F.asc(F.abs(F.col("b") - F.col("size") / 2)), F.asc("b")]
    key = F.struct("cover", F.abs(F.col("b") - F.col("size") / 2).alias("off"), "b", "x0", "x1", "x", "char")
    chosen = ok.groupBy(*PAGE).agg(F.min(key).alias("c")).select(*PAGE, F.col("c.x0").alias("g0"), F.col("c.x1").alias("g1"))
    width = CORRIDOR_CHARS * F.col("char")
    rest = ok.join(chosen, PAGE).where(
        ~F.col("x").between(F.col("g0") - width, F.col("g1") + width) & ~((F.col("x0") < F.col("g1")) & (F.col("x1") > F.col("g0"))))
    second = rest.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))).where(F.col("_r") < MAX_CORRIDORS)
    return chosen.select(*PAGE, F.col("g0").alias("x0"), F.col("g1").alias("x1")).unionByName(second.select(*PAGE, "x0", "x1"))


def page_columns(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, page, n, corridors): every page's lines counted, its corridors from left to right."""
    c = found.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("corridors"))
    return lines.groupBy(*PAGE).agg(F.count("*").alias("n")).join(c, PAGE, "left").withColumn(
        "corridors", F.coalesce("corridors", F.expr("cast(array() as array<struct<x0:double,x1:double>>)")))


def fitting(lines: DataFrame, given: DataFrame) -> DataFrame:
    """(doc, page) where the corridors ``given`` (doc, page, corridors) hold on these lines: few cross, words on both sides."""
    j = given.where(F.size("corridors") > 0).join(lines, PAGE)
    across = F.exists("corridors", lambda g: F.exists("runs", lambda r: (r["x0"] <= g["x0"]) & (r["x1"] >= g["x1"])))
    side = lambda test: F.transform("corridors", lambda g: F.exists("words", lambda w: test(w, g)).cast("int"))
    p = j.select(*PAGE, "line", across.alias("across"), F.posexplode(F.arrays_zip(
        side(lambda w, g: w["x1"] <= g["x0"]).alias("l"), side(lambda w, g: w["x0"] >= g["x1"]).alias("r"))).alias("k", "s"))
    per = p.groupBy(*PAGE, "k").agg(F.count("*").alias("n"), F.count_if("across").alias("a"), F.max("s.l").alias("l"), F.max("s.r").alias("r"))
    good = (F.col("a") <= CROSSING * F.col("n")) & (F.col("l") == 1) & (F.col("r") == 1)
    return per.groupBy(*PAGE).agg(F.every(good).alias("ok")).where("ok").select(*PAGE)


def borrowed(left: DataFrame, right: DataFrame, left_found: DataFrame, right_found: DataFrame) -> DataFrame:
    """(doc, page, side, corridors): what each side's page is read by.

    Where both sides have the page, the corridors of the side with more lines (the other's, if it has none) count for both if
    they fit the other side; else each side keeps its own. ``left`` and ``right`` are line parts of the two sides of a pair.
    """
    a, b = page_columns(left, left_found), page_columns(right, right_found)
    j = a.select(*PAGE, F.col("n").alias("ln"), F.col("corridors").alias("lc")).join(
        b.select(*PAGE, F.col("n").alias("rn"), F.col("corridors").alias("rc")), PAGE, "full_outer")
    both = F.col("ln").isNotNull() & F.col("rn").isNotNull()
    first_left = F.col("ln") >= F.col("rn")
    lender = F.when(first_left & (F.size("lc") > 0), "L").when(~first_left & (F.size("rc") > 0), "R").when(F.size("lc") > 0, "L").when(F.size("rc") > 0, "R")
    j = j.withColumn("lender", F.when(both, lender))
    lent = lambda side, c, to: fitting(to, j.where(F.col("lender") == side).select(*PAGE, F.col(c).alias("corridors"))).withColumn("fit", F.lit(True))
    fit = lent("L", "lc", right).unionByName(lent("R", "rc", left))
    j = j.join(fit, PAGE, "left").withColumn("common", F.when(F.col("fit"), F.when(F.col("lender") == "L", F.col("lc")).otherwise(F.col("rc"))))
    own = lambda side, n, c: j.where(F.col(n).isNotNull()).select(*PAGE, F.lit(side).alias("side"), F.coalesce("common", c).alias("corridors"))
    return own("L", "ln", "lc").unionByName(own("R", "rn", "rc"))
