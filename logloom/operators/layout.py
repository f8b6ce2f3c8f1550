"""Zones, columns and rooms of positioned pages, from words and line tables.

Windows are over one page or one document. Comparisons across pages are group counts or equi
joins on a rounded place, never a product of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_merge
from .intervals import marked, within

# Bands of a page (share of its height), ratios and gaps.
HEAD_BAND, FOOT_BAND = 0.20, 0.70
FOOT_REPEAT_BAND, NUMBER_BAND = 0.88, 0.08
REPEAT_SHARE, LEADER_SHARE = 0.5, 0.6
TITLE, TITLE_STRONG, PITCH = 1.2, 1.3, 1.6
APART, ALIKE = 2.2, 0.7
WATERMARK, DIAGONAL, NEAR = 3.0, 2.0, 0.10
SAME_Y = 4.0
DIVIDER_WIDTH, DIVIDER_HEIGHT = 0.6, 7.0
CORRIDOR_CHARS, CROSSING, COLUMN_SHARE, MAX_CORRIDORS = 3.0, 0.2, 0.3, 2
PAGE_TAIL = r"(?i)(?:\bpag(?:ina|\.)?\s*)?\b(\d{1,3})\s*(?:di|/|of)\s*(\d{1,3})\s*$"
PAGE_ALONE = r"(?i)^(?:(?:pag(?:ina|\.)?\s*)?(\d{1,3})|-\s*(\d{1,3})\s*-)$"
UNITS = ("euro", "eur", "cent", "centesimi", "anno", "anni", "mese", "mesi", "giorno", "giorni", "gg", "€", "%")
COMPARED_ZONES = ("header", "titolo", "footer", "spalla_sx", "spalla_dx", "numero_pagina", "filigrana")


def body_size(words: DataFrame) -> DataFrame:
    """The commonest size of each document: the body."""
    return words.where(F.col("size") > 0).groupBy("doc").agg(F.mode("size").alias("body"))


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines repeated at one place on at least half of the pages (60 % with a leader).

    Lines meet by text and rounded height; the counts are map-side.
    """
    band = F.round(F.col("y0") / SAME_Y)
    l = lines.withColumn("band", band).withColumn("leader", F.col("text").rlike(r"[._…]{4,}"))
    n = pages.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"), F.max("height").alias("height"))
    g = l.groupBy("doc", "text", "band").agg(
        F.count_distinct("page").alias("on_pages"), F.max("leader").alias("leader"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).join(n, "doc")
    share = F.when(F.col("leader"), LEADER_SHARE).otherwise(REPEAT_SHARE)
    zone = F.when(F.col("y1") <= HEAD_BAND * F.col("height"), "header").when(F.col("y0") >= FOOT_BAND * F.col("height"), "footer")
    return g.where((F.col("n_pages") > 1) & (F.col("on_pages") >= share * F.col("n_pages"))).withColumn("zone", zone).where(F.col("zone").isNotNull())


def limits(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Header and footer limits per page from wide thin dividers; the document's usual value where a page has none."""
    p = paths.join(pages, ["doc", "page"])
    wide = (F.col("x1") - F.col("x0") >= DIVIDER_WIDTH * F.col("width")) & (F.col("y1") - F.col("y0") <= DIVIDER_HEIGHT)
    p = p.where(wide)
    own = p.groupBy("doc", "page").agg(
        F.max(F.when(F.col("y1") <= HEAD_BAND * F.col("height"), F.col("y1"))).alias("head"),
        F.min(F.when(F.col("y0") >= FOOT_BAND * F.col("height"), F.col("y0"))).alias("foot"))
    usual = own.groupBy("doc").agg(F.mode("head").alias("uh"), F.mode("foot").alias("uf"))
    return pages.select("doc", "page").join(own, ["doc", "page"], "left").join(usual, "doc", "left").select(
        "doc", "page", F.coalesce("head", "uh").alias("head"), F.coalesce("foot", "uf").alias("foot"))


def adopt(own: DataFrame, other: DataFrame) -> DataFrame:
    """Limits taken from the other side's same page, else its usual value, where a side has none."""
    usual = other.groupBy("doc").agg(F.mode("head").alias("uh"), F.mode("foot").alias("uf"))
    o = other.select("doc", "page", F.col("head").alias("oh"), F.col("foot").alias("of"))
    return own.join(o, ["doc", "page"], "left").join(usual, "doc", "left").select(
        "doc", "page", F.coalesce("head", "oh", "uh").alias("head"), F.coalesce("foot", "of", "uf").alias("foot"))


def set_apart(lines: DataFrame) -> DataFrame:
    """The first and last blocks of a page set apart by a gap over 2.2 sizes: ``apart`` top or bottom."""
    w = Window.partitionBy("doc", "page").orderBy("y0")
    gap = F.col("y0") - F.lag("y1").over(w)
    d = lines.withColumn("_isl", F.sum(F.coalesce(gap > APART * F.col("size"), F.lit(False)).cast("int")).over(w))
    n = F.max("_isl").over(Window.partitionBy("doc", "page"))
    return d.withColumn("_n", n).withColumn(
        "apart", F.when((F.col("_n") > 0) & (F.col("_isl") == 0), "top").when((F.col("_n") > 0) & (F.col("_isl") == F.col("_n")), "bottom")).drop("_isl", "_n")


def guided_lines(lines: DataFrame, zoned: DataFrame) -> DataFrame:
    """Body lines at least 0.7 alike (Jaccard of words) a header or footer line of the other side in the same band."""
    tok = lambda d, p: d.select("doc", F.col("line_id").alias(p), F.round(F.col("y0") / 50).alias("band"),
                                F.array_distinct(F.split(F.lower("text"), r"\s+")).alias(f"{p}w"))
    a, b = tok(lines, "a"), tok(zoned, "b")
    j = a.withColumn("w", F.explode("aw")).join(b.withColumn("w", F.explode("bw")), ["doc", "band", "w"]).groupBy("doc", "a", "b").agg(
        F.count("*").alias("common"), F.max(F.size("aw")).alias("na"), F.max(F.size("bw")).alias("nb"))
    jac = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return j.where(jac >= ALIKE).select("doc", F.col("a").alias("line_id"), F.col("b").alias("like_id"))


def page_numbers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Page-number lines at the edges: «1 di 3», «Pag. 2», or a number alone in step with the page index."""
    l = lines.join(pages, ["doc", "page"])
    edge = (F.col("y0") >= (1 - NUMBER_BAND) * F.col("height")) | (F.col("y1") <= NUMBER_BAND * F.col("height"))
    tail = F.nullif(F.regexp_extract("text", PAGE_TAIL, 1), F.lit("")).try_cast("int")
    alone = F.coalesce(F.nullif(F.regexp_extract("text", PAGE_ALONE, 1), F.lit("")), F.nullif(F.regexp_extract("text", PAGE_ALONE, 2), F.lit(""))).try_cast("int")
    l = l.where(edge).withColumn("n", F.coalesce(tail, alone)).withColumn("sure", tail.isNotNull()).where(F.col("n").isNotNull())
    step = l.groupBy("doc").agg(F.mode(F.col("n") - F.col("page")).alias("step"), F.count_distinct("page").alias("k"))
    return l.join(step, "doc").where((F.col("n") - F.col("page") == F.col("step")) & (F.col("sure") | (F.col("k") > 1))).select("doc", "page", "line", "n")


def titles(lines: DataFrame, body: DataFrame, pages: DataFrame) -> DataFrame:
    """The title: the first big line in the upper half of page 0 and the tight big lines after it."""
    l = lines.where(F.col("page") == 0).join(body, "doc").join(pages.where(F.col("page") == 0), ["doc", "page"])
    up = l.where(F.col("y1") <= 0.5 * F.col("height"))
    first = up.groupBy("doc").agg(
        F.min(F.when(F.col("size") >= TITLE_STRONG * F.col("body"), F.col("line"))).alias("strong"),
        F.min(F.when(F.col("size") >= TITLE * F.col("body"), F.col("line"))).alias("weak"))
    first = first.select("doc", F.coalesce("strong", "weak").alias("first")).where(F.col("first").isNotNull())
    t = up.join(first, "doc").where(F.col("line") >= F.col("first"))
    w = Window.partitionBy("doc").orderBy("line")
    stop = F.coalesce((F.col("y1") - F.lag("y1").over(w) > PITCH * F.col("size")) | (F.col("size") < TITLE * F.col("body")), F.lit(False))
    return t.withColumn("_s", F.max(stop.cast("int")).over(w)).where(F.col("_s") == 0).select("doc", "page", "line", "text")


def shoulders(words: DataFrame) -> DataFrame:
    """Rotated words left or right of the page's horizontal text."""
    flat = words.where(F.col("angle") == 0).groupBy("doc", "page").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    side = F.when(F.col("x1") <= F.col("lo"), "spalla_sx").when(F.col("x0") >= F.col("hi"), "spalla_dx")
    return words.where(F.col("angle") != 0).join(flat, ["doc", "page"]).withColumn("zone", side).where(F.col("zone").isNotNull()).drop("lo", "hi")


def zone_words(words: DataFrame, marks: DataFrame) -> DataFrame:
    """Every word with its zone by precedence; ``marks`` (doc, page, pos, zone) may hold several per word."""
    order = F.lit(len(COMPARED_ZONES))
    for i, z in reversed(list(enumerate(("filigrana", "spalla_sx", "spalla_dx", "numero_pagina", "titolo", "header", "footer")))):
        order = F.when(F.col("zone") == z, i).otherwise(order)
    best = marks.groupBy("doc", "page", "pos").agg(F.min_by("zone", order).alias("zone"))
    return marked(words, best, ["doc", "page", "pos"], "zone").withColumn("zone", F.coalesce("zone", F.lit("corpo")))


def zone_boxes(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "page", "zone").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def zone_texts(words: DataFrame) -> DataFrame:
    """One chunk per (doc, zone, page): text in reading order and its offset among the document's chunks."""
    z = words.where(F.col("zone").isin(*COMPARED_ZONES))
    t = z.groupBy("doc", "zone", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"))
    w = Window.partitionBy("doc").orderBy("zone", "page")
    n = F.length("text") + 1
    return t.withColumn("offset", F.sum(n).over(w) - n)


def zone_differences(changes: DataFrame) -> DataFrame:
    """Equal zone differences on several pages as one; a text gone on one page and added on another is a move.

    ``changes`` (pair_id, zone, page, op, left_text, right_text).
    """
    g = changes.groupBy("pair_id", "zone", "op", "left_text", "right_text").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    gone = g.where(F.col("op") == "mancante").select("pair_id", "zone", F.col("left_text").alias("t"), F.col("pages").alias("from_pages"))
    made = g.where(F.col("op") == "in_piu").select("pair_id", "zone", F.col("right_text").alias("t"), F.col("pages").alias("to_pages"))
    key = ["pair_id", "zone", "t"]
    moved = gone.join(made, key)
    moves = moved.select("pair_id", "zone", F.lit("spostato").alias("op"), F.col("t").alias("left_text"), F.col("t").alias("right_text"),
                         F.array_union("from_pages", "to_pages").alias("pages"))
    text = F.when(F.col("op") == "mancante", F.col("left_text")).when(F.col("op") == "in_piu", F.col("right_text"))
    rest = g.withColumn("t", text).join(moved.select(*key).distinct(), key, "left_anti").drop("t")
    return rest.select("pair_id", "zone", "op", "left_text", "right_text", "pages").unionByName(moves)


# ------------------------------------------------------------------- rooms ---

def geometry(words: DataFrame) -> DataFrame:
    """Adds the gap to the next word of the line, the line's typical space and the room to the line's edge."""
    w = Window.partitionBy("doc", "page", "line").orderBy("x0")
    g = words.dropna(subset=["doc", "page", "line"]).withColumn("gap", F.lead("x0").over(w) - F.col("x1"))
    g = g.withColumn("space", F.percentile("gap", F.lit(0.5)).over(Window.partitionBy("doc", "page", "line"))).withColumn(
        "edge", F.max("x1").over(Window.partitionBy("doc", "page")))
    return g.withColumn("room", F.coalesce("gap", F.col("edge") - F.col("x1")))


def holes(geo: DataFrame, char_width: DataFrame) -> DataFrame:
    """Gaps wide enough for a value: over 2.5 typical spaces and 2.5 characters."""
    return geo.join(char_width, "doc").where(
        (F.col("gap") > 2.5 * F.coalesce("space", F.lit(0.0))) & (F.col("gap") > 2.5 * F.col("char"))).select(
        "doc", "page", "line", F.col("x1").alias("x0"), (F.col("x1") + F.col("gap")).alias("x1"), F.col("text").alias("after"))


def empty_cells(rules: DataFrame, words: DataFrame) -> DataFrame:
    """Table cells (boxes between thin rules) holding no word, or only a unit."""
    at = words.select("doc", "page", "text", F.col("x0").alias("wx"), F.col("y0").alias("wy"))
    # cells and words meet in the same band of the page
    inside = within(rules.select("doc", "page", "cell", "x0", "x1", "y0", "y1"), at, ["doc", "page"], ("y0", "y1"), "wy", 16).where(
        (F.col("wx") >= F.col("x0")) & (F.col("wx") < F.col("x1")))
    n = inside.groupBy("doc", "page", "cell").agg(F.count_if(~F.lower("text").isin(*UNITS)).alias("n"))
    return rules.join(n, ["doc", "page", "cell"], "left").where(F.coalesce("n", F.lit(0)) == 0).drop("n")


def fits(width: Column, room: Column) -> Column:
    """A value fits a hole when the hole is 0.6 to 2 times its width."""
    return (room >= 0.6 * width) & (room <= 2.0 * width)


def value_runs(words: DataFrame) -> DataFrame:
    """Value runs of texts: tokens with a digit plus the separators, units and months next to them.

    ``words`` (doc, pos, text); islands over the core flag.
    """
    months = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
    w = Window.partitionBy("doc").orderBy("pos")
    core = F.col("text").rlike(r"\d")
    near = F.lower(F.col("text")).isin(*UNITS) | F.lower(F.col("text")).rlike(f"^(?:{months})$") | F.col("text").rlike(r"^[€%/().,:-]+$")
    d = words.withColumn("_c", core)
    touch = F.col("_c") | (near & (F.coalesce(F.lag("_c").over(w), F.lit(False)) | F.coalesce(F.lead("_c").over(w), F.lit(False))))
    d = d.withColumn("_t", touch)
    new = F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False))
    d = d.withColumn("_r", F.sum(new.cast("int")).over(w)).where("_t")
    return d.groupBy("doc", "_r").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("value")).drop("_r")


def fixed_values(values: DataFrame, words: DataFrame) -> DataFrame:
    """Multi-word values printed elsewhere in the target: (pair_id, value) that are fixed text."""
    from .payload import proven_words

    many = values.where(F.size(F.split("value", " ")) > 1)
    return proven_words(many, words).select("pair_id", "value").distinct()


def recognise(diffs: DataFrame, sites: DataFrame, proofs: DataFrame, fixed: DataFrame, switched_off: list[str] | None = None) -> DataFrame:
    """Variables: a difference with a position proof and a value proof becomes ``variabile``.

    ``sites`` (pair_id, id, prova) are holes, cells, placeholders; ``proofs`` (pair_id, id, proof, nome). Case,
    punctuation and spaces are never variables; a switched-off proof keeps counting with its
    ``prova`` set.
    """
    s = sites.groupBy("pair_id", "id").agg(F.min("prova").alias("_site"))
    p = proofs.groupBy("pair_id", "id").agg(F.min(F.struct("proof", "nome")).alias("_p"))
    f = fixed.select("pair_id", F.col("value").alias("right_text")).distinct().withColumn("_fixed", F.lit(True))
    j = diffs.join(s, ["pair_id", "id"], "left").join(p, ["pair_id", "id"], "left").join(f, ["pair_id", "right_text"], "left")
    ok = (
        F.col("_site").isNotNull() & F.col("_p").isNotNull() & F.col("_fixed").isNull()
        & ~F.col("tipo").isin("maiuscole", "punteggiatura", "spazi") & F.col("klass").isin("testo", "zona"))
    prova = F.when(F.col("_p.proof") == "listino", "listino").otherwise(F.col("_site"))
    off = prova.isin(*switched_off) if switched_off else F.lit(False)
    return j.withColumn("prova", F.when(ok, prova).otherwise("")).withColumn("nome", F.when(ok, F.col("_p.nome")).otherwise("")).withColumn(
        "klass", F.when(ok & ~off, "variabile").otherwise(F.col("klass"))).drop("_site", "_p", "_fixed")


# ------------------------------------------------------------------- slots ---

def slots(words: DataFrame) -> DataFrame:
    """Sure slots (leaders) and probable ones (a label ending in a colon at a line's end, or a known label)."""
    known = ("n°", "cap", "provincia", "località", "data")
    w = Window.partitionBy("doc").orderBy("pos")
    leader = F.col("key").rlike(r"[._]{4,}")
    label = F.col("key").rlike(":$") | F.lower("key").isin(*known)
    room = F.coalesce(F.lead("line").over(w) != F.col("line"), F.lit(True))
    kind = F.when(leader, "certo").when(label & room & ~F.coalesce(F.lead(leader).over(w), F.lit(False)), "probabile")
    return words.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("doc", "pos", "kind", F.regexp_replace("key", r"[._]{4,}", "").alias("label"))


def absorb(slot_changes: DataFrame, words: DataFrame) -> DataFrame:
    """What a slot takes in the generated text: to the next target key, never past a line end, ≤ 6 words when probable.

    ``slot_changes`` (doc, slot, kind, j1, j2, next_key); ``words`` (doc, pos, key, ends_line).
    """
    j = within(slot_changes, words.select("doc", "pos", "key", "ends_line"), ["doc"], ("j1", "j2"), "pos")
    g = j.groupBy("doc", "slot", "kind", "j1", "j2").agg(
        F.min(F.when(F.col("key") == F.col("next_key"), F.col("pos"))).alias("at_next"),
        F.min(F.when(F.col("ends_line"), F.col("pos") + 1)).alias("at_line"))
    end = F.least("j2", F.coalesce("at_next", "j2"), F.coalesce("at_line", "j2"))
    end = F.when(F.col("kind") == "probabile", F.least(end, F.col("j1") + 6)).otherwise(end)
    return g.select("doc", "slot", "j1", end.alias("j2"))


def hard_bounds(changes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Changes cut at the unmatched block ranges they hold whole: each range is a change of its own.

    ``changes`` (pair_id, i1, i2); ``ranges`` (pair_id, start, end, lines) of one side.
    """
    r = ranges.where(F.col("lines") >= 2)
    inside = within(changes.select("pair_id", "i1", "i2"), r.select("pair_id", "start", "end"), ["pair_id"], ("i1", "i2"), ("start", "end"), wide=True)
    own = inside.select("pair_id", "i1", "i2", F.col("start").alias("s"), F.col("end").alias("e"), F.lit(True).alias("section"))
    w = Window.partitionBy("pair_id", "i1", "i2").orderBy("s")
    before = own.select("pair_id", "i1", "i2", F.coalesce(F.lag("e").over(w), "i1").alias("s"), F.col("s").alias("e"))
    after = own.groupBy("pair_id", "i1", "i2").agg(F.max("e").alias("s")).select("pair_id", "i1", "i2", "s", F.col("i2").alias("e"))
    rest = before.unionByName(after).where(F.col("e") > F.col("s")).withColumn("section", F.lit(False))
    whole = changes.select("pair_id", "i1", "i2").join(by_merge(own.select("pair_id", "i1", "i2").distinct()), ["pair_id", "i1", "i2"], "left_anti").select(
        "pair_id", "i1", "i2", F.col("i1").alias("s"), F.col("i2").alias("e"), F.lit(False).alias("section"))
    return own.unionByName(rest).unionByName(whole)


def place_words(html_words: DataFrame, anchors: DataFrame, printed: DataFrame) -> DataFrame:
    """Boxes of HTML words from the printed words their anchors match; the gaps filled from the nearest placed neighbour."""
    p = printed.select("doc", F.col("pos").alias("j"), "page", "x0", "y0", "x1", "y1")
    j = html_words.join(anchors.select("doc", F.col("i").alias("pos"), "j"), ["doc", "pos"], "left").join(p, ["doc", "j"], "left")
    box = F.when(F.col("page").isNotNull(), F.struct("page", "x0", "y0", "x1", "y1"))
    w = Window.partitionBy("doc").orderBy("pos")
    filled = F.coalesce(box, F.last(box, ignorenulls=True).over(w), F.first(box, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return j.withColumn("_b", filled).select("doc", "pos", "key", "_b.*", box.isNotNull().alias("exact"))
