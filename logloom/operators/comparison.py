"""The whole comparison of document pairs: every stage over all pairs at once, from blocks and words to numbered differences.

Stages: alignment, reading order (moved blocks are read at their partner's place), noise over keys, word changes between aligned
pairs, cuts at unmatched blocks and far gaps, style runs and placeholder noise, moves, sections, classes, types, anchors. Rows are
keyed by ``pair_id``; windows run over one side of one pair. Results that several stages read are written once by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_merge, cut_lineage, stored
from . import diff as D
from .intervals import within
from .noise import LINE_CAP
from .noise_keys import noise_over_keys
from .regions import split_at_bounds, spread_changes, unmatched_ranges
from .review import anchors_told_apart

# Fixed value: sizes nearer than this are the same style, in points.
SIZE_TOLERANCE = 0.5
SIDE = ["pair_id", "side"]
CHANGE = ["pair_id", "op", "i1", "i2", "j1", "j2", "left_keys", "right_keys"]


def strong_pairs(aligned: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair_id, l, r): aligned blocks that say the same thing, without leaders: equal, or alike to the ratio of a move."""
    keys = F.filter(F.transform("keys", lambda k: F.regexp_replace(k, r"[._]{4,}", "")), lambda k: k != "")
    b = blocks.select(*SIDE, "block", keys.alias("k"))
    side = lambda s, c: b.where(F.col("side") == s).select("pair_id", F.col("block").alias(c), F.col("k").alias(f"{c}k"))
    j = aligned.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select("pair_id", "l", "r").join(by_merge(side("L", "l")), ["pair_id", "l"]).join(by_merge(side("R", "r")), ["pair_id", "r"])
    same = j.where(F.col("lk") == F.col("rk")).select("pair_id", "l", "r")
    n = F.size("lk") + F.size("rk")
    other = j.where((F.col("lk") != F.col("rk")) & (2 * F.least(F.size("lk"), F.size("rk")) >= D.MOVE_RATIO * n))
    return same.unionByName(other.where(D.sequence_ratio("lk", "rk") >= D.MOVE_RATIO).select("pair_id", "l", "r"))


def reading_order(aligned: DataFrame, strong: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, r, ord) of the generated blocks as the word diff reads them, and the moved runs (pair_id, l1, l2, r1, r2).

    Strong pairs out of the increasing order are moves; their blocks are read after the generated block of the nearest pair before
    that is in order. All others stay where they are.
    """
    marked = cut_lineage(D.monotone(strong))
    moves = D.block_moves(strong, marked)
    moved = within(moves.select("pair_id", F.col("l1").alias("_lo"), (F.col("l2") + 1).alias("_hi"), F.col("l1").alias("first")),
                   marked.where("NOT kept").select("pair_id", "l", "r"), ["pair_id"], ("_lo", "_hi"), "l").select("pair_id", "first", "l", "r")
    pairs = aligned.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select("pair_id", "l", "r")
    steady = D.monotone(pairs.join(by_merge(moved.select("pair_id", "r")), ["pair_id", "r"], "left_anti")).where("kept").select("pair_id", "l", "r")
    # the last steady pair before each moved run: carried along the target blocks
    events = steady.select("pair_id", F.col("l").alias("at"), F.lit(0).alias("kind"), F.col("r").alias("after"), F.lit(None).cast("bigint").alias("r"), "l").unionByName(
        moved.select("pair_id", F.col("first").alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("after"), "r", "l"))
    w = Window.partitionBy("pair_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = events.withColumn("after", F.coalesce("after", F.last("after", ignorenulls=True).over(w))).where("kind = -1").select(
        "pair_id", "r", F.struct(F.coalesce("after", F.lit(-1).cast("bigint")).alias("a"), F.lit(1).alias("b"), F.col("l").cast("bigint").alias("c")).alias("key"))
    own = F.struct(F.col("r").cast("bigint").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("c"))
    every = blocks.where(F.col("side") == "R").select("pair_id", F.col("block").alias("r")).join(by_merge(placed), ["pair_id", "r"], "left").withColumn("key", F.coalesce("key", own))
    order = every.withColumn("ord", (F.row_number().over(Window.partitionBy("pair_id").orderBy("key")) - 1).cast("bigint"))
    return order.select("pair_id", "r", "ord"), moves


def equal_keys(changes: DataFrame, words: DataFrame) -> DataFrame:
    """(pair_id, i, j): the keys that stand on both sides, outside the changes.

    A left key's partner lies as far on as the last change before it says: the changes and the keys of a side in one order, the
    change carried along.
    """
    left = words.where(F.col("side") == "L").select("pair_id", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("i1"), F.lit(None).cast("bigint").alias("j2"))
    events = left.unionByName(changes.select("pair_id", F.col("i2").alias("at"), F.lit(0).alias("kind"), "i1", "j2"))
    w, back = Window.partitionBy("pair_id").orderBy("at", "kind", "j2"), Window.partitionBy("pair_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("j2"))
    shift = F.when(F.col("kind") == 0, F.col("j2") - F.col("at"))
    e = events.withColumn("_by", F.last(shift, ignorenulls=True).over(w)).withColumn(
        "_next", F.last("i1", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    free = e.where((F.col("kind") == 1) & (F.col("_next").isNull() | (F.col("_next") > F.col("at"))))
    return free.select("pair_id", F.col("at").alias("i"), (F.col("at") + F.coalesce("_by", F.lit(0))).cast("bigint").alias("j"))


def quiet_changes(equal: DataFrame, words: DataFrame) -> DataFrame:
    """Changes under equal keys: other text behind a noise placeholder, and runs in another size or weight inside a block.

    Needs text, size, bold and block of the words; (pair_id, op, i1, i2, j1, j2, left_keys, right_keys, noise, style).
    """
    side = lambda s, at, p: words.where(F.col("side") == s).select("pair_id", F.col("pos").alias(at), *[F.col(c).alias(p + c) for c in ("key", "text", "size", "bold", "block")])
    j = equal.join(by_merge(side("L", "i", "a_")), ["pair_id", "i"]).join(by_merge(side("R", "j", "b_")), ["pair_id", "j"])
    noise = F.col("a_key").contains(D.NOISE)
    known = (F.col("a_size") > 0) & (F.col("b_size") > 0)
    restyled = ~noise & known & ((F.abs(F.col("a_size") - F.col("b_size")) > SIZE_TOLERANCE) | (F.col("a_bold") != F.col("b_bold")))
    j = j.withColumn("noise", noise & (F.col("a_text") != F.col("b_text"))).withColumn("style", F.coalesce(restyled, F.lit(False)))
    w = Window.partitionBy("pair_id").orderBy("i")
    joined = F.col("style") & F.lag("style").over(w) & (F.lag("i").over(w) == F.col("i") - 1) & (F.lag("j").over(w) == F.col("j") - 1) & (
        F.lag("a_block").over(w) == F.col("a_block")) & (F.lag("b_block").over(w) == F.col("b_block"))
    j = j.withColumn("_g", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(w)).where("noise OR style")
    g = j.groupBy("pair_id", "_g", "noise", "style").agg(
        F.min("i").alias("i1"), (F.max("i") + 1).alias("i2"), F.min("j").alias("j1"), (F.max("j") + 1).alias("j2"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "a_key"))), lambda x: x["a_key"]).alias("left_keys"))
    return g.withColumn("op", F.lit("cambiato")).withColumn("right_keys", F.col("left_keys")).select(*CHANGE, "noise", "style")


def _moved_texts(changes: DataFrame) -> DataFrame:
    """Changes with the texts that went from one place to another made one ``spostato`` each."""
    found = D.text_moves(changes).withColumnRenamed("j1", "_j1")
    gone = changes.where("op = 'mancante'").join(by_merge(found), ["pair_id", "i1"]).select(
        "pair_id", F.lit("spostato").alias("op"), "i1", "i2", F.col("_j1").alias("j1"), "left_keys")
    made = changes.where("op = 'in_piu'").select("pair_id", "j1", "j2", "right_keys")
    moves = gone.join(by_merge(made), ["pair_id", "j1"]).select(*CHANGE)
    keep = changes.join(by_merge(found.select("pair_id", "i1", F.lit("mancante").alias("op"))), ["pair_id", "i1", "op"], "left_anti").join(
        by_merge(found.select("pair_id", F.col("_j1").alias("j1"), F.lit("in_piu").alias("op"))), ["pair_id", "j1", "op"], "left_anti")
    return keep.select(*CHANGE).unionByName(moves)


def _with_texts(changes: DataFrame, words: DataFrame) -> DataFrame:
    """Adds left_text and right_text: the words as they were, before noise; and ``page``, of the first word on either side."""
    out = changes.withColumn("_id", F.struct("op", "i1", "i2", "j1", "j2"))
    for side, lo, hi, name in (("L", "i1", "i2", "left_text"), ("R", "j1", "j2", "right_text")):
        c = out.where(F.col(hi) > F.col(lo)).select("pair_id", "_id", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        w = words.where(F.col("side") == side).select("pair_id", "pos", "text", F.col("page").alias(f"_page{side}"))
        t = within(c, w, ["pair_id"], ("_lo", "_hi"), "pos").groupBy("pair_id", "_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias(name),
            F.min_by(f"_page{side}", "pos").alias(f"_page{side}"))
        out = out.join(by_merge(t), ["pair_id", "_id"], "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.withColumn("page", F.coalesce("_pageL", "_pageR", F.lit(0))).drop("_id", "_pageL", "_pageR")


def compare_pairs(words: DataFrame, blocks: DataFrame, rules: Sequence[tuple[str, str]] = (), cap: int | None = LINE_CAP) -> DataFrame:
    """(pair_id, id, page, op, klass, tipo, i1, i2, j1, j2, left_text, right_text, detail, context, target_text): all differences.

    ``words`` (pair_id, side, pos, key, block, page, x0, y0, x1, y1, size, bold, zone, ends_line), ``pos`` from 0 without holes in the
    reading order of a side; ``blocks`` (pair_id, side, block, keys, lines, size, kind). Positions in the result count final keys.
    """
    aligned = cut_lineage(D.align(blocks))
    order, moves = reading_order(aligned, cut_lineage(strong_pairs(aligned, blocks)), blocks)
    # the generated side in its reading order
    right = words.where(F.col("side") == "R").join(by_merge(order.select("pair_id", F.col("r").alias("block"), "ord")), ["pair_id", "block"])
    read = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord", "pos")) - 1
    text = F.col("key").alias("text")
    both = words.where(F.col("side") == "L").select(*words.columns, text).unionByName(
        right.withColumn("pos", read.cast("bigint")).select(*words.columns, text))
    both = stored(both)
    w = Window.partitionBy(*SIDE).orderBy("pos")
    lined = both.withColumn("ends_line", F.coalesce("ends_line", F.lit(False)) | (F.lead("block").over(w) != F.col("block")))
    final = noise_over_keys(lined.select(*SIDE, "pos", "key", "ends_line"), rules, by=SIDE, cap=cap)
    # a final key has the place of its first word, and the text of all of them
    facts = ("block", "page", "x0", "y0", "x1", "y1", "size", "bold", "zone")
    parts = final.select(*SIDE, F.col("n"), F.col("key").alias("_key"), F.explode(F.sequence("first", F.col("end") - 1)).alias("pos")).join(by_merge(both), [*SIDE, "pos"])
    keys = parts.groupBy(*SIDE, "n", "_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        *[F.min_by(c, "pos").alias(c) for c in facts]).withColumnRenamed("n", "pos").withColumnRenamed("_key", "key")
    keys = stored(keys)

    final_blocks = keys.groupBy(*SIDE, "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    spans = final_blocks.join(by_merge(blocks.select(*SIDE, "block", "lines")), [*SIDE, "block"]).select(*SIDE, "block", "start", "end", "lines")
    # pairs in the reading order of both sides bound the gaps
    place = lambda s, c: final_blocks.where(F.col("side") == s).select("pair_id", F.col("block").alias(c), F.col("start").alias(f"_{c}"))
    pairs = aligned.where(F.col("l").isNotNull() & F.col("r").isNotNull()).join(by_merge(place("L", "l")), ["pair_id", "l"]).join(by_merge(place("R", "r")), ["pair_id", "r"])
    at = pairs.select("pair_id", "l", "r", "_l", "_r")
    kept = D.monotone(at, "_l", "_r").where("kept").select("pair_id", F.col("l").alias("_l"), F.col("r").alias("_r"))
    sync = D.sync_pairs(at.join(by_merge(kept), ["pair_id", "_l", "_r"]), final_blocks, ordered=True)

    changes = D.word_changes(keys, cut_lineage(sync)).select(*CHANGE)
    changes = split_at_bounds(cut_lineage(changes), unmatched_ranges(aligned, spans))
    changes = cut_lineage(spread_changes(cut_lineage(changes), keys).select(*CHANGE))
    quiet = quiet_changes(equal_keys(changes, keys), keys)
    # moved blocks: the ranges of their runs on both sides
    run = lambda s, lo, hi, a, b: within(moves.select("pair_id", "l1", F.col(lo).alias("_lo"), (F.col(hi) + 1).alias("_hi")), spans.where(F.col("side") == s).select("pair_id", "block", "start", "end"),
                                         ["pair_id"], ("_lo", "_hi"), "block").groupBy("pair_id", "l1").agg(F.min("start").alias(a), F.max("end").alias(b))
    none = F.array().cast("array<string>")
    block_moves = run("L", "l1", "l2", "i1", "i2").join(by_merge(run("R", "r1", "r2", "j1", "j2")), ["pair_id", "l1"]).select(
        "pair_id", F.lit("spostato").alias("op"), "i1", "i2", "j1", "j2", none.alias("left_keys"), none.alias("right_keys"))
    plain = D.sections(_moved_texts(changes), spans)
    no = F.lit(False)
    every = plain.withColumn("noise", no).withColumn("style", no).unionByName(
        block_moves.withColumn("detail", F.lit("")).withColumn("noise", no).withColumn("style", no)).unionByName(quiet.withColumn("detail", F.lit("")))
    n_pages = keys.groupBy("pair_id").agg(*[F.count_distinct(F.when(F.col("side") == s, F.col("page"))).alias(s) for s in ("L", "R")]).where("L <> R AND L > 0 AND R > 0")
    pages = n_pages.select("pair_id", F.lit("pagine").alias("op"), *[F.lit(0).cast("bigint").alias(c) for c in ("i1", "i2", "j1", "j2")], none.alias("left_keys"), none.alias("right_keys"),
                           F.format_string("%d pagine contro %d", "L", "R").alias("detail"), no.alias("noise"), no.alias("style"))
    d = _with_texts(every.unionByName(pages), keys)
    klass = F.when(F.col("noise"), "rumore").otherwise(D.classify(F.col("op"), F.col("left_keys"), F.col("right_keys"), style=F.col("style")))
    d = cut_lineage(D.with_type(d.withColumn("klass", klass)))
    d = D.with_context(d, keys).withColumn("target_text", F.col("left_text")).withColumn("pos", _order(d))
    d = anchors_told_apart(d, ["pair_id"], ["page", "pos"])
    return d.withColumn("id", F.row_number().over(Window.partitionBy("pair_id").orderBy("page", "pos"))).select(
        "pair_id", "id", "page", "op", "klass", "tipo", "i1", "i2", "j1", "j2", "left_text", "right_text", "detail", "context", "target_text")


def _order(d: DataFrame) -> Column:
    """Differences of a page in target order, the difference of page numbers before all."""
    return F.struct(F.when(F.col("op") == "pagine", 0).otherwise(1).alias("first"), "i1", "j1", "i2", "j2", "op")
