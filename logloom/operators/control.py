"""Words that a control execution proves to be values: printed where the perturbed value is printed in the control.

A difference between a generation and its control proves a word only if a whole original value stands in it and the whole
perturbed value stands at the same place of the other side. Values meet the differences' words on their rarest token alone; the other
tokens are then read by position in the difference's own row, so that a common word in a value joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import squeeze
from ..functions.text import epoch_days, italian_number
from ..session import by_merge
from .intervals import marked

KEY = ["pair_id", "id"]
# What is cut from the ends of a word, and the forms of dates and plain numbers in a payload.
EDGE_CUT = r"""^[(\[{«"'“”‘’]+|[)\]}»"'“”‘’.,;:!?]+$"""
EPOCH_MS, ISO_DATE, PLAIN_NUMBER = r"^\d{12,13}$", r"^(\d{4})-(\d{2})-(\d{2})(?:T.*)?$", r"^-?\d+(?:\.\d+)?$"
TEXT_CLASSES = ("testo", "zona", "variabile", "rumore", "arredo", "composizione")


def _core(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, EDGE_CUT, ""))


def _plain(number: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.concat(F.lit("n:"), F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def word_forms(word: Column) -> Column:
    """What a printed word can be read as: its text, and its number if it is one."""
    core = _core(word)
    number = italian_number(core)
    return F.array_compact(F.array(F.when(core != "", F.concat(F.lit("t:"), core)), F.when(number.isNotNull(), _plain(number))))


def printed_tokens(value: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: the words a value is printed as, in order, each with the forms it may take."""
    t = squeeze(value)
    iso = F.concat(F.lit("t:"), F.regexp_replace(t, ISO_DATE, "$3/$2/$1"))
    number = t.try_cast("decimal(38,18)")
    words = F.filter(F.transform(F.split(t, " "), _core), lambda w: w != "")
    return (F.when(t.rlike(EPOCH_MS), F.array(F.transform(epoch_days(t), lambda d: F.concat(F.lit("t:"), d))))
            .when(t.rlike(PLAIN_NUMBER) & number.isNotNull(), F.array(F.array(_plain(number))))
            .when(t.rlike(ISO_DATE), F.array(F.array(iso)))
            .otherwise(F.transform(words, lambda w: F.array(F.concat(F.lit("t:"), w)))))


def value_places(words: DataFrame, values: DataFrame) -> DataFrame:
    """(pair_id, id, value_id, side, start, n): where whole values stand in rows of words.

    ``words`` (pair_id, id, side, keys); ``values`` (pair_id, value_id, side, tokens), looked for on their side only.
    """
    w = words.withColumn("forms", F.transform("keys", word_forms)).drop("keys")
    placed = w.select(*KEY, "side", F.posexplode("forms").alias("at", "f")).select(*KEY, "side", "at", F.explode("f").alias("form"))
    common = placed.groupBy("pair_id", "side", "form").agg(F.count("*").alias("df"))
    v = values.where(F.size("tokens") > 0)
    token = v.select("pair_id", "value_id", "side", F.posexplode("tokens").alias("k", "t")).select("pair_id", "value_id", "side", "k", F.explode("t").alias("form"))
    seen = token.join(by_merge(common), ["pair_id", "side", "form"]).groupBy("pair_id", "value_id", "side", "k").agg(F.sum("df").alias("df"))
    # a value of which a token is nowhere is nowhere
    per = seen.groupBy("pair_id", "value_id", "side").agg(F.count("*").alias("there"), F.min_by("k", F.struct("df", "k")).alias("k"))
    rare = v.select("pair_id", "value_id", "side", "tokens", F.size("tokens").alias("n")).join(by_merge(per), ["pair_id", "value_id", "side"]).where("there = n").drop("there")
    seeds = rare.select("pair_id", "value_id", "side", "k").join(by_merge(token), ["pair_id", "value_id", "side", "k"]).join(
        by_merge(placed), ["pair_id", "side", "form"])
    starts = seeds.select(*KEY, "value_id", "side", (F.col("at") - F.col("k")).alias("start")).where("start >= 0").distinct()
    j = starts.join(by_merge(rare.drop("k")), ["pair_id", "value_id", "side"]).join(by_merge(w), [*KEY, "side"]).where(F.col("start") + F.col("n") <= F.size("forms"))
    here = F.zip_with(F.slice("forms", F.col("start") + 1, F.col("n")), "tokens", F.arrays_overlap)
    return j.where(F.forall(here, lambda x: x)).select(*KEY, "value_id", "side", "start", "n")


def same_place_words(diffs: DataFrame, changed: DataFrame) -> DataFrame:
    """(pair_id, id, value_id, start, n): words of the generation that the control proves to be values.

    ``diffs`` (pair_id, id, op, klass, left_keys, right_keys) of generation against control; ``changed`` (pair_id, value_id,
    original, perturbed). The whole original value stands on the left at a place where the whole perturbed one stands on the right.
    """
    d = diffs.where(F.col("klass").isin(*TEXT_CLASSES) & (F.col("op") != "spostato"))
    words = d.select(*KEY, F.lit("L").alias("side"), F.col("left_keys").alias("keys")).unionByName(
        d.select(*KEY, F.lit("R").alias("side"), F.col("right_keys").alias("keys")))
    of = lambda side, c: changed.select("pair_id", "value_id", F.lit(side).alias("side"), printed_tokens(F.col(c)).alias("tokens"))
    places = value_places(words, of("L", "original").unionByName(of("R", "perturbed")))
    right = places.where("side = 'R'").select(*KEY, "value_id", "start")
    return places.where("side = 'L'").drop("side").join(by_merge(right), [*KEY, "value_id", "start"], "left_semi")


def display_context(changes: DataFrame, words: DataFrame, width: int = 5) -> DataFrame:
    """``changes`` (pair_id, i1, i2) with ``before`` and ``after``: up to ``width`` target words around, all of one block.

    The block is that of the nearest word: the change's own, or the neighbour's where the change begins or ends its block.
    ``words`` (pair_id, side, pos, text, block).
    """
    left = words.where(F.col("side") == "L").select("pair_id", "pos", "text", "block")
    w = Window.partitionBy("pair_id", "block").orderBy("pos")
    text = lambda lo, hi: F.array_join(F.collect_list("text").over(w.rowsBetween(lo, hi)), " ")
    told = left.select("pair_id", "pos", text(1 - width, 0).alias("before"), text(0, width - 1).alias("after"))
    at = told.withColumnRenamed("pos", "_at")
    j = marked(changes.withColumn("_at", F.col("i1") - 1), at, ["pair_id", "_at"], "before")
    j = marked(j.withColumn("_at", F.col("i2")), at, ["pair_id", "_at"], "after")
    return j.select(*changes.columns, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def empty_places(changes: DataFrame, words: DataFrame) -> DataFrame:
    """Changes with ``empty_at``: where an empty side would stand: its word right before the place, else the one right after.

    ``words`` (pair_id, side, pos, page, x0, y0, x1, y1). Null for a side that has words, or none at all.
    """
    box = F.struct("page", "x0", "y0", "x1", "y1")
    at = words.select("pair_id", "side", "pos", box.alias("box"))
    side = F.when((F.col("i1") == F.col("i2")) & (F.col("j1") < F.col("j2")), "L").when((F.col("j1") == F.col("j2")) & (F.col("i1") < F.col("i2")), "R")
    c = changes.withColumn("side", side).withColumn("_k", F.when(F.col("side") == "L", F.col("i1")).otherwise(F.col("j1")))
    j = c.join(at.select("pair_id", "side", (F.col("pos") + 1).alias("_k"), F.col("box").alias("_b")), ["pair_id", "side", "_k"], "left").join(
        at.select("pair_id", "side", F.col("pos").alias("_k"), F.col("box").alias("_a")), ["pair_id", "side", "_k"], "left")
    return j.select(*changes.columns, F.coalesce("_b", "_a").alias("empty_at"))


def generated_texts(diffs: DataFrame, key: list[str], column: str = "right_text", out: str = "generated") -> DataFrame:
    """``diffs`` with the normal form of the generated text, which tolerances and marks are matched on.

    Each word in its normal form, joined by one blank. Words are normalised once each: the distinct words of all texts go through
    the vocabulary of the normal form, not the texts.
    """
    from .noise import with_normal_form

    words = diffs.select(*key, F.posexplode(F.filter(F.split(F.coalesce(column, F.lit("")), r"(?U)\s+"), lambda w: w != "")).alias("_k", "text"))
    forms = with_normal_form(words.select("text").distinct())
    told = words.join(forms, "text").where(F.col("key") != "").groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "key"))), lambda x: x["key"]), " ").alias("_g"))
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    return diffs.alias("d").join(told.alias("t"), cond, "left").select("d.*", F.coalesce("t._g", F.lit("")).alias(out))
