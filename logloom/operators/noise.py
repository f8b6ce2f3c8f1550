"""Token normal form, units, noise rules and masks over token and line tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_LIST = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
# Characters unified or removed by the normal form.
QUOTES_FROM, QUOTES_TO = "‘’‚‛′`“”„‟″«»‹›‐‑‒–—―−﹘﹣－", "''''''" + '"""""""' + "''" + "-" * 10
BOXES_OFF, BOXES_ON = "❏❐❑❒☐□◻⬜", "☒☑⊠"
CHECK_OFF, CHECK_ON = "☐", "☒"
REMOVED = r"[­​‌‍⁠﻿]"
OPENING = r"""^[(\[{"'¿¡]+$"""
PUNCTUATION = r"^\p{P}+$"
LEADER = r"[._]{4,}"
COMB_MIN, COMB_TOLERANCE = 4, 0.25
GUARD = "⁣"
LINE_CAP = 2000
SLOW = "espressione potenzialmente troppo lenta: semplificala"
_MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
# The built-in rules, by name.
PRESETS = {
    "Numero di pagina nel testo": r"\b[Pp]ag(?:ina|\.)? ?\d+ ?(?:di|/) ?\d+\b|(?<![\d/.,])\b\d{1,3} ?/ ?\d{1,3}$",
    "Data": r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b|\b\d{1,2}°? (?i:" + _MONTHS + r") \d{4}\b",
    "IBAN": r"\bIT\d{2} ?[A-Z](?: ?[0-9A-Z]){22}\b|\b[A-Z]{2}\d{2}[0-9A-Z]{11,30}\b",
    "Codice fiscale": r"\b[A-Z]{6}[\dLMNP-V]{2}[A-EHLMPR-T][\dLMNP-V]{2}[A-Z][\dLMNP-V]{3}[A-Z]\b",
    "CAP": r"(?<![\d.,/])\b\d{5}\b(?![.,/]\d)",
    "Importo": r"€ ?-?\d+(?:\.\d{3})*(?:,\d+)?|\b\d+(?:\.\d{3})*,\d{2} ?(?:€|[Ee]uro\b|EUR\b)",
    "Marcatore di firma": r"['`]sig,[^'`\n]*['`]",
    "Parametri di tracciamento": r"(?<=[?&])(?i:utm_\w*|gclid|fbclid|msclkid|mkt_tok|mc_cid|mc_eid|_hsenc|_hsmktg)=[^&#\s]*",
}


def normal_form_native(token: Column) -> Column:
    """The normal form without the compatibility decomposition (exact for ASCII tokens)."""
    t = F.translate(token, QUOTES_FROM, QUOTES_TO)
    t = F.translate(F.translate(t, BOXES_OFF, CHECK_OFF * len(BOXES_OFF)), BOXES_ON, CHECK_ON * len(BOXES_ON))
    return F.regexp_replace(F.regexp_replace(t, REMOVED, ""), r"(?U)\s+", "")


@F.pandas_udf(T.StringType())
def nfkc(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in tokens:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def with_normal_form(tokens: DataFrame, column: str = "text", out: str = "key") -> DataFrame:
    """Adds the normal form of a token column.

    ASCII tokens stay in the JVM. Only the distinct other tokens go through Python, and the
    vocabulary is joined back, so a token seen a billion times is decomposed once.
    """
    ascii_ = F.col(column).rlike(r"^[\x00-\x7f]*$")
    plain = tokens.where(F.coalesce(ascii_, F.lit(True))).withColumn(out, normal_form_native(F.col(column)))
    other = tokens.where(~ascii_)
    vocabulary = other.select(column).distinct().withColumn(out, normal_form_native(nfkc(F.col(column))))
    return plain.unionByName(other.join(vocabulary, column))


def line_flags(words: DataFrame) -> DataFrame:
    """Adds ``ends_line``: the next word is on another page, below, or back to the left."""
    w = Window.partitionBy("doc").orderBy("pos")
    nxt = {c: F.lead(c).over(w) for c in ("page", "y0", "y1", "x0")}
    ends = (nxt["page"] != F.col("page")) | ((nxt["y0"] + nxt["y1"]) / 2 > F.col("y1")) | (nxt["x0"] < F.col("x0"))
    return words.withColumn("ends_line", F.coalesce(ends, F.lit(True)))


def mark_combs(words: DataFrame) -> DataFrame:
    """Adds ``comb``: the id of a comb field (≥ 4 one-character tokens at one pitch on a line), else NULL.

    Islands of one-character tokens first, then cut where the pitch leaves 25 % of the
    island's first pitch.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    one = F.col("key").rlike(r"^[\p{L}\p{N}]$")
    centre = (F.col("x0") + F.col("x1")) / 2
    d = words.withColumn("_c", centre).withColumn("_one", one)
    pitch = F.col("_c") - F.lag("_c").over(w)
    joined = F.coalesce(F.col("_one") & F.lag("_one").over(w) & ~F.lag("ends_line").over(w) & (pitch > 0), F.lit(False))
    d = d.withColumn("_pitch", F.when(joined, pitch)).withColumn("_isl", F.sum((~joined).cast("int")).over(w))
    wi = Window.partitionBy("doc", "_isl").orderBy("pos")
    first = F.first("_pitch", ignorenulls=True).over(wi.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bad = F.col("_pitch").isNotNull() & (F.abs(F.col("_pitch") - first) > COMB_TOLERANCE * first)
    d = d.withColumn("_cut", F.sum(F.coalesce(bad, F.lit(False)).cast("int")).over(wi))
    n = F.count("*").over(Window.partitionBy("doc", "_isl", "_cut"))
    return d.withColumn("comb", F.when(F.col("_one") & (n >= COMB_MIN), F.concat_ws("-", "_isl", "_cut"))).drop(
        "_c", "_one", "_pitch", "_isl", "_cut")


def units(words: DataFrame) -> DataFrame:
    """Comparison units of each document: (doc, unit, key, first, last).

    Needs doc, pos, text, key, page and the box. Comb fields and bracket boxes become one unit,
    a word split by a line-end hyphen is joined, punctuation sticks to the previous word and
    opening punctuation to the next.
    """
    d = mark_combs(line_flags(words.where(F.col("key") != "")))
    w = Window.partitionBy("doc").orderBy("pos")
    k1, k2 = F.lead("key", 1).over(w), F.lead("key", 2).over(w)
    same1, same2 = ~F.col("ends_line"), ~F.col("ends_line") & ~F.lead("ends_line").over(w)
    opens = F.col("key") == "["
    box2 = opens & (k1 == "]") & same1
    box3 = opens & k1.isin("x", "X") & (k2 == "]") & same2
    d = d.withColumn("_box", F.when(box2, 2).when(box3, 3).otherwise(0))
    prev_box = F.greatest(F.coalesce(F.lag("_box", 1).over(w), F.lit(0)) - 1, F.coalesce(F.lag("_box", 2).over(w), F.lit(0)) - 2)
    in_box = prev_box > 0
    starts = F.coalesce(F.lag("ends_line").over(w), F.lit(True))
    lone_q = (F.col("text") == "q") & starts & ~F.col("ends_line") & F.lead("key").over(w).isNotNull()
    stem = F.rtrim("text")
    hyphen = (
        (F.length(stem) > 1) & stem.rlike("[-‐­]$") & F.col("ends_line") & F.lead("text").over(w).rlike(r"^\p{Ll}")
        & F.col("comb").isNull())
    d = d.withColumn("_hyph", F.coalesce(hyphen, F.lit(False))).withColumn("_inbox", in_box)
    same_comb = F.coalesce(F.col("comb") == F.lag("comb").over(w), F.lit(False))
    glued = same_comb | F.col("_inbox") | F.coalesce(F.lag("_hyph").over(w), F.lit(False))
    key = (
        F.when(F.col("_box") == 2, CHECK_OFF).when(F.col("_box") == 3, CHECK_ON).when(F.col("_inbox"), "")
        .when(F.col("key") == "[]", CHECK_OFF).when(F.col("key").isin("[x]", "[X]"), CHECK_ON).when(lone_q, CHECK_OFF)
        .when(F.col("_hyph"), F.regexp_replace("key", "[-‐]$", "")).otherwise(F.col("key")))
    d = d.withColumn("_k", key).withColumn("_tok", F.sum((~glued).cast("int")).over(w))

    def joined(key_col: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(key_col).alias("k")))), lambda s: s["k"]), "")

    toks = d.groupBy("doc", "_tok").agg(joined("_k").alias("tkey"), F.min("pos").alias("pos"), F.max("pos").alias("last"))
    wt = Window.partitionBy("doc").orderBy("pos")
    punct, opening = F.col("tkey").rlike(PUNCTUATION), F.col("tkey").rlike(OPENING)
    t = toks.withColumn("_p", punct).withColumn("_open", punct & opening)
    # Opening punctuation waits for its word; while it waits, any punctuation joins it.
    t = t.withColumn("_prev_open", F.coalesce(F.lag("_open").over(wt), F.lit(False)))
    is_first = F.lag("pos").over(wt).isNull()
    begins = is_first | F.when(F.col("_p") & ~F.col("_open"), F.lit(False)).when(F.col("_prev_open"), F.lit(False)).otherwise(F.lit(True))
    t = t.withColumn("unit", F.sum(begins.cast("int")).over(wt))
    return t.groupBy("doc", "unit").agg(joined("tkey").alias("key"), F.min("pos").alias("first"), F.max("last").alias("last"))


def content_keys(keys: Column) -> Column:
    """Keys without slot leaders: a leader glued to its label leaves the label."""
    return F.filter(F.flatten(F.transform(keys, lambda k: F.split(k, LEADER))), lambda p: p != "")


# ------------------------------------------------------------------- rules ---

def compile_problem(name: object, pattern: object) -> str | None:
    """Why a rule cannot be used, or None. Runs on the driver over the small rule table."""
    if not isinstance(name, str) or not name.strip():
        return "nome vuoto" if isinstance(name, str) else "nome non valido"
    if not isinstance(pattern, str) or not pattern:
        return "espressione vuota" if isinstance(pattern, str) else "espressione non valida"
    try:
        re.compile(pattern, re.MULTILINE)
    except (re.error, OverflowError, RecursionError) as exc:
        return f"espressione non valida: {exc}"
    # A repeated group that itself holds an unbounded repeat or a back-reference.
    depth: list[bool] = []
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if depth and pattern[i + 1:i + 2].isdigit():
                depth[-1] = True
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth.append(False)
        elif c in "*+" or (c == "{" and re.match(r"\{\d*,\}", pattern[i:])):
            if depth:
                depth[-1] = True
        elif c == ")" and depth:
            risky = depth.pop()
            again = pattern[i + 1:i + 2] in ("*", "+") or re.match(r"\{(\d*,\}|\d*,?([2-9]|\d\d+)\})", pattern[i + 1:])
            if risky and again:
                return SLOW
            if depth and (risky or again):
                depth[-1] = True
        i += 1
    return None


def usable_rules(rules: list[tuple[str, str, bool]]) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """(enabled valid rules in order, message per unusable name); the first of a name wins."""
    good: list[tuple[str, str]] = []
    errors: dict[str, str] = {}
    seen: set[str] = set()
    for name, pattern, enabled in rules:
        problem = compile_problem(name, pattern)
        if problem is None and name in seen:
            problem = "nome duplicato"
        seen.add(name)
        if problem is not None:
            errors.setdefault(str(name), problem)
        elif enabled:
            good.append((name, pattern))
    return good, errors


def duplicate_rule_names(rules: DataFrame) -> DataFrame:
    return rules.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def hit_counts(lines: DataFrame, rules: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Hits per rule, each rule alone over the lines: one pass, one column per rule, then unpivoted."""
    sums = [F.sum(F.regexp_count("line", F.lit("(?m)" + p))).alias(f"r{i}") for i, (_n, p) in enumerate(rules)]
    wide = lines.groupBy(*by).agg(*sums)
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("bigint").alias("hits"))
                      for i, (n, _p) in enumerate(rules)])
    return wide.select(*by, F.inline(names))


def _placed(text: Column, pattern: str) -> Column:
    """(s, e) of every match: what ``split`` leaves before a match tells where it begins."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("spans"))

    both = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    return F.filter(F.aggregate(both, start, step, lambda acc: acc["spans"]), lambda x: x["e"] > x["s"])


def taken_spans(rows: DataFrame, text: str, rules: Sequence[tuple[str, str]], touching: bool = False) -> DataFrame:
    """Adds the spans of each rule's matches to ``_t`` (ARRAY<STRUCT<s,e,rule>>, what is taken already); the first rule wins.

    ``touching``: a match of nothing but spaces is none. A rule is only placed in texts that it matches somewhere.
    """
    out, line = rows, F.col(text)
    for i, (_name, pattern) in enumerate(rules):
        rule = f"(?m)(?:{pattern})"
        found = F.when(line.rlike(rule), _placed(line, rule)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))
        out = out.withColumn("_m", found)
        blank = lambda x: F.trim(F.substring(line, x["s"] + 1, x["e"] - x["s"])) == ""
        free = F.filter("_m", lambda x: ~F.exists("_t", lambda y: (x["s"] < y["e"]) & (x["e"] > y["s"])) & (
            ~blank(x) if touching else F.lit(True)))
        out = out.withColumn("_t", F.concat("_t", F.transform(free, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("rule"))))).drop("_m")
    return out


def apply_rules(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Lines with each match replaced by its rule's placeholder; ``hits`` per line.

    The first rule wins: a match that touches text an earlier rule took is no match. All rules read the line as it
    was, so none ever sees a placeholder; the line is put together once, from the spans.
    """
    out = lines.withColumn("_line", F.coalesce("line", F.lit(""))).withColumn(
        "_t", F.expr("cast(array() as array<struct<s:int,e:int,rule:int>>)"))
    line = F.col("_line")
    out = taken_spans(out, "_line", rules)
    marks = F.array(*[F.lit(f"{GUARD}NOISE:{name}") for name, _p in rules])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    told = F.aggregate(F.array_sort("_t"), start, lambda acc, x: F.struct(x["e"].alias("at"), F.concat(
        acc["text"], F.substring(line, acc["at"] + 1, x["s"] - acc["at"]), F.get(marks, x["rule"])).alias("text")),
        lambda acc: F.concat(acc["text"], F.substring(line, acc["at"] + 1, F.length(line))))
    total = F.array(*[F.struct(F.lit(n).alias("rule"), _taken_by(i).alias("n")) for i, (n, _p) in enumerate(rules)])
    return out.withColumn("noise_line", F.when(F.col("line").isNotNull(), told)).withColumn("hits", total).drop("line", "_line", "_t")


def _taken_by(rule: int) -> Column:
    return F.size(F.filter("_t", lambda x: x["rule"] == rule))


def match_spans(pattern: str):
    """Column function: ARRAY<STRUCT<start,end>> of every match in a line (no built-in says where)."""
    rx = re.compile(pattern, re.MULTILINE)

    @F.pandas_udf(SPAN_LIST)
    def spans(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lines:
            yield s.map(lambda t: [{"start": m.start(), "end": m.end()} for m in rx.finditer(t) if m.end() > m.start()],
                        na_action="ignore")

    return spans


def noise_ranges(hits: DataFrame) -> DataFrame:
    """Merged key ranges of overlapping hits (doc, first, last): islands over the running end."""
    w = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") > reach, F.lit(True))
    isl = hits.withColumn("_g", F.sum(new.cast("int")).over(w))
    return isl.groupBy("doc", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")


INNERMOST = r"(?s)\{\{((?:(?!\{\{|\}\}).)*+)\}\}"
#: Stands where braces were rewritten, so that the pair around them is known to hold others; no text holds it.
REWRITTEN = "\ue0ff"


def rewrite_braces(keys: Column) -> Column:
    """Text of target keys with each ``{{…}}`` value a leader per key, and conditional braces dropped.

    Inner pairs first, each match decided by itself, as many levels as there are; a pair around others is conditional.
    """
    from ..functions.text import is_conditional

    def decided(inner: Column) -> Column:
        leaders = F.regexp_replace(F.concat(F.lit("{{"), inner, F.lit("}}")), r"\S+", "....")
        return F.concat(F.when(inner.contains(REWRITTEN) | is_conditional(inner), inner).otherwise(leaders), F.lit(REWRITTEN))

    def one(acc: Column, _level: Column) -> Column:
        found = F.transform(F.regexp_extract_all(acc, F.lit(INNERMOST), F.lit(1)), decided)
        parts = F.zip_with(F.split(acc, INNERMOST, -1), found, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
        return F.when(acc.contains("{{"), F.array_join(parts, "")).otherwise(acc)

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(keys, F.lit(r"\{\{"))))
    return F.replace(F.aggregate(levels, keys, one), F.lit(REWRITTEN), F.lit(""))
