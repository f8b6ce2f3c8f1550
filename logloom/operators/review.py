"""Three-way verdicts and the review state that follows differences across versions.

Tables are keyed by (case, anchor_id); a job judges every case at once. ``tobe`` and ``asis``
hold one row per difference: case, anchor_id, op, klass, tipo, zone, left_text, right_text,
generated, page, pos. ``cases`` holds one row per case: version, profile, has_asis,
tobe_has_text, asis_has_text, tolerated_tipi.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_spelling, last_by, two_level_rank

# Which classes count in each profile, and which never get a verdict.
COUNTING = {
    "tollerante": ("testo", "composizione", "link", "zona"),
    "stretto": ("testo", "composizione", "link", "stile", "spaziatura", "zona"),
    "solo_testo": ("testo", "zona"),
}
NO_VERDICT = ("variabile", "rumore", "arredo")
OPEN = ("da_fare", "in_corso", "regressione")
MARK_ENGINE = 2
# The rows of the filter panel and their built-in state.
FILTER_TITLES = {
    "zona.header": "Header",
    "zona.titolo": "Titolo",
    "zona.footer": "Footer",
    "zona.spalla_sx": "Spalla sinistra",
    "zona.spalla_dx": "Spalla destra",
    "zona.numero_pagina": "Numero di pagina",
    "zona.filigrana": "Filigrana",
    "zona.invisibile": "Testo invisibile",
    "variabile.segnaposto": "Segnaposto",
    "variabile.buco": "Buchi del target",
    "variabile.cella": "Celle vuote",
    "variabile.sezione": "Sezioni vuote",
    "variabile.esecuzione": "Cambiano fra due generazioni",
    "variabile.listino": "Listino",
    "decidere.maiuscole": "Solo maiuscole",
    "decidere.punteggiatura": "Solo punteggiatura",
}
INFORMATIONAL = ("zona.invisibile",)
DEFAULT_ON = ("zona.numero_pagina", "zona.filigrana", "zona.invisibile")
RENAMED_RULES = {"Numero di pagina": "Numero di pagina nel testo"}
ADVANCED = "avanzate."


def counts(klass: Column, profile: Column) -> Column:
    """Whether a class counts in a profile."""
    out = F.lit(False)
    for name, classes in COUNTING.items():
        out = F.when(profile == name, klass.isin(*classes)).otherwise(out)
    return out


def counting(diffs: DataFrame, profile: str = "tollerante") -> DataFrame:
    return diffs.where(F.col("klass").isin(*COUNTING[profile]))


def equal_for(diffs: DataFrame, comparisons: DataFrame, profile: str = "tollerante") -> DataFrame:
    """Per comparison: both sides have text and nothing the profile counts differs."""
    n = counting(diffs, profile).groupBy("pair_id").agg(F.count("*").alias("n"))
    return comparisons.join(n, "pair_id", "left").select(
        "pair_id", F.coalesce("n", F.lit(0)).alias("n_counting"),
        (F.col("left_has_text") & F.col("right_has_text") & F.col("n").isNull()).alias("equal"))


def _repeat_number(k: Column, taken: Column) -> Column:
    """The k-th number from 2 that is not in the sorted array of taken numbers."""
    r = k - 1
    skipped = F.size(F.filter(taken, lambda t, i: t - (i + 1) <= r))
    return (r + 1 + skipped).cast("bigint")


def unique_anchors(diffs: DataFrame, group: list[str], bucket: str = "page", pos: str = "pos") -> DataFrame:
    """Anchors made distinct inside ``group``: the nth repeat gets " #n", skipping numbers in use.

    Needs the anchor as columns op, klass, context, target_text. Repeats are numbered in two
    levels (bucket, then position), so very many equal anchors are split over tasks.
    """
    key = [*group, "op", "klass", "context", "target_text"]
    ranked = two_level_rank(diffs, key, bucket, [F.asc(pos)], out="_k")
    numbered = diffs.where(F.col("context").rlike(r"(^| )#(\d+)$")).select(
        *group, "op", "klass", "target_text",
        F.regexp_replace("context", r"(^| )#\d+$", "").alias("context"),
        F.regexp_extract("context", r"#(\d+)$", 1).try_cast("bigint").alias("_n"))
    taken = numbered.where(F.col("_n") >= 2).groupBy(*key).agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    n = _repeat_number(F.col("_k"), F.coalesce("_taken", F.array().cast("array<bigint>")))
    tag = F.concat(F.lit("#"), n.cast("string"))
    context = F.when(F.col("_k") == 1, F.col("context")).when(F.col("context") == "", tag).otherwise(
        F.concat_ws(" ", "context", tag))
    return ranked.join(taken, key, "left").withColumn("context", context).drop("_k", "_taken")


def anchors_told_apart(diffs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``unique_anchors`` for groups that one task may hold, such as a pair of documents: windows alone, no rows dealt anew."""
    key = [*group, "op", "klass", "_base", "target_text"]
    number = F.regexp_extract("context", r"#(\d+)$", 1).try_cast("bigint")
    row = F.struct(F.col("context").alias("_base"), F.lit(None).cast("bigint").alias("_n"), F.lit(True).alias("_own"))
    used = F.when(F.col("context").rlike(r"(^| )#(\d+)$") & (number >= 2), F.struct(
        F.regexp_replace("context", r"(^| )#\d+$", "").alias("_base"), number.alias("_n"), F.lit(False).alias("_own")))
    both = diffs.select("*", F.inline(F.array_compact(F.array(row, used))))
    w = Window.partitionBy(*key)
    both = both.withColumn("_k", F.sum(F.col("_own").cast("int")).over(w.orderBy(*order, F.desc("_own")).rowsBetween(Window.unboundedPreceding, 0)))
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    both = both.withColumn("_taken", F.when(known, F.array_sort(F.collect_set("_n").over(w))).otherwise(F.array().cast("array<bigint>"))).where("_own")
    tag = F.concat(F.lit("#"), _repeat_number(F.col("_k"), F.col("_taken")).cast("string"))
    context = F.when(F.col("_k") == 1, F.col("context")).when(F.col("context") == "", tag).otherwise(F.concat_ws(" ", "context", tag))
    return both.withColumn("context", context).select(*diffs.columns)


def with_anchor_id(diffs: DataFrame) -> DataFrame:
    anchor = F.struct("op", "klass", "context", "target_text")
    return diffs.withColumn("anchor_id", F.sha2(F.to_json(anchor), 256))


def effective(diffs: DataFrame, not_variables: DataFrame) -> DataFrame:
    """Listed anchors turn ``variabile`` into ``testo``."""
    listed = not_variables.select("case", "anchor_id").distinct().withColumn("_nv", F.lit(True))
    klass = F.when((F.col("klass") == "variabile") & F.col("_nv"), "testo").otherwise(F.col("klass"))
    return diffs.join(listed, ["case", "anchor_id"], "left").withColumn("klass", klass).drop("_nv")


DIFF_FIELDS = ("op", "klass", "tipo", "zone", "left_text", "right_text", "generated", "page", "pos")


def _by_anchor(tobe: DataFrame, asis: DataFrame, tolerances: DataFrame, marks: DataFrame,
               not_variables: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row per (case, anchor_id) with everything known about it, in a single shuffle, or none where the inputs are dealt by case.

    The six inputs are stacked with one struct column each and aggregated together, map-side
    first. Anchors are unique inside a case, so the keys spread however big a case is.
    """
    def part(df: DataFrame, name: str, *fields: Column | str) -> DataFrame:
        return df.select("case", "anchor_id", F.struct(*fields).alias(name))

    # The review keeps one tolerance per anchor; older files may hold a few.
    few = tolerances.groupBy("case", "anchor_id").agg(F.array_sort(F.collect_set(F.struct("ord", "generated", "note"))).alias("tols"))
    stack = part(tobe, "t", *DIFF_FIELDS)
    for other in (
        part(asis, "a", *DIFF_FIELDS),
        few,
        part(marks, "mark", "version", "generated", "engine"),
        part(not_variables, "nv", F.lit(True).alias("listed")),
        part(unresolved, "un", "version", "generated"),
    ):
        stack = stack.unionByName(other, allowMissingColumns=True)
    return stack.groupBy("case", "anchor_id").agg(*[F.max(c).alias(c) for c in ("t", "a", "mark", "un", "nv", "tols")])


def judge(tobe: DataFrame, asis: DataFrame, cases: DataFrame, tolerances: DataFrame, marks: DataFrame,
          not_variables: DataFrame, unresolved: DataFrame) -> dict[str, DataFrame]:
    """judged, verification, marks, unresolved and summary tables of every case.

    Verdicts, marks and remembered entries are all decided on the row of one anchor; only the
    facts of the case are joined in. Every returned table is a projection or a map-side
    aggregation of that row. ``number`` adds the ids.
    """
    ok = cases.where("tobe_has_text").withColumn("two_way", ~(F.col("has_asis") & F.col("asis_has_text")))
    facts = ok.select("case", F.col("version").alias("now"), "profile", "two_way", "tolerated_tipi")
    r = _by_anchor(tobe, asis, tolerances, marks, not_variables, unresolved).join(facts, "case")

    def klass_of(side: str) -> Column:
        k = F.col(f"{side}.klass")
        return F.when((k == "variabile") & F.col("nv").isNotNull(), "testo").otherwise(k)

    r = r.withColumn("a", F.when(~F.col("two_way"), F.col("a")))
    r = r.withColumn("kt", klass_of("t")).withColumn("ka", klass_of("a"))
    r = r.withColumn("tol", F.get(F.filter("tols", lambda x: x["generated"] == F.col("t.generated")), F.lit(0))).drop("tols")
    text, before = F.col("t.generated"), F.col("a.generated")
    silent = F.array_contains("tolerated_tipi", F.col("t.tipo"))
    counted = counts(F.col("kt"), F.col("profile"))
    base = (
        F.when(F.col("t").isNull() | F.col("kt").isin(*NO_VERDICT), F.lit(None))
        .when(~counted | silent | F.col("tol").isNotNull(), "tollerata")
        .when(F.col("two_way"), "da_fare").when(before.isNull(), "regressione")
        .when(before == text, "da_fare").otherwise("in_corso"))
    note = (
        F.when(~counted | F.col("kt").isin(*NO_VERDICT), "").when(silent, F.concat(F.lit("Tollera tutte: solo "), F.col("t.tipo")))
        .when(F.col("tol").isNotNull(), F.col("tol.note")).otherwise(""))
    r = r.withColumn("base", base).withColumn("tolerated_note", note)
    r = r.withColumn("open", F.coalesce(F.col("base").isin(*OPEN), F.lit(False)))

    due = F.col("mark").isNotNull() & (F.col("mark.version") < F.col("now"))
    fate = F.when(
        due,
        F.when(F.col("t").isNull(), F.when(F.col("mark.engine") < MARK_ENGINE, "dormant").otherwise("resolved"))
        .when(~F.col("open"), "dormant").when(F.col("mark.generated") == text, "unresolved").otherwise("changed"))
    r = r.withColumn("fate", fate)
    stuck = F.coalesce(F.col("fate") == "unresolved", F.lit(False))
    kept = F.col("t").isNotNull() & F.col("un").isNotNull() & ((F.col("un.generated") == "") | (F.col("un.generated") == text))
    r = r.withColumn("still", stuck | F.coalesce(kept, F.lit(False)))
    r = r.withColumn("made_in", F.when(stuck, F.col("mark.version")).otherwise(F.col("un.version")))
    changed = F.coalesce(F.col("fate") == "changed", F.lit(False))
    live = F.coalesce(F.col("mark.version") >= F.col("now"), F.lit(False))
    verdict = F.when(changed, "in_corso").otherwise(F.col("base"))
    previous = F.when(changed, F.col("mark.generated")).when(F.col("base") == "in_corso", F.col("a.right_text")).otherwise("")

    def row(side: str, klass: str, part: int, verdict: Column, marked: Column, unres: Column, note: Column, prev: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), *[F.col(f"{side}.{f}").alias(f) for f in DIFF_FIELDS if f != "klass"],
            F.col(klass).alias("klass"), verdict.alias("verdict"), marked.alias("marked"), unres.alias("unresolved"),
            note.alias("tolerated_note"), prev.alias("previous_text"))

    no, empty = F.lit(False), F.lit("")
    done = (
        F.col("a").isNotNull() & F.col("t").isNull() & counts(F.col("ka"), F.col("profile"))
        & ~F.array_contains("tolerated_tipi", F.col("a.tipo")))
    out = F.when(F.col("t").isNotNull(), row("t", "kt", 0, verdict, F.col("open") & live, F.col("open") & F.col("still"),
                                             F.col("tolerated_note"), previous)).when(
        done, row("a", "ka", 1, F.lit("fatta"), no, no, empty, empty))
    judged = r.where(F.col("t").isNotNull() | F.coalesce(done, F.lit(False))).withColumn("j", out).select("case", F.col("now").alias("version"), "anchor_id", "j.*")

    f = F.col("fate")
    verification = r.where(f.isNotNull() & (f != "dormant")).groupBy("case", F.col("now").alias("version")).agg(
        F.count("*").alias("checked"), F.count_if(f == "resolved").alias("resolved"),
        F.count_if(f == "unresolved").alias("unresolved"), F.count_if(f == "changed").alias("changed"))
    kept_marks = r.where(F.col("mark").isNotNull() & (f.isNull() | (f == "dormant"))).select("case", "anchor_id", "mark.*")
    still = r.where("still").select("case", "anchor_id", F.col("made_in").alias("version"), text.alias("generated"))
    return {
        "judged": judged, "verification": verification, "marks": kept_marks, "unresolved": still,
        "fates": r.where(f.isNotNull()).select("case", "anchor_id", "fate"), "summary": summarise(judged, cases),
    }


def number(judged: DataFrame) -> DataFrame:
    """ids 1..n per case: the TO-BE differences in page order, then the done ones."""
    b = judged.withColumn("_bucket", F.col("part") * 1_000_000_000 + F.coalesce("page", F.lit(0)))
    return two_level_rank(b, ["case"], "_bucket", [F.asc("pos")], out="id").drop("part", "_bucket")


def summarise(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """case_summary: counts per verdict and class, progress, one row per case."""
    v, k = F.col("verdict"), F.col("klass")
    agg = judged.groupBy("case").agg(
        F.count_if(v == "fatta").alias("fatte"), F.count_if(v == "da_fare").alias("da_fare"),
        F.count_if(v == "in_corso").alias("in_corso"), F.count_if(v == "regressione").alias("regressioni"),
        F.count_if("marked").alias("da_verificare"), F.count_if("unresolved").alias("non_risolte"),
        F.count_if(v == "tollerata").alias("tollerate"), F.count_if(k == "variabile").alias("variabili"),
        F.count_if(k == "rumore").alias("rumore"), F.count_if(k == "arredo").alias("arredo"))
    names = [c for c in agg.columns if c != "case"]
    j = cases.join(agg, "case", "left")
    zero = F.lit(0).cast("bigint")
    n = {c: F.coalesce(F.col(c), zero) for c in names}
    total = n["fatte"] + n["da_fare"] + n["in_corso"] + n["regressioni"]
    return j.select(
        "case", "version", *[n[c].alias(c) for c in names],
        F.when(~F.col("tobe_has_text"), F.lit(0.0)).otherwise(
            F.coalesce(F.try_divide(n["fatte"].cast("double"), total), F.lit(1.0))).alias("avanzamento"),
        (~(F.col("has_asis") & F.col("asis_has_text"))).alias("two_way"))


def inactive(judged: DataFrame, tolerances: DataFrame, not_variables: DataFrame, marks: DataFrame) -> DataFrame:
    """Per case: review entries that do nothing in the judged differences.

    The judged rows and the entries are stacked and counted by anchor and text, then by anchor, so the judged rows are made once.
    """
    def part(df: DataFrame, kind: str, generated: Column | str, marked: Column | str = F.lit(False)) -> DataFrame:
        flags = [F.lit(kind == k).cast("bigint").alias(k) for k in ("tolerances", "not_variables", "marks")]
        text, is_marked = (F.col(c) if isinstance(c, str) else c for c in (generated, marked))
        return df.select("case", "anchor_id", text.cast("string").alias("generated"), F.lit(kind == "judged").alias("seen"), is_marked.alias("marked"), *flags)

    none = F.lit(None)
    stack = part(judged, "judged", "generated", "marked").unionByName(part(tolerances, "tolerances", "generated")).unionByName(
        part(not_variables, "not_variables", none)).unionByName(part(marks, "marks", none))
    names, flags = ["tolerances", "not_variables", "marks"], [F.max("seen").alias("seen"), F.max("marked").alias("marked")]
    by_text = stack.groupBy("case", "anchor_id", "generated").agg(*flags, *[F.sum(n).alias(n) for n in names])
    meets = F.col("case").isNotNull() & F.col("anchor_id").isNotNull()
    idle = F.when(meets & F.col("generated").isNotNull() & F.col("seen"), 0).otherwise(F.col("tolerances"))
    by_anchor = by_text.withColumn("tolerances", idle).groupBy("case", "anchor_id").agg(*flags, *[F.sum(n).alias(n) for n in names])
    n = {"tolerances": F.col("tolerances"), "not_variables": F.when(meets & F.col("seen"), 0).otherwise(F.col("not_variables")),
         "marks": F.when(meets & F.coalesce("marked", F.lit(False)), 0).otherwise(F.col("marks"))}
    return by_anchor.select("case", *[c.alias(k) for k, c in n.items()]).groupBy("case").agg(*[F.sum(k).alias(k) for k in names]).withColumn(
        "inactive", F.col("tolerances") + F.col("not_variables") + F.col("marks")).where("inactive > 0")


# ----------------------------------------------------------- review events ---

# What each review action does to which list.
ACTIONS = {
    "tolerate": ("tolerance", "set"), "untolerate": ("tolerance", "unset"),
    "mark_done": ("mark", "set"), "unmark": ("mark", "unset"),
    "not_variable": ("not_variable", "set"), "variable_again": ("not_variable", "unset"),
    "unresolve": ("unresolved", "set"),
}
RESETS = {
    "unmark_all": ("mark",), "reset_tolerances": ("tolerance", "not_variable"),
    "target_replaced": ("mark", "unresolved", "summary"),
}


def review_state(events: DataFrame) -> DataFrame:
    """Live review entries folded from the append-only actions (case, seq, action, anchor_id, …).

    The last action on (case, kind, anchor) wins; a reset drops the earlier entries of its
    kinds; a not-variable keeps its first entry after the last removal.
    """
    action = F.col("action")
    kind, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (k, w) in ACTIONS.items():
        kind = F.when(action == name, k).otherwise(kind)
        what = F.when(action == name, w).otherwise(what)
    acts = events.withColumn("kind", kind).withColumn("what", what).where(F.col("kind").isNotNull())
    reset_kinds = F.array().cast("array<string>")
    for name, kinds in RESETS.items():
        reset_kinds = F.when(action == name, F.array(*[F.lit(k) for k in kinds])).otherwise(reset_kinds)
    resets = events.select("case", "seq", F.explode(reset_kinds).alias("kind")).groupBy("case", "kind").agg(
        F.max("seq").alias("_reset"))
    key = ["case", "kind", "anchor_id"]
    rest = [c for c in events.columns if c not in ("case", "anchor_id", "action")]
    acts = acts.join(resets, ["case", "kind"], "left").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
    s = F.struct(*rest)
    is_set = F.col("what") == "set"
    folded = acts.groupBy(*key).agg(
        F.max_by("what", "seq").alias("_last"), F.max(F.when(~is_set, F.col("seq"))).alias("_unset"),
        F.max_by(s, "seq").alias("_new"))
    alive = folded.where(F.col("_last") == "set")
    first = acts.where(is_set & (F.col("kind") == "not_variable")).join(
        alive.where(F.col("kind") == "not_variable").select(*key, "_unset"), key).where(
        F.col("_unset").isNull() | (F.col("seq") > F.col("_unset"))).groupBy(*key).agg(F.min_by(s, "seq").alias("_first"))
    return alive.join(first, key, "left").select(*key, F.coalesce("_first", "_new").alias("e")).select(*key, "e.*")


def undo_steps(events: DataFrame) -> DataFrame:
    """The inverse of each action, restoring the former note or version (lag per anchor)."""
    action = F.col("action")
    kind = F.lit(None).cast("string")
    for name, (k, _w) in ACTIONS.items():
        kind = F.when(action == name, k).otherwise(kind)
    e = events.withColumn("kind", kind).where(F.col("kind").isNotNull())
    w = Window.partitionBy("case", "kind", "anchor_id").orderBy("seq")
    prev = F.lag(F.struct("action", "note", "version")).over(w)
    e = e.withColumn("_prev", prev)
    was_set = F.coalesce(F.col("_prev.action").isin("tolerate", "mark_done", "not_variable"), F.lit(False))
    inverse = (
        F.when(action == "tolerate", F.when(was_set, "tolerate").otherwise("untolerate"))
        .when(action == "untolerate", "tolerate")
        .when(action == "mark_done", F.when(was_set, "mark_done").otherwise("unmark")).when(action == "unmark", "mark_done")
        .when(action == "not_variable", F.when(was_set, "none").otherwise("variable_again"))
        .when(action == "variable_again", "not_variable"))
    back = inverse.isin("tolerate", "mark_done", "not_variable")
    return e.select(
        "case", "seq", "action", "anchor_id", inverse.alias("undo"),
        F.when(back, F.col("_prev.note")).alias("undo_note"), F.when(back, F.col("_prev.version")).alias("undo_version"))


def save_compared(runs: DataFrame, found_unresolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, unresolved) after comparisons of several versions: the newest version owns both,
    an older one only adds what it found."""
    summary = runs.groupBy("case").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "case"]), "version").alias("s"))
    summary = summary.select("case", "s.*")
    latest = last_by(found_unresolved.select("case", "anchor_id", "version", "generated"), ["case", "anchor_id"], "version")
    return summary, latest


# ------------------------------------------------------------ filter panel ---

def filter_rows(rules: DataFrame) -> DataFrame:
    """(filter_id, title, panel_group, ord, built_in, switch): the fixed rows, then one per rule name."""
    fixed = [
        (fid, title, "zone" if fid.startswith("zona.") else "variabili" if fid.startswith("variabile.") else "decidere",
         i, fid in DEFAULT_ON or fid.startswith("variabile."), fid not in INFORMATIONAL)
        for i, (fid, title) in enumerate(FILTER_TITLES.items())
    ]
    spark = rules.sparkSession
    base = spark.createDataFrame(
        fixed, "filter_id string, title string, panel_group string, ord bigint, built_in boolean, switch boolean")
    adv = rules.select(
        F.concat(F.lit(ADVANCED), F.col("name")).alias("filter_id"), F.col("name").alias("title"),
        F.lit("avanzate").alias("panel_group"), (F.lit(1000) + F.col("ord")).cast("bigint").alias("ord"),
        F.col("enabled").alias("built_in"), F.lit(True).alias("switch"))
    return base.unionByName(adv)


def switches(rows: DataFrame, cases: DataFrame, choices: DataFrame) -> DataFrame:
    """(case, filter_id, default_on, active): case choice, else initiative's, else built-in.

    ``choices`` is (level, owner, filter_id, on); ``cases`` is (case, initiative). The rows are
    exploded from one small array per case, so no pair product is joined.
    """
    packed = rows.agg(F.collect_list(F.struct("filter_id", "ord", "built_in", "switch")).alias("rows"))
    spine = cases.select("case", "initiative").withColumn("_one", F.lit(1)).join(
        packed.withColumn("_one", F.lit(1)), "_one").select("case", "initiative", F.inline("rows"))
    ini = choices.where(F.col("level") == "initiative").select(F.col("owner").alias("initiative"), "filter_id", F.col("on").alias("_ini"))
    own = choices.where(F.col("level") == "case").select(F.col("owner").alias("case"), "filter_id", F.col("on").alias("_case"))
    j = spine.join(ini, ["initiative", "filter_id"], "left").join(own, ["case", "filter_id"], "left")
    default = F.when(~F.col("switch"), True).otherwise(F.coalesce("_ini", "built_in"))
    active = F.when(~F.col("switch"), True).otherwise(F.coalesce("_case", default))
    return j.select("case", "filter_id", "ord", default.alias("default_on"), active.alias("active"))


def is_filter_id(c: Column) -> Column:
    return c.isin(*FILTER_TITLES) | c.rlike(r"^avanzate\..*\S")


def apply_choices(choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live choices, refused rows) of a choice log (owner, seq, filter_id, on); NULL removes."""
    good = is_filter_id(F.col("filter_id")) & ~F.col("filter_id").isin(*INFORMATIONAL)
    live = last_by(choices.where(good).select("owner", "filter_id", "seq", "on"), ["owner", "filter_id"], "seq")
    return live.where(F.col("on").isNotNull()), choices.where(~good)


def prune_choices(choices: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop the choices of rules that no longer exist; a renamed rule keeps its choice."""
    name = F.substr("filter_id", F.lit(len(ADVANCED) + 1))
    for old, new in RENAMED_RULES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    adv = choices.where(F.col("filter_id").startswith(ADVANCED)).withColumn("name", name)
    kept = adv.join(rules.select("name").distinct(), "name", "left_semi")
    cols = choices.columns
    return choices.where(~F.col("filter_id").startswith(ADVANCED)).unionByName(
        kept.withColumn("filter_id", F.concat(F.lit(ADVANCED), "name")).select(*cols))


def legacy_choices(preset_names: DataFrame) -> DataFrame:
    """The choices an older preset list stands for."""
    name = F.trim("name")
    for old, new in RENAMED_RULES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return preset_names.where(F.trim("name") != "").select(
        "owner", F.concat(F.lit(ADVANCED), name).alias("filter_id"), F.lit(True).alias("on"))


def rule_rows(rules: DataFrame, scope: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rules in force, clashes): the first of each name over (level, ord) wins."""
    scope = list(scope)
    r = rules.withColumn("_o", F.struct("level", "ord"))
    first = first_spelling(r, [*scope, "name"], "_o").drop("_o")
    ids = [*scope, "name", "level", "ord"]
    return first.select(*rules.columns), rules.join(first.select(*ids), ids, "left_anti")


# ------------------------------------------------------------- case status ---

def acceptance(accepts: DataFrame, versions: DataFrame) -> DataFrame:
    """Per accepted case: accepted version, whether it is current, whether newer work reopened it.

    ``accepts`` (case, at); ``versions`` (case, kind, number, created).
    """
    acc = accepts.groupBy("case").agg(F.max("at").alias("accepted_at"))
    v = versions.where(F.col("kind").isin("tobe", "asis")).join(acc, "case")
    tobe = F.col("kind") == "tobe"
    agg = v.groupBy("case", "accepted_at").agg(
        F.max(F.when(tobe & (F.col("created") <= F.col("accepted_at")), F.col("number"))).alias("accepted_version"),
        F.max(F.when(tobe, F.col("number"))).alias("latest_version"),
        F.coalesce(F.bool_or(F.col("created") > F.col("accepted_at")), F.lit(False)).alias("reopened"))
    return agg.withColumn("current", ~F.col("reopened") & F.col("accepted_version").eqNullSafe(F.col("latest_version")))


def asis_predates_call(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Cases whose AS-IS is older than the last replacement of their call."""
    replaced = history.where(F.col("kind") == "call_replaced").groupBy("case").agg(F.max("at").alias("replaced_at"))
    asis = versions.where((F.col("kind") == "asis") & ~F.col("missing")).groupBy("case").agg(F.max("created").alias("created"))
    return asis.join(replaced, "case", "left").select(
        "case", F.coalesce(F.col("replaced_at") > F.col("created"), F.lit(False)).alias("asis_predates_call"))


def same_as_asis(tobe: DataFrame, asis: DataFrame, pages: DataFrame, profile: str = "tollerante") -> DataFrame:
    """Cases whose TO-BE reads as its AS-IS: equal multisets of counted differences, equal page counts."""
    cols = ["case", "op", "klass", "left_text", "right_text"]
    t = counting(tobe, profile).groupBy(*cols).agg(F.count("*").alias("nt"))
    a = counting(asis, profile).groupBy(*cols).agg(F.count("*").alias("na"))
    cond = [F.col(f"t.{c}").eqNullSafe(F.col(f"a.{c}")) for c in cols]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    j = t.alias("t").join(a.alias("a"), on, "full_outer").select(
        F.coalesce("t.case", "a.case").alias("case"), "nt", "na")
    eq = j.groupBy("case").agg(
        F.bool_and(F.col("nt").eqNullSafe(F.col("na"))).alias("_same"), F.coalesce(F.sum("nt"), F.lit(0)).alias("_n"))
    return pages.join(eq, "case", "left").select(
        "case", (F.coalesce("_same", F.lit(False)) & (F.coalesce("_n", F.lit(0)) > 0)
                 & (F.col("tobe_pages") == F.col("asis_pages")) & F.col("all_have_text")).alias("same_as_asis"))


def follow(followed: DataFrame, rows: DataFrame) -> DataFrame:
    """Where each followed difference is now: same id and place, else same anchor, else same place."""
    f = followed if "follow_id" in followed.columns else followed.withColumn("follow_id", F.monotonically_increasing_id())
    now = rows.select("case", "op", "context", "target_text", F.col("id").alias("now_id"), F.col("klass").alias("now_klass"))
    j = f.join(now, ["case", "op", "context", "target_text"], "left")
    rule = F.when(F.col("id") == F.col("now_id"), 1).when(F.col("klass") == F.col("now_klass"), 2).otherwise(3)
    ranked = j.withColumn("_r", F.when(F.col("now_id").isNotNull(), F.struct(rule.alias("rule"), F.col("now_id").alias("now_id"))))
    return ranked.groupBy("case", "follow_id").agg(F.min("_r").alias("b")).select("case", "follow_id", "b.now_id", "b.rule")


def live_marks(marks: DataFrame, summary: DataFrame, cases: DataFrame) -> DataFrame:
    """The smaller of the marks in the file and the ones to verify."""
    m = marks.groupBy("case").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return cases.select("case").join(m, "case", "left").join(summary.select("case", "da_verificare"), "case", "left").select(
        "case", F.least(n, F.coalesce("da_verificare", n)).cast("bigint").alias("live_marks"))
