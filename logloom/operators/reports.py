"""Review reports: panel, tabs, boards, progress and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import rank_of
from .ranking import top_per_group
from .review import FILTER_TITLES, NO_VERDICT, OPEN

# Zones, types, states and tabs in their shown order.
SWITCHED_ZONES = ("header", "titolo", "footer", "spalla_sx", "spalla_dx", "numero_pagina", "filigrana")
MAIN_ZONES = ("header", "titolo", "spalla_sx", "spalla_dx", "footer")
PROOFS = ("segnaposto", "buco", "cella", "sezione", "esecuzione", "listino")
DECIDE = ("maiuscole", "punteggiatura")
TYPE_ORDER = ("maiuscole", "punteggiatura", "spazi", "numeri", "parola", "frase", "sezione", "spostamento", "zona", "link", "altro")
STATES = ("regressione", "non_risolta", "da_fare", "in_corso", "da_verificare", "fatta", "tollerata", "rumore", "variabile",
          "arredo", "nessuno")
WORST_ORDER = ("regressione", "non_risolta", "da_fare", "in_corso", "da_verificare", "fatta")
TABS = ("guardare", "verificare", "fatte", "tollerate", "variabili", "tutte")
OPEN_STATES = ("non_risolta", "regressione", "da_fare", "in_corso")
CONTEXT, LONG = 24, 80


def filter_found(diffs: DataFrame, invisible: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(case, filter_id, n) whatever the switch: a difference may stand behind several rows.

    Occurrences stay rows of ``filter_occurrences``; here they are counted map-side.
    """
    occ = filter_occurrences(diffs).groupBy("case", "filter_id").agg(F.count("*").alias("n"))
    if invisible is not None:
        occ = occ.unionByName(invisible_lines(invisible).groupBy("case").agg(F.count("*").alias("n")).select(
            "case", F.lit("zona.invisibile").alias("filter_id"), "n"))
    if hits is not None:
        occ = occ.unionByName(hits.groupBy("case", F.concat(F.lit("avanzate."), "name").alias("filter_id")).agg(
            F.sum("hits").alias("n")))
    return occ


def filter_occurrences(diffs: DataFrame) -> DataFrame:
    """One row per (difference, filter row) with what the panel lists."""
    zone = F.when(
        F.col("zone").isin(*SWITCHED_ZONES) & (F.col("op") != "pagine") & ~F.col("klass").isin("variabile", "rumore", "link"),
        F.struct(F.concat(F.lit("zona."), "zone").alias("id"),
                 F.coalesce(F.nullif("left_text", F.lit("")), "right_text").alias("text")))
    proof = F.when(
        F.coalesce("prova", F.lit("")) != "",
        F.struct(F.concat(F.lit("variabile."), "prova").alias("id"),
                 F.coalesce(F.nullif("right_text", F.lit("")), "left_text").alias("text")))
    decide = F.when(
        F.col("tipo").isin(*DECIDE) & ~F.col("klass").isin(*NO_VERDICT),
        F.struct(F.concat(F.lit("decidere."), "tipo").alias("id"),
                 F.coalesce(F.nullif("left_text", F.lit("")), "right_text").alias("text")))
    rows = diffs.withColumn("_f", F.explode(F.array_compact(F.array(zone, proof, decide))))
    return rows.select(*diffs.columns, F.col("_f.id").alias("filter_id"), F.col("_f.text").alias("text"))


def filter_panel(found: DataFrame, switched: DataFrame) -> DataFrame:
    """Every row of every case with its switch and count; rows with nothing stay at zero."""
    return switched.join(found, ["case", "filter_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def filtered_count(panel: DataFrame) -> DataFrame:
    """Occurrences set aside by the active filters, per case."""
    return panel.groupBy("case").agg(F.coalesce(F.sum(F.when(F.col("active"), F.col("n"))), F.lit(0)).alias("filtered"))


def invisible_lines(words: DataFrame) -> DataFrame:
    """Invisible words as one occurrence per line (new page or baseline gap). A page is the window."""
    w = Window.partitionBy("case", "side", "page").orderBy("pos")
    gap = F.abs(F.col("y1") - F.lag("y1").over(w))
    new = F.coalesce(gap > F.greatest(F.lit(1.0), 0.5 * (F.col("y1") - F.col("y0"))), F.lit(True))
    lines = words.withColumn("_new", new.cast("int")).withColumn("_line", F.sum("_new").over(w))
    return lines.groupBy("case", "side", "page", "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text")).drop("_line")


def state_of() -> Column:
    """Display state of a judged difference."""
    v, k = F.col("verdict"), F.col("klass")
    return (
        F.when(v.isNull(), F.when(k.isin("variabile", "rumore", "arredo"), k).otherwise("nessuno"))
        .when(F.col("marked") & v.isin(*OPEN), "da_verificare")
        .when(F.col("unresolved") & v.isin("da_fare", "in_corso"), "non_risolta").otherwise(v))


def flagged() -> Column:
    return F.coalesce(F.col("unresolved") & ~F.col("marked") & F.col("verdict").isin(*OPEN), F.lit(False))


def tab_of(state: Column) -> Column:
    return (
        F.when(state.isin(*OPEN_STATES), "guardare").when(state == "da_verificare", "verificare")
        .when(state == "fatta", "fatte").when(state == "tollerata", "tollerate").when(state == "variabile", "variabili")
        .otherwise("tutte"))


def tab_counts(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    # a step each, so that a state is worked out once for all tabs
    rows = judged.withColumn("_state", state_of()).withColumn("_tab", tab_of(F.col("_state")))
    return rows.groupBy(*(by or ["case"])).agg(
        *[F.count_if(F.col("_tab") == x).alias(x) for x in TABS[:-1]], F.count("*").alias("tutte"))


def tab_rows(judged: DataFrame, tab: str) -> DataFrame:
    """Rows of a tab in document order; in "guardare" the unresolved come first, the marked last."""
    state = state_of()
    # The tab comes out of a generator, as a filter on it would be restated in all that a verdict is made of. Rows are dealt by case
    # since the sort draws its sample from them: they would be judged twice.
    rows = judged.withColumn("state", state).withColumn("_flagged", flagged()).withColumn("tab", F.explode(F.array(tab_of(F.col("state"))))).repartition("case")
    place = [F.asc_nulls_last("page"), F.asc("y0"), F.asc("x0"), F.asc("id")]
    if tab == "tutte":
        return rows.orderBy("case", *place).drop("_flagged")
    if tab == "guardare":
        rows = rows.where(F.col("tab").isin("guardare", "verificare"))
        return rows.orderBy("case", F.asc((F.col("tab") == "verificare").cast("int")),
                            F.asc(F.when(F.col("tab") == "guardare", (~F.col("_flagged")).cast("int")).otherwise(0)), *place).drop("_flagged")
    return rows.where(F.col("tab") == tab).orderBy("case", *place).drop("_flagged")


def type_counts(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Differences per type (arredo never counts), one column per type."""
    tipo = F.when(F.col("tipo").isin(*TYPE_ORDER), F.col("tipo")).otherwise("altro")
    counted = F.col("klass") != "arredo"
    return judged.groupBy(*(by or ["case"])).agg(*[F.count_if(counted & (tipo == t)).alias(t) for t in TYPE_ORDER])


def type_groups(rows: DataFrame) -> DataFrame:
    """(case, group, n, group_no): the groups of a tab in their fixed order, arredo last."""
    tipo = F.when(F.col("klass") == "arredo", "arredo").when(F.col("tipo").isin(*TYPE_ORDER), F.col("tipo")).otherwise("altro")
    g = rows.groupBy("case", tipo.alias("type_group")).agg(F.count("*").alias("n"))
    return g.withColumn("group_no", rank_of(F.col("type_group"), TYPE_ORDER))


def zones_summary(judged: DataFrame, boxes: DataFrame) -> DataFrame:
    """(case, zone, n_open, ignored): open differences of each zone present on either side."""
    present = judged.select("case", "zone").unionByName(boxes.select("case", "zone")).where(
        ~F.col("zone").isin("corpo", "")).distinct()
    open_ = judged.groupBy("case", "zone").agg(
        F.count_if(tab_of(state_of()) == "guardare").alias("n_open"),
        F.bool_or(F.col("klass") != "arredo").alias("_counts"))
    j = present.join(open_, ["case", "zone"], "left")
    aside = F.col("zone").isin("numero_pagina", "filigrana")
    return j.select("case", "zone", F.coalesce("n_open", F.lit(0)).cast("bigint").alias("n_open"),
                    (aside & ~F.coalesce("_counts", F.lit(False))).alias("ignored"))


def board_counts(summary: DataFrame) -> DataFrame:
    """Totals per case with marks taken out of the mildest verdicts, and the worst state."""
    marks = F.col("da_verificare")
    t1 = F.least(marks, F.col("in_corso"))
    t2 = F.least(marks - t1, F.col("da_fare"))
    t3 = F.least(marks - t1 - t2, F.col("regressioni"))
    out = summary.select(
        *[c for c in ("initiative", "case", "version") if c in summary.columns],
        (F.col("regressioni") - t3).alias("regressione"), F.col("non_risolte").alias("non_risolta"),
        (F.col("da_fare") - t2).alias("da_fare"), (F.col("in_corso") - t1).alias("in_corso"), F.col("da_verificare"),
        F.col("fatte").alias("fatta"), F.col("tollerate").alias("tollerata"), F.col("variabili").alias("variabile"),
        F.col("rumore"), F.col("arredo"))
    worst = F.lit("")
    for state in reversed(WORST_ORDER):
        worst = F.when(F.col(state) > 0, state).otherwise(worst)
    return out.withColumn("worst", worst)


def pill_counts(judged: DataFrame) -> DataFrame:
    """The case bar: each difference in its verdict's pill, flagged ones also in non_risolta."""
    s = state_of()
    pill = F.when(s == "non_risolta", F.col("verdict")).otherwise(s)
    flag = F.col("unresolved") & F.col("verdict").isin(*OPEN)
    return judged.groupBy("case").agg(
        *[F.count_if(pill == x).alias(x) for x in STATES if x != "non_risolta"], F.count_if(flag).alias("non_risolta"))


def state_counts(judged: DataFrame) -> DataFrame:
    s = state_of()
    return judged.groupBy("case").agg(*[F.count_if(s == x).alias(x) for x in STATES])


def board_rollup(board: DataFrame) -> DataFrame:
    """Totals per initiative and case, with subtotals."""
    return board.rollup("initiative", "case").agg(
        F.sum("regressione").alias("regressione"), F.sum("da_fare").alias("da_fare"), F.sum("in_corso").alias("in_corso"),
        F.sum("fatta").alias("fatta"))


def percent(c: Column) -> Column:
    """Progress rounded down: 100 only when complete, NaN and negatives are 0."""
    return (
        F.when(c.isNull() | F.isnan(c) | (c <= 0), 0).when(c >= 1, 100)
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(99), F.floor(c * 100 + 1e-9)))).cast("int"))


def remaining_text(board: DataFrame) -> DataFrame:
    """What is still open, in words, one sentence per case ("" when nothing is)."""
    # The words of each open state, singular and plural.
    words = {
        "regressione": ("1 regressione", "%d regressioni"), "non_risolta": ("1 non risolta", "%d non risolte"),
        "da_fare": ("1 da fare", "%d da fare"), "in_corso": ("1 in corso", "%d in corso"),
        "da_verificare": ("1 da verificare", "%d da verificare"),
    }
    parts = [F.when(F.col(k) == 1, F.lit(one)).when(F.col(k) > 1, F.format_string(many, F.col(k))) for k, (one, many) in words.items()]
    return board.withColumn("remaining", F.concat_ws(", ", *parts))


def outcome_parts(verification: DataFrame) -> DataFrame:
    """Verification in parts: tone ``ok`` when everything was resolved, else ``warn``."""
    v = verification.where(F.col("checked") > 0)
    parts = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("resolved", "unresolved", "changed")]))
    return v.withColumn("parts", parts).withColumn(
        "tone", F.when((F.col("unresolved") > 0) | (F.col("changed") > 0), "warn").otherwise("ok"))


def minimap(words: DataFrame, judged: DataFrame, page_sizes: DataFrame, show_done: bool = False) -> DataFrame:
    """Segments of differences: one per (difference, page), top and bottom relative to the document.

    ``words`` (case, id, side, page, y0, y1) are the words of differences; ``page_sizes`` (case, side, page, height).
    """
    w = Window.partitionBy("case", "side").orderBy("page")
    tops = page_sizes.withColumn("page_top", F.sum("height").over(w) - F.col("height"))
    total = page_sizes.groupBy("case", "side").agg(F.sum("height").alias("doc_height"))
    state = judged.select("case", "id", state_of().alias("state"))
    seg = words.groupBy("case", "id", "side", "page").agg(F.min("y0").alias("t"), F.max("y1").alias("b"))
    j = seg.join(tops.drop("height"), ["case", "side", "page"]).join(total, ["case", "side"]).join(state, ["case", "id"])
    hide = F.col("state").isin("nessuno") | ((F.col("state") == "fatta") & ((F.col("side") != "left") | F.lit(not show_done)))
    return j.where(~hide & (F.col("doc_height") > 0)).select(
        "case", "id", "side", "page", "state",
        F.greatest(F.lit(0.0), (F.col("page_top") + F.col("t")) / F.col("doc_height")).alias("top"),
        F.least(F.lit(1.0), (F.col("page_top") + F.col("b")) / F.col("doc_height")).alias("bottom"))


def elide_same(text: Column, first: bool = False, last: bool = False) -> Column:
    n = F.length(text)
    if first:
        return F.when(n > CONTEXT, F.concat(F.lit("…"), F.right(text, F.lit(CONTEXT)))).otherwise(text)
    if last:
        return F.when(n > CONTEXT, F.concat(F.left(text, F.lit(CONTEXT)), F.lit("…"))).otherwise(text)
    return F.when(n > 2 * CONTEXT + 3, F.concat(F.left(text, F.lit(CONTEXT)), F.lit(" … "), F.right(text, F.lit(CONTEXT)))).otherwise(text)


def elide_changed(text: Column) -> Column:
    half = LONG // 2 - 2
    return F.when(F.length(text) > LONG, F.concat(F.left(text, F.lit(half)), F.lit(" … "), F.right(text, F.lit(half)))).otherwise(text)


def snippet(before: Column, left: Column, right: Column, after: Column, n: int = 4) -> Column:
    """One-line text of a change: context, [target→generated], context, elided."""
    def words(c: Column) -> Column:
        return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")

    b, a = words(before), words(after)
    head = F.concat(
        F.when(F.size(b) > n, F.lit("… ")).otherwise(""),
        F.when(F.size(b) > 0, F.concat(F.array_join(F.slice(b, F.greatest(F.size(b) - n + 1, F.lit(1)), F.lit(n)), " "), F.lit(" "))).otherwise(""))
    tail = F.concat(
        F.when(F.size(a) > 0, F.concat(F.lit(" "), F.array_join(F.slice(a, F.lit(1), F.lit(n)), " "))).otherwise(""),
        F.when(F.size(a) > n, F.lit(" …")).otherwise(""))
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    same = elide_same(left, first=True)
    change = F.concat(F.lit("["), elide_changed(left), F.lit("→"), elide_changed(right), F.lit("]"))
    return F.concat(head, F.when(left == right, same).otherwise(change), tail)


def spliced(text: Column, spans: Column) -> Column:
    """Text with each [start, end) span in brackets, spans in order."""
    pieces = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["end"].cast("int").alias("at"),
            F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"].cast("int") - acc["at"]), F.lit("["),
                     F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit("]")).alias("out")))
    return F.concat(pieces["out"], F.substr(text, pieces["at"] + 1))


def difference_lines(diffs: DataFrame) -> DataFrame:
    """``where_line`` and ``what_line`` of a difference."""
    # The words of each operation.
    ops = {"mancante": "mancante", "in_piu": "in più", "cambiato": "cambiato", "spostato": "spostato",
           "sezione_assente": "sezione assente", "sezione_in_piu": "sezione in più", "pagine": "pagine"}
    from ..functions.core import label, squeeze

    texts = diffs.withColumn("_l", squeeze(F.coalesce("left_text", F.lit("")))).withColumn("_r", squeeze(F.coalesce("right_text", F.lit(""))))
    l, r = F.col("_l"), F.col("_r")
    where = F.concat_ws(
        " · ", F.when(F.col("page").isNotNull(), F.concat(F.lit("pag. "), (F.col("page") + 1).cast("string"))),
        label(F.col("op"), ops), F.when((F.col("klass") != "testo") | (F.col("op") == "spostato"), F.col("klass")))
    q = lambda c: F.concat(F.lit("«"), elide_changed(c), F.lit("»"))
    what = (
        F.when((F.col("op") == "pagine") | ((F.coalesce("detail", F.lit("")) != "") & (l == "") & (r == "")), F.coalesce("detail", F.lit("")))
        .when((l == r) | F.col("klass").isin("stile", "spaziatura"), q(F.when(l != "", l).otherwise(r)))
        .when((l != "") & (r != ""), F.concat(q(l), F.lit(" → "), q(r)))
        .when(l != "", q(l)).otherwise(q(r)))
    return texts.withColumn("where_line", where).withColumn("what_line", what).drop("_l", "_r")


# --------------------------------------------------------------- progress ---

def sliding_rate(events: DataFrame, seconds: int = 3, bucket_s: int = 3600) -> DataFrame:
    """Bytes and rate over the last ``seconds`` at each event.

    The window is partitioned by (run, time bucket); rows within ``seconds`` of the next bucket
    are also sent to it, so a run of any length is split and each window is still complete.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / (bucket_s * 1_000_000)))
    spill = F.floor((F.col("_us") + seconds * 1_000_000) / (bucket_s * 1_000_000))
    both = e.withColumn("_home", F.explode(F.array_distinct(F.array(F.col("_b"), spill))))
    w = Window.partitionBy("run", "_home").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = both.withColumn("window_bytes", F.sum("bytes").over(w)).where(F.col("_home") == F.col("_b"))
    return out.withColumn("rate_bps", F.col("window_bytes") / F.lit(float(seconds))).drop("_us", "_b", "_home")


def progress(events: DataFrame) -> DataFrame:
    """Per run: bytes done and announced, files done, percent and time left at the last rate."""
    t = F.col("type")
    agg = events.groupBy("run").agg(
        F.coalesce(F.sum(F.when(t == "RemoteIndexRead", F.col("size"))), F.lit(0)).alias("bytes_total"),
        F.coalesce(F.sum(F.when(t == "FileDone", F.col("size"))), F.lit(0)).alias("bytes_done"),
        F.count_if(t.isin("FileSkipped", "FileStarted")).alias("file_index"), F.max("ts").alias("last_ts"))
    return agg.withColumn("left", F.greatest(F.lit(0), F.col("bytes_total") - F.col("bytes_done")))


def eta(left: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.greatest(F.lit(0.0), left / rate))


# ------------------------------------------------------------------ boards ---

def initiative_board(cases: DataFrame, versions: DataFrame) -> DataFrame:
    """Per initiative: newest generated version's time, last activity, accepted cases, label.

    ``cases`` (initiative, name, case, status); ``versions`` (case, kind, number, created). The label
    carries the folder when two initiatives share a name.
    """
    v = versions.groupBy("case").agg(
        F.max(F.when(F.col("kind").isin("asis", "tobe"), F.col("created"))).alias("gen"), F.max("created").alias("act"))
    board = cases.join(v, "case", "left").groupBy("initiative", "name").agg(
        F.max("gen").alias("latest_generated"), F.max("act").alias("last_activity"),
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count("*").alias("n_cases"))
    same = board.groupBy(F.lower("name").alias("_n")).agg(F.count("*").alias("_k"))
    return board.withColumn("_n", F.lower("name")).join(same, "_n").withColumn(
        "label", F.when(F.col("_k") > 1, F.concat(F.col("name"), F.lit(" ("), F.col("initiative"), F.lit(")"))).otherwise(F.col("name"))
    ).drop("_n", "_k")


def status_plan(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def last_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last run and its outcome word."""
    rest = [c for c in runs.columns if c not in (by or [])]
    last = runs.groupBy(*(by or [])).agg(F.max_by(F.struct(*rest), "ts").alias("r")).select(*(by or []), "r.*")
    word = (
        F.when(F.col("skipped"), "saltata").when(F.col("exit_code") == 3, "annullata")
        .when((F.col("exit_code") == 2) | (F.col("n_unreachable") > 0) | (F.col("n_failed") > 0), "con avvisi").otherwise("completata"))
    return last.withColumn("outcome", word)


def day_sentences(cov: DataFrame, kind: str, shown: int = 5) -> DataFrame:
    """Per env: how many days of a kind, the first ones by name, and how many more."""
    d = cov.where(F.col("kind") == kind).groupBy("env").agg(F.array_sort(F.collect_set("day")).alias("days"))
    names = F.transform(F.slice("days", 1, shown), lambda x: F.date_format(x, "dd/MM/yyyy"))
    more = F.size("days") - shown
    return d.select(
        "env", F.size("days").cast("bigint").alias("n"),
        F.concat(F.array_join(names, ", "), F.when(more > 0, F.concat(F.lit(" e altri "), more.cast("string"))).otherwise("")).alias("sentence"))


FIXED_ROWS = tuple(FILTER_TITLES)
