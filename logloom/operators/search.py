"""Search and browse over the ``entries`` table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.core import ascii_lower
from .ranking import top_per_group

DEFAULT_LIMIT = 1000
KEY_LIMIT = 500
FDI_LIMIT = 20
RECENT_LIMIT = 10
PERIODS = (7, 30, 90)
# Shape of a log record and of its level.
RECORD_START = r"^\[\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[^\]]*\]"
RECORD_LEVEL = r"^\[[^\]]*\]\s+([A-Z]{4,8})\s"

SEARCH_COLUMNS = (
    "env", "day", "rel_path", "seq", "name", "fdi", "template_key", "call_id", "well_formed",
    "request_date", "ndocs", "dossier_number", "header_offset", "header_len", "body_offset",
    "body_len", "json_ok",
)


def _clean(text: str | None) -> str | None:
    text = (text or "").strip()
    return text or None


def newest_first() -> list[Column]:
    """The query order: newest day, dated before undated, latest time, last in the file."""
    return [F.desc("day"), F.desc_nulls_last("request_date"), F.desc("seq")]


def key_predicate(key: str, mode: str) -> Column:
    """Exact, prefix or contains, case-insensitive on ASCII letters; wildcards are literal."""
    k = key.translate({c: c + 32 for c in range(65, 91)})
    c = F.col("template_key_ci")
    if mode == "exact":
        return c == k
    if mode == "prefix":
        return c.startswith(k)
    if mode == "contains":
        return c.contains(k)
    raise ValueError(f"unknown key mode {mode!r}")


def fdi_predicate(prefix: str) -> Column:
    """FDI prefix; ``startswith`` reaches the Parquet scan as a pushed filter."""
    return F.col("fdi").startswith(prefix.lower())


def search(entries: DataFrame, env: str, *, fdi_prefix: str | None = None, template_key: str | None = None,
           key_mode: str = "exact", day_from: dt.date | None = None, day_to: dt.date | None = None,
           limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Hits of one env, newest first; at least an FDI prefix or a key is required."""
    fdi, key = _clean(fdi_prefix), _clean(template_key)
    if fdi is None and key is None:
        raise ValueError("search needs an FDI prefix or a template key")
    hits = entries.where(F.col("env") == env)
    if fdi is not None:
        hits = hits.where(fdi_predicate(fdi))
    if key is not None:
        hits = hits.where(key_predicate(key, key_mode))
    if day_from is not None:
        hits = hits.where(F.col("day") >= F.lit(day_from))
    if day_to is not None:
        hits = hits.where(F.col("day") <= F.lit(day_to))
    hits = hits.withColumn("rel_path", paths.relative_path("env", "day"))
    hits = hits.select(*[c for c in SEARCH_COLUMNS if c in hits.columns])
    ordered = hits.orderBy(*newest_first())
    return ordered if limit is None else ordered.limit(limit)


def period(days: int, last: dt.date) -> tuple[dt.date, dt.date]:
    """Inclusive range of a preset: the ``days`` days up to ``last``."""
    return last - dt.timedelta(days=days), last


def period_flags(day: Column, last: Column) -> list[Column]:
    return [day.between(F.date_sub(last, n), last).alias(f"last_{n}") for n in PERIODS]


def pick_best(hits: DataFrame, by: list[str], prefer_most_documents: bool = True) -> DataFrame:
    """Rows of the newest day of each group with ``is_best`` on the one to extract.

    The newest day is a map-side maximum; the best row is a group-limited top 1. No group is
    collected.
    """
    newest = hits.groupBy(*by).agg(F.max("day").alias("day"))
    keys = [*by, "day"]
    cond = None
    for c in keys:
        p = F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}"))
        cond = p if cond is None else cond & p
    day = hits.alias("h").join(newest.alias("n"), cond, "left_semi")
    order = [F.desc(F.coalesce("ndocs", F.lit(-1)))] if prefer_most_documents else []
    best = top_per_group(day, by, order + newest_first()).select(
        *by, F.col("seq").alias("_seq"), *[F.col(c).alias(f"_{c}") for c in ("env",) if c not in by])
    bcond = F.col("d.seq") == F.col("b._seq")
    for c in by:
        bcond = bcond & F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
    if "env" not in by:
        bcond = bcond & (F.col("d.env") == F.col("b._env"))
    return (
        day.alias("d").join(best.alias("b"), bcond, "left")
        .select("d.*", F.col("b._seq").isNotNull().alias("is_best"))
    )


def coverage(files: DataFrame) -> DataFrame:
    """Per env: first and last day, files, entries. An env with no file has no row."""
    return files.groupBy("env").agg(
        F.min("day").alias("min_day"), F.max("day").alias("max_day"), F.count("*").alias("n_files"),
        F.coalesce(F.sum("n_entries"), F.lit(0)).alias("n_entries"))


def template_keys(entries: DataFrame, env: str, prefix: str | None = None, limit: int | None = KEY_LIMIT) -> DataFrame:
    """Distinct keys, last seen first, then most frequent, then by name."""
    rows = entries.where(F.col("env") == env)
    if _clean(prefix):
        rows = rows.where(key_predicate(_clean(prefix), "prefix"))
    out = rows.groupBy("template_key_ci").agg(
        F.max("day").alias("last_day"), F.count("*").alias("n"), F.min("template_key").alias("template_key"))
    out = out.orderBy(F.desc("last_day"), F.desc("n"), "template_key_ci")
    return out if limit is None else out.limit(limit)


def fdi_values(entries: DataFrame, env: str, prefix: str | None = None, limit: int | None = FDI_LIMIT) -> DataFrame:
    """Distinct FDIs of a prefix, sorted."""
    rows = entries.where((F.col("env") == env) & F.col("fdi").isNotNull())
    if _clean(prefix):
        rows = rows.where(fdi_predicate(_clean(prefix)))
    out = rows.select("fdi").distinct().orderBy("fdi")
    return out if limit is None else out.limit(limit)


def find(entries: DataFrame, files: DataFrame, env: str, *, fdi: str | None = None, key: str | None = None,
         day_to: dt.date, days: int = 90, day_from: dt.date | None = None) -> DataFrame:
    """The find command: one row per match of the chosen day, or one status row.

    ``status`` is ``found``, ``no_match`` or ``not_indexed``.
    """
    fdi = fdi.lower() if fdi else None
    key = key.upper() if key else None
    hits = search(entries, env, fdi_prefix=fdi, template_key=key, limit=None,
                  day_from=day_from or day_to - dt.timedelta(days=days), day_to=day_to)
    best = pick_best(hits, ["env"], prefer_most_documents=bool(fdi and not key))
    wanted = entries.sparkSession.createDataFrame([(env,)], "env string")
    indexed = files.where(F.col("env") == env).groupBy("env").agg(F.count("*").alias("n_files"))
    status = wanted.join(indexed, "env", "left")
    return status.join(best, "env", "left").withColumn(
        "status",
        F.when(F.col("seq").isNotNull(), "found").when(F.col("n_files").isNotNull(), "no_match").otherwise("not_indexed"),
    ).drop("n_files")


def group_hits(hits: DataFrame) -> DataFrame:
    """One row per FDI (the missing FDI is a group): newest call, calls, days; newest group first."""
    when = F.struct("day", F.col("request_date").isNotNull().alias("dated"),
                    F.coalesce("request_date", F.lit("")).alias("t"), "seq")
    return hits.groupBy("fdi").agg(
        F.max(when).alias("newest"), F.count("*").alias("calls"), F.count_distinct("day").alias("days"),
    ).select(
        "fdi", F.col("newest.day").alias("newest_day"), F.nullif(F.col("newest.t"), F.lit("")).alias("newest_time"),
        F.col("newest.seq").alias("newest_seq"), "calls", (F.col("days") == 1).alias("one_day"), "newest",
    ).orderBy(F.desc("newest")).drop("newest")


def sort_hits(hits: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Order by a shown column: ``when``, ``key``, ``fdi``, ``ndocs`` or ``size``."""
    order = {
        "when": [F.col("day"), F.col("request_date").isNotNull(), F.coalesce("request_date", F.lit("")), F.col("seq")],
        "key": [F.lower("template_key")],
        "fdi": [F.lower(F.coalesce("fdi", F.lit("")))],
        "ndocs": [F.coalesce("ndocs", F.lit(-1))],
        "size": [F.col("body_len")],
    }[column]
    return hits.orderBy(*[c.desc() if descending else c.asc() for c in order])


def summary(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, distinct FDIs (the missing one counts once), distinct days."""
    return hits.groupBy(*(by or [])).agg(
        F.count("*").alias("calls"),
        F.count_distinct(F.coalesce("fdi", F.lit(""))).alias("fdis"),
        F.count_distinct("day").alias("days"))


def preselect(hits: DataFrame, by: list[str], fdi_only: Column) -> DataFrame:
    """The row to select: most documents of the newest day for FDI-only searches, else the newest."""
    marked = hits.withColumn("_fdi_only", fdi_only)
    newest = marked.groupBy(*by).agg(F.max("day").alias("_day"))
    cond = F.col("h.day") == F.col("n._day")
    for c in by:
        cond = cond & F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}"))
    day = marked.alias("h").join(newest.alias("n"), cond, "left_semi")
    docs = F.when(F.col("_fdi_only"), F.coalesce("ndocs", F.lit(-1))).otherwise(0)
    return top_per_group(day, by, [F.desc(docs), *newest_first()]).drop("_fdi_only")


def recent_searches(history: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Distinct searches, the most recent first."""
    return (
        history.groupBy("env", "fdi", "key", "mode").agg(F.max("ts").alias("ts"))
        .orderBy(F.desc("ts"), "env", "fdi", "key", "mode").limit(limit)
    )


def log_records(lines: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Lines of one log with the level of the record they belong to, kept by level.

    Lines carry (log, line_no, line). The level of a record reaches its continuation lines; the
    fill runs inside chunks of lines and the chunks' last levels are carried by a small window,
    so a huge log never sits in one task.
    """
    start = F.col("line").rlike(RECORD_START)
    own = F.when(start, F.struct(F.when(F.col("line").rlike(RECORD_LEVEL), F.regexp_extract("line", RECORD_LEVEL, 1))
                                 .alias("level")))
    rows = lines.withColumn("_chunk", F.floor(F.col("line_no") / 10000)).withColumn("_own", own)
    w = Window.partitionBy("log", "_chunk").orderBy("line_no")
    inside = rows.withColumn("_rec", F.last("_own", ignorenulls=True).over(w))
    ends = rows.where(F.col("_own").isNotNull()).groupBy("log", "_chunk").agg(F.max_by("_own", "line_no").alias("_end"))
    spine = rows.select("log", "_chunk").distinct().join(ends, ["log", "_chunk"], "left")
    before = Window.partitionBy("log").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = spine.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = inside.join(carried, ["log", "_chunk"]).withColumn(
        "level", F.coalesce("_rec", "_carry")["level"]).drop("_own", "_rec", "_carry", "_chunk")
    return out if levels is None else out.where(F.col("level").isin(*levels))


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each log, in order."""
    return top_per_group(lines, ["log"], [F.desc("line_no")], n)


def with_search_form(entries: DataFrame) -> DataFrame:
    return entries.withColumn("template_key_ci", ascii_lower("template_key"))
