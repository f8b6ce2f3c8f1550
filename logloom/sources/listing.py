"""Server listing pages and the sync state built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rows of an index page.
DAILY_ROW = r'<a href="(\d{8})\.txt">[^<]*</a>\s+(\S+ \S+)\s+(\d+)'
LOOSE_ROW = r'<a href="([^"]+\.json)">'
ABBREVIATED = r'<a href="\d{8}\.txt">[^<]*</a>\s+\S+ \S+\s+\d+(?:\.\d+)?[KMGkmg]\b'
LEGACY_HOUR = "12:00:00"
SEEN_DAYS = 400


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Per page: ``abbreviated`` (refuse it), ``n_loose``, ``reachable``."""
    h = F.col(html)
    bad = h.rlike(ABBREVIATED)
    loose = F.regexp_count(h, F.lit(LOOSE_ROW))
    return (
        pages.withColumn("abbreviated", bad)
        .withColumn("n_loose", loose)
        .withColumn("n_daily", F.when(~bad, F.regexp_count(h, F.lit(DAILY_ROW))).otherwise(0))
        .withColumn("reachable", ~bad & ((F.col("n_daily") > 0) | (loose > 0)))
    )


def parse_listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """listing rows (name, day, size) of pages whose sizes are exact; invalid dates dropped."""
    h = F.col(html)
    keep = [c for c in pages.columns if c != html]
    rows = F.regexp_extract_all(h, F.lit(DAILY_ROW), F.lit(0))
    return (
        pages.where(~h.rlike(ABBREVIATED))
        .select(*keep, F.explode(rows).alias("row"))
        .select(
            *keep,
            F.concat(F.regexp_extract("row", DAILY_ROW, 1), F.lit(".txt")).alias("name"),
            F.try_to_date(F.regexp_extract("row", DAILY_ROW, 1), "yyyyMMdd").alias("day"),
            F.regexp_extract("row", DAILY_ROW, 3).cast("bigint").alias("size"),
        )
        .where(F.col("day").isNotNull())
    )


def _days(raw: Column) -> Column:
    """ARRAY<DATE> of a JSON array of ISO days; anything else drops, item by item."""
    items = F.try_variant_get(raw, "$", "array<variant>")
    as_text = F.transform(items, lambda v: F.when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    days = F.transform(as_text, lambda s: F.try_to_date(s, "yyyy-MM-dd"))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(days))), F.array().cast("array<date>"))


def parse_state(states: DataFrame, column: str = "state") -> DataFrame:
    """sync_state rows of ``{"envs": {env: {...}}}`` documents, read tolerantly."""
    v = F.try_parse_json(column)
    envs = F.try_variant_get(v, "$.envs", "map<string,variant>")
    keep = [c for c in states.columns if c != column]
    rows = states.select(*keep, F.explode(envs).alias("env", "raw"))

    def at(name: str, kind: str) -> Column:
        return F.try_variant_get("raw", f"$.{name}", kind)

    def one_day(name: str) -> Column:
        return F.try_to_date(at(name, "string"), "yyyy-MM-dd")

    return rows.select(
        *keep, "env",
        at("last_success", "string").try_cast("timestamp").alias("last_success"),
        F.coalesce(at("last_remote_daily", "int"), F.lit(0)).alias("last_remote_daily"),
        F.coalesce(at("last_downloaded", "int"), F.lit(0)).alias("last_downloaded"),
        one_day("newest_day").alias("newest_day"),
        one_day("oldest_listed").alias("oldest_listed"),
        *[_days(at(n, "variant")).alias(n) for n in ("listed_nonempty", "listed_empty", "seen_nonempty")],
    )


def parse_legacy_state(states: DataFrame, column: str = "state") -> DataFrame:
    """The older ``{env: day}`` document: that day at noon; bad values dropped."""
    text = F.regexp_replace(column, "^﻿", "")
    keep = [c for c in states.columns if c != column]
    pairs = F.try_variant_get(F.try_parse_json(text), "$", "map<string,string>")
    return (
        states.select(*keep, F.explode(pairs).alias("env", "d"))
        .withColumn("day", F.try_to_date("d", "yyyy-MM-dd"))
        .where(F.col("day").isNotNull())
        .select(*keep, "env", F.concat_ws(" ", F.col("day").cast("string"), F.lit(LEGACY_HOUR))
                .cast("timestamp").alias("last_success"))
    )


def load_state(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """The current state where any was read, the legacy import for the environments it lacks."""
    return current.unionByName(
        legacy.join(current.select("env"), "env", "left_anti"), allowMissingColumns=True)


def latest_listing(listing: DataFrame) -> DataFrame:
    """Rows of the newest listing of each env (day, size)."""
    newest = listing.groupBy("env").agg(F.max("listed_at").alias("listed_at"))
    return listing.join(newest, ["env", "listed_at"], "left_semi")


def ever_seen(listing: DataFrame) -> DataFrame:
    """(env, day) listed non-empty at any time, forgetting days 400 before the newest listing."""
    newest = listing.groupBy("env").agg(F.max("listed_at").alias("newest"))
    return (
        listing.where(F.col("size") > 0).select("env", "day").distinct()
        .join(newest, "env")
        .where(F.col("day") >= F.date_sub(F.col("newest").cast("date"), SEEN_DAYS))
        .select("env", "day")
    )
