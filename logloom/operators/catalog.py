"""Index maintenance, mirror planning, freshness and coverage."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import label
from ..sources import daily_log

# Words of a run summary.
STATUS_LABELS = {
    "ok": "completato", "fresh": "già sincronizzato", "unreachable": "non raggiungibile",
    "errors": "con errori", "cancelled": "annullato",
}
BADGE_ATTENTION = {
    "lost": "bad", "errors": "bad", "pending": "warn", "unreachable": "warn", "stale": "warn", "never": "warn",
}


def index_plan(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(env, day, action): ``scan`` new or changed files, ``remove`` vanished ones, ``keep`` the rest."""
    d, i = disk.alias("d"), index.alias("i")
    j = d.join(i, (F.col("d.env") == F.col("i.env")) & (F.col("d.day") == F.col("i.day")), "full_outer")
    same = F.col("d.size").eqNullSafe(F.col("i.size")) & F.col("d.mtime").eqNullSafe(F.col("i.mtime"))
    return j.select(
        F.coalesce("d.env", "i.env").alias("env"), F.coalesce("d.day", "i.day").alias("day"),
        F.when(F.col("d.env").isNull(), "remove").when(F.col("i.env").isNull() | ~same, "scan").otherwise("keep").alias("action"),
    )


def pending_count(plan: DataFrame) -> DataFrame:
    """Files not yet indexed, per env."""
    return plan.groupBy("env").agg(F.count_if(F.col("action") == "scan").alias("index_pending"))


class EntryStore:
    """The ``entries`` and ``files`` tables of an archive, kept up to date day by day.

    ``entries`` is partitioned by (scan, env, day); an update adds the days it rescans under a scan id of its own.
    ``files`` is one row per day file with the scan that holds its entries, written as numbered snapshots. The newest
    snapshot decides what is visible: a vanished day needs no rewrite, a day that lost its entries keeps none of them,
    and an update that dies before its snapshot leaves nothing behind that a reader would see.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def files(self) -> DataFrame | None:
        snaps = self._read("files")
        if snaps is None:
            return None
        last = snaps.agg(F.max("snapshot")).first()[0]
        return snaps.where(F.col("snapshot") == last).drop("snapshot")

    def entries(self) -> DataFrame | None:
        found = self._read("entries")
        files = self.files()
        if found is None or files is None:
            return None
        return found.join(files.select("env", "day", "scan"), ["env", "day", "scan"], "left_semi").drop("scan")

    def _snapshot(self, files: DataFrame) -> None:
        snaps = self._read("files")
        n = 1 + (snaps.agg(F.max("snapshot")).first()[0] if snaps is not None else 0)
        files.withColumn("snapshot", F.lit(n)).write.mode("append").partitionBy("snapshot").parquet(f"{self.path}/files")

    def update(self, root: str, rebuild: bool = False, only: DataFrame | None = None) -> DataFrame:
        """Rescan new and changed days (or just ``only``), drop vanished ones; returns the plan."""
        disk = daily_log.list_days(self.spark, root)
        index = None if rebuild else self.files()
        if index is None:
            index = disk.limit(0).withColumn("n_entries", F.lit(0).cast("bigint")).withColumn(
                "n_orphans", F.lit(0).cast("bigint")).withColumn("scan", F.lit(""))
        scan = f"s{uuid.uuid4().hex}"
        plan = index_plan(disk, index)
        if only is not None:
            plan = plan.join(only.select("env", "day"), ["env", "day"], "left_semi").withColumn(
                "action", F.when(F.col("action") == "keep", "scan").otherwise(F.col("action")))
        todo = plan.where(F.col("action") == "scan").select("env", "day")
        # Only the planned files are opened; a rebuild opens all of them anyway.
        chosen = [] if rebuild else [
            f"{root.rstrip('/')}/{r.rel_path}" for r in disk.join(todo, ["env", "day"], "left_semi").select("rel_path").collect()]
        found = daily_log.read_files(self.spark, chosen or root)
        content = (
            daily_log.with_day_columns(found if rebuild or chosen else found.limit(0))
            .join(todo, ["env", "day"], "left_semi").select("env", "day", "path", "content")
        )
        (
            daily_log.scan_entries(content)
            .repartition("env", "day")
            .sortWithinPartitions("env", "day", "fdi")
            .withColumn("scan", F.lit(scan))
            .write.mode("append")
            .partitionBy("scan", "env", "day").parquet(f"{self.path}/entries")
        )
        stats = daily_log.scan_stats(content).select("env", "day", "n_entries", "n_orphans")
        zero = F.lit(0).cast("bigint")
        scanned = disk.join(todo, ["env", "day"], "left_semi").join(stats, ["env", "day"], "left").withColumn(
            "n_entries", F.coalesce("n_entries", zero)).withColumn("n_orphans", F.coalesce("n_orphans", zero)).withColumn("scan", F.lit(scan))
        cols = ["env", "day", "rel_path", "path", "size", "mtime", "n_entries", "n_orphans", "scan"]
        gone = plan.where(F.col("action") != "keep").select("env", "day")
        kept = index.join(gone, ["env", "day"], "left_anti")
        self._snapshot(kept.select(*cols).unionByName(scanned.select(*cols)))
        return plan

    def rescan(self, root: str, env: str, day: dt.date) -> DataFrame:
        """One day again; a vanished file drops its rows."""
        return self.update(root, only=self.spark.createDataFrame([(env, day)], "env string, day date"))


def crlf_count(content: Column) -> Column:
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit("\r\n"))


def mirror_plan(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Action per listed day; ``files`` holds (env, day, local_size[, crlf])."""
    crlf = F.coalesce(F.col("crlf"), F.lit(0)) if "crlf" in files.columns else F.lit(0)
    remote, local = F.col("size"), F.col("local_size")
    action = (
        F.when(remote == 0, "empty").when(local.isNull(), "download").when(local == remote, "present")
        .when((local > remote) & (crlf > 0) & (local - crlf == remote), "crlf")
        .when(local > remote, "shrunk").otherwise("download")
    )
    return listing.join(files, ["env", "day"], "left").withColumn("action", action)


def crlf_of_larger(listing: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """CRLF pairs of the day files larger than listed: only those files are read."""
    larger = listing.join(files, ["env", "day"]).where(F.col("local_size") > F.col("size")).select("env", "day")
    return contents.join(larger, ["env", "day"], "left_semi").select(
        "env", "day", crlf_count(F.col("content")).alias("crlf"))


def announcement(plan: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    out = plan.groupBy("env").agg(
        F.count("*").alias("n_daily"), F.count_if(F.col("action") == "empty").alias("n_empty"),
        F.coalesce(F.sum(F.when(F.col("action") == "download", F.col("size"))), F.lit(0)).alias("bytes_to_download"))
    return out if loose is None else out.join(loose, "env", "left")


def run_tally(results: DataFrame) -> DataFrame:
    """Per env counters of an executed plan (``failed`` per row); shrunk days count nowhere."""
    a, bad = F.col("action"), F.coalesce("failed", F.lit(False))
    got = (a == "download") & ~bad
    return results.groupBy("env").agg(
        F.count_if(got).alias("downloaded"),
        F.count_if(a.isin("present", "crlf")).alias("present"),
        F.count_if(a == "empty").alias("empty"),
        F.count_if(a.isin("download", "shrunk") & bad).alias("failed"),
        F.coalesce(F.sum(F.when(got, F.col("size"))), F.lit(0)).alias("bytes"))


def newest_mirrored(results: DataFrame) -> DataFrame:
    """Newest confirmed day of each env (needs ``listed_at``; an empty day counts when listed later)."""
    a, bad = F.col("action"), F.coalesce("failed", F.lit(False))
    ok = a.isin("present", "crlf") | (a.isin("download", "shrunk") & ~bad) | (
        (a == "empty") & ~bad & (F.col("day") < F.col("listed_at").cast("date")))
    return results.groupBy("env").agg(F.max(F.when(ok, F.col("day"))).alias("newest_day"))


def exit_code(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """3 cancelled, else 1 with errors, else 2 when nothing was reachable, else 0."""
    s = F.col("status")
    agg = results.groupBy(*(by or [])).agg(
        F.count("*").alias("_n"), F.bool_or(s == "cancelled").alias("_c"), F.bool_or(s == "errors").alias("_e"),
        F.bool_or(s.isin("ok", "fresh")).alias("_ok"))
    return agg.withColumn(
        "exit_code", F.when(F.col("_c"), 3).when(F.col("_e"), 1).when((F.col("_n") > 0) & ~F.col("_ok"), 2).otherwise(0)
    ).drop("_n", "_c", "_e", "_ok")


def summary_text(results: DataFrame) -> DataFrame:
    """One sentence per env of a run."""
    tail = F.format_string(" (%d scaricati, %d già presenti, %d vuoti, %d errori)",
                           "downloaded", "present", "empty", "failed")
    text = F.concat(F.col("env"), F.lit(" "), label(F.col("status"), STATUS_LABELS),
                    F.when(F.col("status").isin("ok", "errors", "cancelled"), tail).otherwise(""))
    return results.withColumn("summary", text)


def last_compaction(now: Column, compaction: str) -> Column:
    """Today at the compaction time when it is past, else yesterday's."""
    today = F.to_timestamp(F.concat_ws(" ", now.cast("date").cast("string"), F.lit(compaction)))
    return F.when(now < today, today - F.expr("INTERVAL 1 DAY")).otherwise(today)


def freshness(state: DataFrame, now: Column, compaction: str) -> DataFrame:
    """``fresh``, ``empty_today`` or ``stale`` per env (needs last_success, newest_day, listed_empty)."""
    last = last_compaction(now, compaction)
    ok, newest = F.col("last_success"), F.col("newest_day")
    fresh = (ok <= now) & (ok >= last) & (newest >= last.cast("date"))
    today = last.cast("date")
    quiet = (
        (today == now.cast("date")) & (ok >= last) & (ok <= now)
        & F.array_contains("listed_empty", today) & (newest >= F.date_sub(today, 1))
    )
    return state.withColumn(
        "freshness",
        F.when(F.coalesce(fresh, F.lit(False)), "fresh")
        .when(F.coalesce(quiet, F.lit(False)), "empty_today").otherwise("stale"))


def coverage_days(local: DataFrame, listed: DataFrame, seen: DataFrame, envs: DataFrame, days: int,
                  today: dt.date) -> DataFrame:
    """(env, day, kind) of a calendar: present, pending, lost, empty, unknown.

    Present and empty days are not limited to the window; the other kinds are. Each side is
    reduced to one row per (env, day) before the joins.
    """
    loc = local.groupBy("env", "day").agg(F.max("size").alias("size"))
    lst = listed.select("env", "day").distinct()
    ever = seen.select("env", "day").unionByName(lst).distinct()
    first = local.groupBy("env").agg(F.min("day").alias("first_local"))
    t = F.lit(today)
    spine = envs.select("env").distinct().select(
        "env", F.explode(F.sequence(F.date_sub(t, days - 1), F.date_sub(t, 1))).alias("day"))
    spine = spine.withColumn("in_window", F.lit(True)).unionByName(
        loc.select("env", "day").withColumn("in_window", F.lit(False))
    ).groupBy("env", "day").agg(F.bool_or("in_window").alias("in_window"))
    yes = F.lit(True)
    j = (
        spine.join(loc, ["env", "day"], "left")
        .join(lst.withColumn("is_listed", yes), ["env", "day"], "left")
        .join(ever.withColumn("is_seen", yes), ["env", "day"], "left")
        .join(first, "env", "left")
    )
    kind = (
        F.when(F.col("size") > 0, "present")
        .when(F.col("in_window") & F.col("is_listed"), "pending")
        .when(F.col("in_window") & F.col("is_seen"), "lost")
        .when((F.col("size") == 0) & F.col("is_seen").isNull(), "empty")
        .when(F.col("in_window") & F.col("size").isNull() & (F.col("day") >= F.col("first_local"))
              & (F.weekday("day") < 5), "unknown")
    )
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("env", "day", "kind")


def missing_days(cov: DataFrame) -> DataFrame:
    return cov.where(F.col("kind").isin("pending", "lost")).select("env", "day")


def calendar_strip(cov: DataFrame, envs: DataFrame, days: int, today: dt.date) -> DataFrame:
    """``days`` days ending today, oldest first: adds today, weekend and before."""
    t = F.lit(today)
    spine = envs.select("env").distinct().select(
        "env", F.explode(F.sequence(F.date_sub(t, days - 1), t)).alias("day"))
    return spine.join(cov, ["env", "day"], "left").withColumn(
        "kind",
        F.when(F.col("day") == t, "today").when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.weekday("day") >= 5, "weekend").otherwise("before"),
    ).orderBy("env", "day")


def env_cards(envs: DataFrame, files: DataFrame, plan: DataFrame, state: DataFrame) -> DataFrame:
    """One card per env: non-empty local days, bytes, latest day, pending files, freshness."""
    local = files.where(F.col("size") > 0).groupBy("env").agg(
        F.count("*").alias("n_local_files"), F.sum("size").alias("local_bytes"), F.max("day").alias("latest_day"))
    z = F.lit(0).cast("bigint")
    return (
        envs.select("env").join(local, "env", "left").join(pending_count(plan), "env", "left")
        .join(state.select("env", "last_success", "freshness"), "env", "left")
        .select("env", F.coalesce("n_local_files", z).alias("n_local_files"),
                F.coalesce("local_bytes", z).alias("local_bytes"), "latest_day",
                F.coalesce("index_pending", z).alias("index_pending"), "last_success",
                F.coalesce("freshness", F.lit("stale")).alias("freshness"))
    )


def badges(cards: DataFrame) -> DataFrame:
    """``badge`` and ``attention`` per env from running, queued, reachable, failed, lost, pending, freshness."""
    c = F.col
    kind = (
        F.when(c("running"), "running").when(c("queued"), "queued").when(c("reachable") == F.lit(False), "unreachable")
        .when(c("failed") > 0, "errors").when(c("lost") > 0, "lost").when(c("pending") > 0, "pending")
        .when(c("freshness") == "fresh", "fresh").when(c("freshness") == "empty_today", "empty_today")
        .when(c("last_success").isNull(), "never").otherwise("stale")
    )
    return cards.withColumn("badge", kind).withColumn(
        "attention", F.coalesce(label(F.col("badge"), BADGE_ATTENTION), F.lit("")))


def overall_attention(badged: DataFrame, by: list[str] | None = None) -> DataFrame:
    a = F.col("attention")
    return badged.groupBy(*(by or [])).agg(
        F.when(F.bool_or(a == "bad"), "bad").when(F.bool_or(a == "warn"), "warn").otherwise("").alias("level"),
        F.count_if(a != "").alias("n_attention"),
        F.bool_or(F.col("badge").isin("running", "queued")).alias("running"))
