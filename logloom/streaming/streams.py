"""Structured Streaming forms: mirror to index, larger copy wins, duplicates, rates, batch totals, freshness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.catalog import EntryStore
from ..operators.ranking import last_by
from .listing_source import DayListing


def index_stream(spark: SparkSession, root: str, store: EntryStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Changes of the listing wake the incremental update; what to scan comes from the plan.

    The source's offset is the listing (size and time of every day file), so a day re-published under its name is a change, as is
    one that vanished. A batch that fails is run again; an update that finds nothing left to do writes an equal snapshot.
    """
    spark.dataSource.register(DayListing)
    changes = spark.readStream.format("day_listing").option("path", root).load()

    def update(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            store.update(root)

    return changes.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_largest(copies: DataFrame) -> DataFrame:
    """(env, day) → the largest copy seen; a smaller late one never shrinks a day."""
    return copies.groupBy("env", "day").agg(F.max_by(F.struct(*[c for c in copies.columns if c not in ("env", "day")]), "size").alias("s")).select("env", "day", "s.*")


def upsert_largest(path: str):
    """foreachBatch sink keeping the largest copy per (env, day) as numbered snapshots."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        from pyspark.errors import AnalysisException

        try:
            old = spark.read.parquet(f"{path}/v={epoch - 1}")
            batch = batch.unionByName(old)
        except AnalysisException:
            pass
        keep_largest(batch).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def drop_repeats(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events seen twice within the lateness are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def window_rates(events: DataFrame, late: str = "10 seconds", length: str = "3 seconds", slide: str = "1 second") -> DataFrame:
    """Bytes per run in a sliding window (``bytes`` is what each event adds)."""
    return events.withWatermark("ts", late).groupBy("run", F.window("ts", length, slide)).agg(F.sum("bytes").alias("bytes"))


def batch_totals(events: DataFrame) -> DataFrame:
    """Started and done items per batch run, in update mode."""
    t = F.col("type")
    return events.groupBy("run").agg(
        F.count_if(t == "BatchStarted").alias("started"), F.count_if(t == "BatchItemDone").alias("done"),
        F.count_if((t == "BatchItemDone") & (F.col("status") == "failed")).alias("failed"))


def throttle(events: DataFrame, millis: int = 100) -> DataFrame:
    """The last progress of each 100 ms per (run, name); a final event is always kept."""
    tick = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / millis)
    e = events.withColumn("_tick", tick)
    final = F.coalesce(F.col("done") == F.col("size"), F.lit(False))
    last = last_by(e.where(~final), ["run", "name", "_tick"], "ts").drop("_tick")
    return last.select(*events.columns).unionByName(events.where(final))


FRESH_SCHEMA = "env string, ts timestamp, freshness string"
_DAY = dt.timedelta(days=1)


def last_cut(now: dt.datetime, compaction: dt.time) -> dt.datetime:
    """The newest compaction at or before ``now``."""
    cut = dt.datetime.combine(now.date(), compaction)
    return cut if now >= cut else cut - _DAY


def freshness_at(now: dt.datetime, last: dt.datetime | None, newest: dt.date | None, empty: set[dt.date], compaction: dt.time) -> str:
    """``fresh``, ``empty_today`` or ``stale``, as ``operators.catalog.freshness`` says of a table."""
    cut = last_cut(now, compaction)
    if last is None or newest is None or not cut <= last <= now:
        return "stale"
    if newest >= cut.date():
        return "fresh"
    quiet = cut.date() == now.date() and cut.date() in empty and newest >= cut.date() - _DAY
    return "empty_today" if quiet else "stale"


class FreshnessProcessor(StatefulProcessor):
    """Per env: last success, newest confirmed day, days listed empty. A row after each batch, and one when a compaction passes.

    An env's events of a batch count in the order of their time. A timer stands at the next compaction: what was fresh until
    then is stale from then on, whether or not an event says so. Failed runs change no state. Times are UTC.
    """

    def __init__(self, compaction: dt.time) -> None:
        self.compaction = compaction

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sync", "last_ms bigint, newest string, empty string")

    def _row(self, env: str, now: dt.datetime, last: dt.datetime | None, newest: dt.date | None, empty: set[dt.date]) -> pd.DataFrame:
        told = freshness_at(now, last, newest, empty, self.compaction)
        if told != "stale":
            following = last_cut(now, self.compaction) + _DAY
            self.handle.registerTimer(_millis(following))
        return pd.DataFrame({"env": [env], "ts": [pd.Timestamp(now)], "freshness": [told]})

    def _known(self) -> tuple[dt.datetime | None, dt.date | None, set[dt.date]]:
        if not self.state.exists():
            return None, None, set()
        ms, newest, empty = self.state.get()
        return (None if ms is None else _moment(ms), dt.date.fromisoformat(newest) if newest else None,
                {dt.date.fromisoformat(d) for d in (empty or "").split(",") if d})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, newest, empty = self._known()
        now = None
        for event in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            at = event.ts.to_pydatetime().replace(tzinfo=None)
            now = at
            if event.ok:
                last = at if last is None else max(last, at)
                if isinstance(event.newest_day, dt.date):
                    newest = event.newest_day if newest is None else max(newest, event.newest_day)
                empty = set(event.listed_empty) if event.listed_empty is not None else set()
        self.state.update((None if last is None else _millis(last), newest.isoformat() if newest else None,
                           ",".join(sorted(d.isoformat() for d in empty))))
        yield self._row(key[0], now, last, newest, empty)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key[0], _moment(expiredTimerInfo.getExpiryTimeInMs()), *self._known())

    def close(self) -> None:
        pass


def _millis(moment: dt.datetime) -> int:
    return int(moment.replace(tzinfo=dt.UTC).timestamp() * 1000)


def _moment(millis: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(millis / 1000, dt.UTC).replace(tzinfo=None)


def freshness_stream(events: DataFrame, compaction: dt.time, late: str = "0 seconds") -> DataFrame:
    """(env, ts, freshness) as sync events arrive (env, ts, ok, newest_day, listed_empty) and as compactions pass."""
    # state with timers needs this store
    events.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.withWatermark("ts", late).groupBy("env").transformWithStateInPandas(
        statefulProcessor=FreshnessProcessor(compaction), outputStructType=FRESH_SCHEMA, outputMode="Update", timeMode="EventTime")
