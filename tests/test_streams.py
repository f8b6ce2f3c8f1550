"""Streams on files: a day that grows or vanishes wakes the index, freshness goes with time, the largest copy stays."""

import datetime as dt
import os

import pytest

from logloom.operators import catalog
from logloom.streaming import listing_source, streams

EVENT = "env string, ts timestamp, ok boolean, newest_day date, listed_empty array<date>"
NOON = dt.time(12, 30)
BODY = '{"documents": [], "dossier": {"id": "D1"}}'


def day_file(root, env, day, entries):
    path = root / env / day[:4] / day[4:6] / f"{day}.txt"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"### {name}.json\n{BODY}\n" for name in entries))
    return path


def test_a_day_that_grows_wakes_the_index(spark, tmp_path):
    root = tmp_path / "logs"
    name = "aaaaaaaa-1111-4222-8333-444444444444_CTR_{:016x}"
    grown = day_file(root, "coll", "20260918", [name.format(1)])
    gone = day_file(root, "svil", "20260917", [name.format(2), name.format(3)])
    (root / "coll" / "2026" / "09" / "20260999.txt").write_text("no day")
    store = catalog.EntryStore(spark, str(tmp_path / "store"))

    def run():
        query = streams.index_stream(spark, str(root), store, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r["env"], r["day"].isoformat()): r["n"] for r in store.entries().groupBy("env", "day").count().withColumnRenamed("count", "n").collect()}

    assert run() == {("coll", "2026-09-18"): 1, ("svil", "2026-09-17"): 2}
    snapshot = store.files().select("scan").distinct().collect()
    assert run() == {("coll", "2026-09-18"): 1, ("svil", "2026-09-17"): 2}
    assert store.files().select("scan").distinct().collect() == snapshot  # nothing changed, nothing scanned
    day_file(root, "coll", "20260918", [name.format(1), name.format(4), name.format(5)])  # under the same name
    os.utime(grown, ns=(1, 1))
    gone.unlink()
    day_file(root, "svil", "20260919", [name.format(6)])
    assert run() == {("coll", "2026-09-18"): 3, ("svil", "2026-09-19"): 1}


def test_rows_of_two_listings(tmp_path):
    day_file(tmp_path, "coll", "20260918", ["a"])
    reader = listing_source.DayListingReader(str(tmp_path))
    first = reader.latestOffset()
    assert list(first) == ["coll/2026/09/20260918.txt"] and reader.partitions(first, first) == []
    day_file(tmp_path, "coll", "20260918", ["a", "b"])
    day_file(tmp_path, "coll", "20250101", [])
    second = reader.latestOffset()
    rows = lambda a, b: [r for p in reader.partitions(a, b) for r in reader.read(p)]
    assert [(r[1].isoformat(), r[5]) for r in rows(first, second)] == [("2025-01-01", "new"), ("2026-09-18", "changed")]
    assert [(r[0], r[3], r[5]) for r in rows(second, {})] == [("coll", None, "gone")] * 2
    assert rows({}, {}) == [] and listing_source.list_days(str(tmp_path / "none")) == {}


def at(day, hour, minute=0):
    return dt.datetime(2026, 9, day, hour, minute)


def test_freshness_goes_stale_when_a_compaction_passes(spark, tmp_path):
    day = lambda n: dt.date(2026, 9, n)
    out = str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = streams.freshness_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), NOON)
        query = told.writeStream.outputMode("update").foreachBatch(lambda b, e: b.write.mode("append").parquet(out)).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return sorted((r["env"], r["ts"], r["freshness"]) for r in spark.read.parquet(out).collect())

    first = [("a", at(10, 18), "fresh"), ("b", at(10, 18), "empty_today"), ("c", at(10, 18), "stale"), ("d", at(10, 9), "fresh")]
    assert run([("a", at(10, 18), True, day(10), []), ("b", at(10, 18), True, day(9), [day(10)]), ("b", at(10, 17), False, None, None),
                ("c", at(10, 18), False, None, None), ("d", at(10, 9), True, day(9), [])])[:3] == first[:3]
    rows = run([("c", at(11, 13), True, day(11), [])])
    for expected in [*first, ("a", at(11, 12, 30), "stale"), ("b", at(11, 12, 30), "stale"), ("c", at(11, 13), "fresh"), ("d", at(10, 12, 30), "stale")]:
        assert expected in rows, (expected, rows)
    assert len(rows) == 8


@pytest.mark.parametrize("now", [at(10, 12, 29), at(10, 12, 30), at(10, 23), at(11, 0), at(11, 12, 31)])
def test_freshness_as_the_table_says(spark, now):
    from pyspark.sql import functions as F

    days = [None, dt.date(2026, 9, 8), dt.date(2026, 9, 9), dt.date(2026, 9, 10)]
    states = [(i, last, newest, empty) for i, (last, newest, empty) in enumerate(
        (x, y, z) for x in (None, at(9, 13), at(10, 12, 30), at(10, 22), at(12, 0)) for y in days for z in ([], [dt.date(2026, 9, 10)]))]
    df = spark.createDataFrame(states, "id int, last_success timestamp, newest_day date, listed_empty array<date>")
    told = {r["id"]: r["freshness"] for r in catalog.freshness(df, F.lit(now), "12:30:00").collect()}
    assert told == {i: streams.freshness_at(now, last, newest, set(empty), NOON) for i, last, newest, empty in states}


def test_the_largest_copy_of_a_day_stays(spark, tmp_path):
    write = streams.upsert_largest(str(tmp_path / "days"))
    schema = "env string, day string, size long, path string"
    write(spark.createDataFrame([("a", "1", 5, "x"), ("a", "2", 9, "y")], schema), 0)
    write(spark.createDataFrame([("a", "1", 7, "z"), ("a", "2", 3, "w"), ("b", "1", 1, "q")], schema), 1)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "days") + "/v=1").select("env", "day", "size", "path").collect())
    assert got == [("a", "1", 7, "z"), ("a", "2", 9, "y"), ("b", "1", 1, "q")]
