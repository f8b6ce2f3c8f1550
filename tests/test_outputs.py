"""Bodies as they are written out, and header values that must not change between runs of a task."""

import json

from pyspark.sql import functions as F

from logloom.operators.batch import key_calls, spread_days, stable_uuid
from logloom.sources.outputs import pretty_json


def test_pretty_bodies(spark):
    bodies = ['{"b": 1, "a": ["è", {}]}'.encode(), b'{"a": \xff\x01}', 'no "JSON"\n☃'.encode(), b"", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body binary")
    got = [r.p for r in rows.select("id", pretty_json(F.col("body")).alias("p")).orderBy("id").collect()]
    assert got[0] == '{\n    "b": 1,\n    "a": [\n        "è",\n        {}\n    ]\n}\n' and got[4] is None
    assert json.loads(got[1]) == {"_parseError": "the body is not UTF-8", "raw": '{"a": �\x01}'}
    assert json.loads(got[2]) == {"_parseError": "the body is not JSON", "raw": 'no "JSON"\n☃'}
    assert json.loads(got[3]) == {"_parseError": "the body is not JSON", "raw": ""}
    assert got[2].startswith('{\n    "_parseError": "the body is not JSON",\n    "raw": ') and got[2].endswith("\n}\n")


def test_generated_ids_are_stable_and_distinct(spark):
    ids = [r.u for r in spark.range(50).select(stable_uuid("id", F.lit("t")).alias("u")).collect()]
    assert ids == [r.u for r in spark.range(50).select(stable_uuid("id", F.lit("t")).alias("u")).collect()]
    assert len(set(ids)) == 50 and all(len(u) == 36 and u[14] == "4" for u in ids)
    assert set(ids).isdisjoint(r.u for r in spark.range(50).select(stable_uuid("id", F.lit("other")).alias("u")).collect())


def test_days_of_a_key_have_no_limit_unless_asked(spark):
    days = F.transform(F.sequence(F.lit(0), F.lit(4000)), lambda i: F.date_sub(F.lit("2024-01-01").cast("date"), i))
    got = spark.range(1).select(F.size(spread_days(days)).alias("all"), F.size(spread_days(days, 8)).alias("some")).first()
    assert got == (12, 8) and key_calls.__defaults__ == (None, None)
