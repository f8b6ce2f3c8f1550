"""Call-log views over the ``events`` table: raw names and bodies, and the entries parsed from them.

Each event becomes one logged call. The Spark side writes the raw entry name and the raw JSON
body and parses them with the library; the SQL side states the parsed values directly, so the
comparison checks the parsing as well as the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.core import ascii_lower
from ..sources.daily_log import with_body_facts
from .registry import table

CALLS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    md5(CAST(user_id AS VARCHAR)) AS m,
    substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS cid,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ev2 AS (
  SELECT *, substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12) AS token,
    CASE WHEN event_id % 13 = 0 THEN 'mod_'||event_type ELSE 'MOD_'||upper(event_type) END AS key0,
    event_id % 11 AS shape
  FROM ev),
calls AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'coll' ELSE 'svil' END AS env,
    CAST(ts AS DATE) AS day, event_id AS seq, ts,
    CASE shape WHEN 0 THEN NULL WHEN 1 THEN token||'-t15' WHEN 2 THEN 'test-'||lower(key0) WHEN 3 THEN NULL ELSE token END AS fdi,
    CASE WHEN shape = 3 THEN upper(event_type) ELSE key0 END AS template_key,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE cid END AS call_id,
    (shape > 3 AND event_id % 17 <> 0) AS well_formed,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS request_date,
    CASE WHEN event_id % 10 = 0 OR event_id % 29 = 0 THEN NULL ELSE k % 5 END AS ndocs,
    CASE WHEN event_id % 10 = 0 OR event_id % 29 = 0 THEN NULL ELSE 'D'||user_id END AS dossier_id,
    (event_id % 10 <> 0 AND event_id % 29 <> 0) AS json_ok,
    event_id, user_id, event_type, value, k
  FROM ev2)
"""


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``env``, ``day``, ``raw`` (entry name) and ``body`` (one JSON line)."""
    e = table(spark, sf_dir, "events")
    m = F.md5(F.col("user_id").cast("string").cast("binary"))
    cid = F.left(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(16))
    token = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("mod_"), "event_type")).otherwise(
        F.concat(F.lit("MOD_"), F.upper("event_type")))
    shape = F.col("event_id") % 11
    head = (
        F.when(shape == 0, F.concat(F.lit(names.NO_FDI_PREFIX), key))
        .when(shape == 1, F.concat(token, F.lit("-t15_"), key))
        .when(shape == 2, F.concat(F.lit("test-"), key, F.lit("_"), key))
        .when(shape == 3, F.upper("event_type")).otherwise(F.concat(token, F.lit("_"), key)))
    raw = F.when(F.col("event_id") % 17 == 0, head).otherwise(F.concat(head, F.lit("_"), cid))
    k = F.get_json_object("props", "$.k").cast("int")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    date = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"requestDate":"'), stamp, F.lit('"')))
    doc = F.concat(F.lit('{"template":{"templateKey":"'), key, F.lit('"}}'))
    docs = F.array_join(F.array_repeat(doc, k % 5), ",")
    dossier = F.concat(F.lit('"dossier":{"id":"D'), F.col("user_id").cast("string"), F.lit('"'), date, F.lit("}"))
    body = (
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"documents": [ not json,'), dossier))
        .when(F.col("event_id") % 29 == 0, F.concat(F.lit("[{"), dossier, F.lit("}]")))
        .otherwise(F.concat(F.lit('{"documents":['), docs, F.lit("],"), dossier, F.lit("}"))))
    return e.select(
        "*", F.when(F.col("user_id") % 2 == 0, "coll").otherwise("svil").alias("env"),
        F.col("ts").cast("date").alias("day"), raw.alias("raw"), body.alias("body"), k.alias("k"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``entries`` table of the logged calls (parsed by the library, columns pruned by use)."""
    r = raw_calls(spark, sf_dir)
    n = names.entry_name("raw")
    r = with_body_facts(r.withColumn("n", n), F.col("body"))
    return r.select(
        "env", "day", F.col("event_id").alias("seq"), "ts", F.col("raw").alias("name"), F.col("n.fdi").alias("fdi"),
        F.col("n.template_key").alias("template_key"), ascii_lower(F.col("n.template_key")).alias("template_key_ci"),
        F.col("n.call_id").alias("call_id"), F.col("n.well_formed").alias("well_formed"),
        F.col("facts.request_date").alias("request_date"), F.col("facts.ndocs").alias("ndocs"),
        F.col("facts.dossier_id").alias("dossier_id"), F.col("facts.doc_keys").alias("doc_keys"),
        F.col("facts.json_ok").alias("json_ok"), F.length("body").alias("body_len"), "event_id", "user_id",
        "event_type", "value", "k")


def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files``: one row per (env, day) of the logged calls, with entries and bytes."""
    r = raw_calls(spark, sf_dir)
    return r.groupBy("env", "day").agg(
        F.count("*").alias("n_entries"), F.sum("event_id").alias("size"), F.max("ts").alias("mtime"))
