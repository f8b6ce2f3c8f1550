"""Call-log queries: names, body facts, search and browse."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import names
from ..operators import search as S
from ..sources.daily_log import with_body_facts
from .registry import query
from .views import CALLS, day_files, entries, raw_calls

W = "WITH " + CALLS
COLS = "env, day, seq, fdi, template_key, request_date"
ORDER = "day DESC, request_date IS NULL, request_date DESC, seq DESC"


def _hit(df):
    return df.select("env", "day", F.col("seq").cast("bigint").alias("seq"), "fdi", "template_key", "request_date")


@query("entry_names", W + "SELECT event_id, fdi, template_key, call_id, well_formed FROM calls")
def entry_names(spark, sf):
    r = raw_calls(spark, sf)
    return r.select("event_id", names.entry_name("raw").alias("n")).select(
        "event_id", "n.fdi", "n.template_key", "n.call_id", "n.well_formed")


@query("repeated_key_split", W + """
SELECT template_key, fdi, count(*) AS n FROM calls WHERE event_id % 11 = 2 GROUP BY 1, 2""")
def repeated_key_split(spark, sf):
    r = raw_calls(spark, sf).withColumn("rest", F.regexp_replace("raw", names.CALL_ID_TAIL, ""))
    r = r.withColumn("template_key", names.repeated_key(F.col("rest"))).where(F.col("template_key").isNotNull())
    return r.withColumn("fdi", names.entry_name("raw")["fdi"]).groupBy("template_key", "fdi").agg(F.count("*").alias("n"))


@query("body_facts", W + """
SELECT event_id, request_date, CAST(ndocs AS INTEGER) AS ndocs, dossier_id, json_ok,
  CAST(coalesce(ndocs, 0) AS INTEGER) AS n_doc_keys FROM calls""")
def body_facts_q(spark, sf):
    r = with_body_facts(raw_calls(spark, sf).select("event_id", "body"), F.col("body"))
    return r.select("event_id", "facts.request_date", "facts.ndocs", "facts.dossier_id", "facts.json_ok",
                    F.size("facts.doc_keys").alias("n_doc_keys"))


@query("fast_request_dates", W + "SELECT day, count(request_date) AS n_dated, max(request_date) AS last FROM calls GROUP BY day")
def fast_request_dates(spark, sf):
    from ..sources.daily_log import fast_facts

    r = raw_calls(spark, sf).select("day", fast_facts(F.col("body"))["request_date"].alias("d"))
    return r.groupBy("day").agg(F.count("d").alias("n_dated"), F.max("d").alias("last"))


@query("pasted_entries", W + """
SELECT event_id, CASE WHEN event_id % 11 = 2 THEN NULL ELSE fdi END AS fdi,
  CASE WHEN event_id % 11 = 2 THEN 'test-'||template_key||'_'||template_key ELSE template_key END AS template_key
FROM calls WHERE call_id IS NOT NULL""")
def pasted_entries(spark, sf):
    r = raw_calls(spark, sf)
    text = F.concat(F.lit("\n  ### "), "raw", F.lit(".json\n{}"))
    return r.select("event_id", names.pasted_entry(text).alias("p")).where(F.col("p").isNotNull()).select("event_id", "p.*")


@query("typed_tokens", W + """
SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN 'fdi' WHEN 1 THEN 'key' END AS kind,
  CASE event_id % 3 WHEN 0 THEN token WHEN 1 THEN upper(key0) END AS value FROM ev2""")
def typed_tokens(spark, sf):
    r = raw_calls(spark, sf).select("event_id", names.entry_name("raw").alias("n"), "user_id", "event_type")
    m = F.md5(F.col("user_id").cast("string").cast("binary"))
    token = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("mod_"), "event_type")).otherwise(
        F.concat(F.lit("MOD_"), F.upper("event_type")))
    typed = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper(token)))
        .when(F.col("event_id") % 3 == 1, key).otherwise(F.concat(key, F.lit(" ?"))))
    return r.select("event_id", names.typed_token(typed).alias("t")).select("event_id", "t.kind", "t.value")


@query("search_texts", W + """
SELECT event_id,
  CASE WHEN event_id % 2 = 0 THEN token END AS fdi,
  CASE WHEN event_id % 2 = 1 THEN upper(key0) END AS template_key FROM ev2""")
def search_texts(spark, sf):
    r = raw_calls(spark, sf)
    m = F.md5(F.col("user_id").cast("string").cast("binary"))
    token = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    key = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("mod_"), "event_type")).otherwise(
        F.concat(F.lit("MOD_"), F.upper("event_type")))
    typed = F.when(F.col("event_id") % 2 == 0, token).otherwise(key)
    return r.select("event_id", names.search_text(typed).alias("t")).select("event_id", "t.fdi", "t.template_key")


@query("typed_key_lists", W + """
SELECT user_id, string_agg(k, '|' ORDER BY first_id) AS keys FROM (
  SELECT user_id, lower(template_key) AS lk, arg_min(template_key, event_id) AS k, min(event_id) AS first_id
  FROM calls GROUP BY 1, 2) GROUP BY user_id""")
def typed_key_lists(spark, sf):
    e = entries(spark, sf)
    # One spelled key per (user, spelling) is enough: repeats add nothing to the typed text.
    spelled = e.groupBy("user_id", "template_key").agg(F.min("event_id").alias("first"))
    typed = spelled.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "template_key"))), lambda s: s["template_key"]), " ,;").alias("t"))
    return typed.select("user_id", F.array_join(names.key_list("t"), "|").alias("keys"))


@query("search_exact_key", W + f"""
SELECT {COLS} FROM calls WHERE env = 'coll' AND lower(template_key) = 'mod_click' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
ORDER BY {ORDER} LIMIT 1000""")
def search_exact_key(spark, sf):
    return _hit(S.search(entries(spark, sf), "coll", template_key="Mod_Click", day_from=dt.date(2024, 1, 5), day_to=dt.date(2024, 1, 20)))


@query("search_key_prefix", W + f"SELECT {COLS} FROM calls WHERE env = 'svil' AND lower(template_key) LIKE 'mod\\_p%' ESCAPE '\\' ORDER BY {ORDER} LIMIT 1000")
def search_key_prefix(spark, sf):
    return _hit(S.search(entries(spark, sf), "svil", template_key="MOD_P", key_mode="prefix"))


@query("search_key_contains", W + f"SELECT {COLS} FROM calls WHERE env = 'svil' AND contains(lower(template_key), 'vie') ORDER BY {ORDER} LIMIT 1000")
def search_key_contains(spark, sf):
    return _hit(S.search(entries(spark, sf), "svil", template_key="VIE", key_mode="contains"))


@query("search_fdi_prefix", W + f"SELECT {COLS} FROM calls WHERE env = 'coll' AND fdi LIKE 'c%' ORDER BY {ORDER} LIMIT 1000")
def search_fdi_prefix(spark, sf):
    return _hit(S.search(entries(spark, sf), "coll", fdi_prefix="C"))


@query("best_call_per_fdi", W + """
, nd AS (SELECT env, fdi, max(day) AS day FROM calls GROUP BY 1, 2),
d AS (SELECT c.* FROM calls c JOIN nd ON c.env = nd.env AND c.day = nd.day AND c.fdi IS NOT DISTINCT FROM nd.fdi)
SELECT env, fdi, day, seq, CAST(ndocs AS INTEGER) AS ndocs,
  row_number() OVER (PARTITION BY env, fdi ORDER BY coalesce(ndocs, -1) DESC, request_date IS NULL, request_date DESC, seq DESC) = 1 AS is_best
FROM d""")
def best_call_per_fdi(spark, sf):
    hits = entries(spark, sf).select("env", "fdi", "day", "seq", "ndocs", "request_date")
    return S.pick_best(hits, ["env", "fdi"]).select("env", "fdi", "day", "seq", "ndocs", "is_best")


@query("coverage_by_env", W + """
, f AS (SELECT env, day, count(*) AS n FROM calls GROUP BY 1, 2)
SELECT env, min(day) AS min_day, max(day) AS max_day, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_entries FROM f GROUP BY env""")
def coverage_by_env(spark, sf):
    return S.coverage(day_files(spark, sf))


@query("template_key_picker", W + """
SELECT lower(template_key) AS template_key_ci, max(day) AS last_day, count(*) AS n, min(template_key) AS template_key
FROM calls WHERE env = 'coll' AND lower(template_key) LIKE 'mod%' GROUP BY 1 ORDER BY last_day DESC, n DESC, 1 LIMIT 500""")
def template_key_picker(spark, sf):
    return S.template_keys(entries(spark, sf), "coll", "mod")


@query("fdi_picker", W + "SELECT DISTINCT fdi FROM calls WHERE env = 'coll' AND fdi LIKE 'c%' ORDER BY fdi LIMIT 20")
def fdi_picker(spark, sf):
    return S.fdi_values(entries(spark, sf), "coll", "C")


@query("find_command", W + f"""
, h AS (SELECT *, max(day) OVER () AS md FROM (SELECT * FROM calls WHERE env = 'coll' AND fdi LIKE 'c%' AND day BETWEEN DATE '2023-12-31' AND DATE '2024-01-30'
  ORDER BY {ORDER} LIMIT 1000))
SELECT env, day, seq, fdi, template_key,
  row_number() OVER (ORDER BY coalesce(ndocs, -1) DESC, request_date IS NULL, request_date DESC, seq DESC) = 1 AS is_best, 'found' AS status
FROM h WHERE day = md""")
def find_command(spark, sf):
    out = S.find(entries(spark, sf), day_files(spark, sf), "coll", fdi="C", day_to=dt.date(2024, 1, 30), days=30)
    return out.select("env", "day", "seq", "fdi", "template_key", "is_best", "status")


@query("hits_grouped_by_fdi", W + """
SELECT fdi, max(day) AS newest_day, nullif(arg_max(coalesce(request_date,''), (day, request_date IS NOT NULL, coalesce(request_date,''), seq)), '') AS newest_time,
  arg_max(seq, (day, request_date IS NOT NULL, coalesce(request_date,''), seq)) AS newest_seq, count(*) AS calls, count(DISTINCT day) = 1 AS one_day
FROM calls GROUP BY fdi""")
def hits_grouped_by_fdi(spark, sf):
    return S.group_hits(entries(spark, sf))


@query("hits_sorted_by_documents", W + f"""
SELECT {COLS} FROM (SELECT * FROM calls WHERE env = 'coll' AND lower(template_key) = 'mod_view' ORDER BY {ORDER} LIMIT 1000)""")
def hits_sorted_by_documents(spark, sf):
    hits = S.search(entries(spark, sf), "coll", template_key="mod_view")
    return _hit(S.sort_hits(hits, "ndocs", descending=True))


@query("period_presets", W + """
SELECT env, CAST(count_if(day BETWEEN DATE '2024-01-20' - 7 AND DATE '2024-01-20') AS BIGINT) AS last_7,
  CAST(count_if(day BETWEEN DATE '2024-01-20' - 30 AND DATE '2024-01-20') AS BIGINT) AS last_30,
  CAST(count_if(day BETWEEN DATE '2024-01-20' - 90 AND DATE '2024-01-20') AS BIGINT) AS last_90 FROM calls GROUP BY env""")
def period_presets(spark, sf):
    e = entries(spark, sf).select("env", *S.period_flags(F.col("day"), F.lit("2024-01-20").cast("date")))
    return e.groupBy("env").agg(*[F.count_if(f"last_{n}").alias(f"last_{n}") for n in S.PERIODS])


@query("recent_searches", W + """
SELECT env, fdi, key, mode, max(ts) AS ts FROM (
  SELECT env, coalesce(fdi,'') AS fdi, template_key AS key, CASE WHEN k % 2 = 0 THEN 'exact' ELSE 'prefix' END AS mode, ts FROM calls)
GROUP BY 1,2,3,4 ORDER BY ts DESC, 1,2,3,4 LIMIT 10""")
def recent_searches(spark, sf):
    h = entries(spark, sf).select(
        "env", F.coalesce("fdi", F.lit("")).alias("fdi"), F.col("template_key").alias("key"),
        F.when(F.col("k") % 2 == 0, "exact").otherwise("prefix").alias("mode"), "ts")
    return S.recent_searches(h)


@query("result_summary", W + "SELECT env, count(*) AS calls, count(DISTINCT coalesce(fdi,'')) AS fdis, count(DISTINCT day) AS days FROM calls GROUP BY env")
def result_summary(spark, sf):
    return S.summary(entries(spark, sf), ["env"])


@query("row_to_preselect", W + """
, m AS (SELECT *, max(day) OVER (PARTITION BY env, event_type) AS md FROM calls)
SELECT env, event_type, day, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY env, event_type ORDER BY CASE WHEN event_type = 'click' THEN coalesce(ndocs,-1) ELSE 0 END DESC,
    request_date IS NULL, request_date DESC, seq DESC) AS rn FROM m WHERE day = md) WHERE rn = 1""")
def row_to_preselect(spark, sf):
    hits = entries(spark, sf).select("env", "event_type", "day", "seq", "ndocs", "request_date")
    return S.preselect(hits, ["env", "event_type"], F.col("event_type") == "click").select("env", "event_type", "day", "seq")


@query("log_records_by_level", """
WITH l AS (SELECT 'log'||(user_id % 3) AS log, event_id AS line_no, event_type,
  CASE WHEN event_id % 4 = 0 THEN upper(CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END) END AS own FROM events),
f AS (SELECT log, line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY log ORDER BY line_no) AS level FROM l)
SELECT log, line_no, level FROM f WHERE level IN ('ERROR', 'WARNING')""")
def log_records_by_level(spark, sf):
    from .registry import table

    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    line = F.when(
        F.col("event_id") % 4 == 0,
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), level, F.lit(" something"))
    ).otherwise(F.lit("  continuation"))
    lines = e.select(F.concat(F.lit("log"), (F.col("user_id") % 3).cast("string")).alias("log"),
                     F.col("event_id").alias("line_no"), line.alias("line"))
    return S.log_records(lines, ["ERROR", "WARNING"]).select("log", "line_no", "level")


@query("log_tail", "SELECT log, line_no FROM (SELECT 'log'||(user_id % 3) AS log, event_id AS line_no, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 50")
def log_tail(spark, sf):
    from .registry import table

    e = table(spark, sf, "events").select(
        F.concat(F.lit("log"), (F.col("user_id") % 3).cast("string")).alias("log"), F.col("event_id").alias("line_no"))
    return S.tail(e, 50)


@query("output_names", W + """
, n AS (SELECT event_id, strftime(day, '%Y%m%d')||'_'||coalesce(fdi,'nofdi')||'_'||template_key AS stem, call_id FROM calls)
SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 AND call_id IS NOT NULL THEN stem||'_'||call_id ELSE stem END || '.json' AS name FROM n""")
def output_names(spark, sf):
    from ..sources.outputs import collision_free_names

    return collision_free_names(entries(spark, sf)).select("event_id", "name")
