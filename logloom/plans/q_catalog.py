"""Catalogue, mirror, coverage and archive queries over the call-log views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import archive as A
from ..operators import catalog as C
from ..operators import reports as R
from .registry import query, table
from .views import CALLS, day_files, entries, raw_calls

W = "WITH " + CALLS
TODAY = dt.date(2024, 2, 1)

# A mirror as tables: what is on disk, what the server listed, what was ever seen. Local days
# are those with an even day number, a quiet day is 0 bytes, listings and history follow ids.
MIRROR = W + """
, sizes AS (SELECT env, day, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, count(*) AS n, max(ts) AS mtime FROM calls GROUP BY 1, 2),
local AS (SELECT env, day, CASE WHEN day(day) % 10 = 4 THEN 0 ELSE bytes END AS size, mtime FROM sizes WHERE day(day) % 3 <> 0),
listed AS (SELECT env, day FROM sizes WHERE day(day) % 5 <> 1 AND day >= DATE '2024-01-10'),
seen AS (SELECT env, day FROM sizes WHERE day(day) % 7 <> 2)
"""


def _sizes(spark, sf):
    r = raw_calls(spark, sf).select("env", "day", "event_id", "ts")
    return r.groupBy("env", "day").agg(F.sum(F.col("event_id") % 1000).alias("bytes"), F.count("*").alias("n"), F.max("ts").alias("mtime"))


def _mirror(spark, sf):
    s = _sizes(spark, sf)
    dom = F.dayofmonth("day")
    local = s.where(dom % 3 != 0).select("env", "day", F.when(dom % 10 == 4, F.lit(0)).otherwise(F.col("bytes")).alias("size"), "mtime")
    listed = s.where((dom % 5 != 1) & (F.col("day") >= F.lit("2024-01-10").cast("date"))).select("env", "day")
    seen = s.where(dom % 7 != 2).select("env", "day")
    return s, local, listed, seen


@query("index_plan", MIRROR + """
, disk AS (SELECT env, day, size, mtime FROM local),
idx AS (SELECT env, day, CASE WHEN day(day) % 4 = 1 THEN size + 1 ELSE size END AS size, mtime FROM local WHERE day(day) % 7 <> 1
  UNION ALL SELECT env, day, bytes, mtime FROM sizes WHERE day(day) % 9 = 0)
SELECT coalesce(d.env, i.env) AS env, coalesce(d.day, i.day) AS day,
  CASE WHEN d.env IS NULL THEN 'remove' WHEN i.env IS NULL OR d.size <> i.size OR d.mtime <> i.mtime THEN 'scan' ELSE 'keep' END AS action
FROM disk d FULL JOIN idx i ON d.env = i.env AND d.day = i.day""")
def index_plan(spark, sf):
    s, local, _, _ = _mirror(spark, sf)
    dom = F.dayofmonth("day")
    idx = local.where(dom % 7 != 1).withColumn("size", F.when(dom % 4 == 1, F.col("size") + 1).otherwise(F.col("size")))
    idx = idx.unionByName(s.where(dom % 9 == 0).select("env", "day", F.col("bytes").alias("size"), "mtime"))
    return C.index_plan(local, idx)


@query("index_pending", MIRROR + """
SELECT env, count_if(day(day) % 7 = 1 OR day(day) % 4 = 1)::BIGINT AS index_pending FROM local GROUP BY env""")
def index_pending(spark, sf):
    _, local, _, _ = _mirror(spark, sf)
    dom = F.dayofmonth("day")
    idx = local.where(dom % 7 != 1).withColumn("size", F.when(dom % 4 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return C.pending_count(C.index_plan(local, idx))


@query("daily_file_counts", W + "SELECT env, count(DISTINCT day) AS n FROM calls GROUP BY env")
def daily_file_counts(spark, sf):
    d = raw_calls(spark, sf).select(paths.relative_path("env", "day").alias("rel")).distinct()
    name = F.substring_index("rel", "/", -1)
    ok = A.is_canonical(F.col("rel")) & paths.day_from_name(name).isNotNull()
    return d.where(ok).groupBy(F.substring_index("rel", "/", 1).alias("env")).agg(F.count("*").alias("n"))


@query("day_file_paths", W + """
SELECT DISTINCT env, day, env||'/'||strftime(day,'%Y/%m/%Y%m%d')||'.txt' AS rel_path FROM calls""")
def day_file_paths(spark, sf):
    d = raw_calls(spark, sf).select("env", "day").distinct()
    back = paths.day_from_name(paths.day_file_name("day"))
    return d.select("env", back.alias("day"), paths.relative_path("env", "day").alias("rel_path"))


MIRROR_PLAN = MIRROR + """
, plan AS (
  SELECT s.env, s.day, CASE WHEN day(s.day) % 10 = 4 THEN 0 ELSE s.bytes END AS size, l.size + CASE day(s.day) % 4 WHEN 0 THEN 0 WHEN 1 THEN s.n WHEN 2 THEN 5 ELSE -1 END AS local_size,
    CASE WHEN day(s.day) % 4 = 1 THEN s.n ELSE 0 END AS crlf
  FROM sizes s LEFT JOIN local l ON s.env = l.env AND s.day = l.day),
act AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN local_size IS NULL THEN 'download' WHEN local_size = size THEN 'present'
  WHEN local_size > size AND crlf > 0 AND local_size - crlf = size THEN 'crlf' WHEN local_size > size THEN 'shrunk' ELSE 'download' END AS action,
  day(day) % 6 = 5 AS failed FROM plan)
"""


def _plan(spark, sf):
    s, local, _, _ = _mirror(spark, sf)
    dom = F.dayofmonth("day")
    listing = s.select("env", "day", F.when(dom % 10 == 4, F.lit(0)).otherwise(F.col("bytes")).alias("size"), "n", "mtime")
    l2 = local.join(s.select("env", "day", "n"), ["env", "day"]).select(
        "env", "day", (F.col("size") + F.when(dom % 4 == 0, 0).when(dom % 4 == 1, F.col("n")).when(dom % 4 == 2, 5).otherwise(-1)).alias("local_size"),
        F.when(dom % 4 == 1, F.col("n")).otherwise(0).alias("crlf"))
    return C.mirror_plan(listing, l2)


def _ran(spark, sf):
    return _plan(spark, sf).withColumn("failed", F.dayofmonth("day") % 6 == 5).withColumn("listed_at", F.lit("2024-01-31 18:00:00").cast("timestamp"))


@query("mirror_plan", MIRROR_PLAN + "SELECT env, day, action FROM act")
def mirror_plan(spark, sf):
    return _plan(spark, sf).select("env", "day", "action")


@query("crlf_pairs", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS crlf FROM documents""")
def crlf_pairs(spark, sf):
    d = table(spark, sf, "documents")
    content = F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8")
    return d.select("doc_id", C.crlf_count(content).alias("crlf"))


@query("run_tally", MIRROR_PLAN + """
SELECT env, CAST(count_if(action = 'download' AND NOT failed) AS BIGINT) AS downloaded, CAST(count_if(action IN ('present','crlf')) AS BIGINT) AS present,
  CAST(count_if(action = 'empty') AS BIGINT) AS empty, CAST(count_if(action IN ('download','shrunk') AND failed) AS BIGINT) AS failed,
  CAST(coalesce(sum(CASE WHEN action = 'download' AND NOT failed THEN size END), 0) AS BIGINT) AS bytes FROM act GROUP BY env""")
def run_tally(spark, sf):
    return C.run_tally(_ran(spark, sf))


@query("listing_announcement", MIRROR_PLAN + """
SELECT env, count(*) AS n_daily, CAST(count_if(action='empty') AS BIGINT) AS n_empty,
  CAST(coalesce(sum(CASE WHEN action='download' THEN size END),0) AS BIGINT) AS bytes_to_download FROM act GROUP BY env""")
def listing_announcement(spark, sf):
    return C.announcement(_plan(spark, sf))


@query("newest_mirrored_day", MIRROR_PLAN + """
SELECT env, max(CASE WHEN action IN ('present','crlf') OR (action IN ('download','shrunk') AND NOT failed)
  OR (action = 'empty' AND NOT failed AND day < DATE '2024-01-31') THEN day END) AS newest_day FROM act GROUP BY env""")
def newest_mirrored_day(spark, sf):
    return C.newest_mirrored(_ran(spark, sf))


@query("run_exit_codes", MIRROR_PLAN + """
, r AS (SELECT day, env, CASE WHEN failed THEN 'errors' WHEN action = 'shrunk' THEN 'cancelled' WHEN action = 'download' THEN 'unreachable' WHEN action = 'crlf' THEN 'fresh' ELSE 'ok' END AS status FROM act)
SELECT day, CAST(CASE WHEN bool_or(status='cancelled') THEN 3 WHEN bool_or(status='errors') THEN 1 WHEN NOT bool_or(status IN ('ok','fresh')) THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM r GROUP BY day""")
def run_exit_codes(spark, sf):
    a = F.col("action")
    r = _ran(spark, sf).withColumn(
        "status", F.when(F.col("failed"), "errors").when(a == "shrunk", "cancelled").when(a == "download", "unreachable").when(a == "crlf", "fresh").otherwise("ok"))
    return C.exit_code(r, ["day"])


@query("run_summaries", MIRROR_PLAN + """
SELECT env, env||' completato ('||count_if(action = 'download' AND NOT failed)||' scaricati, '||count_if(action IN ('present','crlf'))||' già presenti, '||
  count_if(action = 'empty')||' vuoti, '||count_if(action IN ('download','shrunk') AND failed)||' errori)' AS summary FROM act GROUP BY env""")
def run_summaries(spark, sf):
    return C.summary_text(C.run_tally(_ran(spark, sf)).withColumn("status", F.lit("ok"))).select("env", "summary")


LISTING = W + """
, listing AS (SELECT env, day, CAST(day + INTERVAL 1 DAY + INTERVAL (event_id % 20) HOUR AS TIMESTAMP) AS listed_at, event_id % 7 AS size FROM calls)
"""


def _listing(spark, sf):
    r = raw_calls(spark, sf)
    at = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") + F.make_dt_interval(hours=(F.col("event_id") % 20).cast("int"))
    return r.select("env", "day", at.alias("listed_at"), (F.col("event_id") % 7).alias("size"))


@query("latest_listing", LISTING + """
SELECT env, day, size FROM listing l WHERE listed_at = (SELECT max(listed_at) FROM listing m WHERE m.env = l.env)""")
def latest_listing(spark, sf):
    from ..sources.listing import latest_listing as latest

    return latest(_listing(spark, sf)).select("env", "day", "size")


@query("days_ever_seen", LISTING + """
SELECT DISTINCT env, day FROM listing l WHERE size > 0 AND day >= (SELECT CAST(max(listed_at) AS DATE) FROM listing m WHERE m.env = l.env) - 400""")
def days_ever_seen(spark, sf):
    from ..sources.listing import ever_seen

    return ever_seen(_listing(spark, sf))


@query("freshness", LISTING + """
, st AS (SELECT env, user_id, max(ts) + INTERVAL 1 DAY AS last_success, max(day) AS newest_day FROM calls GROUP BY 1, 2),
c AS (SELECT *, TIMESTAMP '2024-01-31 21:00:00' AS now, TIMESTAMP '2024-01-31 19:30:00' AS last FROM st)
SELECT env, user_id, CASE
  WHEN last_success <= now AND last_success >= last AND newest_day >= DATE '2024-01-31' THEN 'fresh'
  WHEN last_success >= last AND last_success <= now AND user_id % 3 <> 0 AND newest_day >= DATE '2024-01-30' THEN 'empty_today' ELSE 'stale' END AS freshness FROM c""")
def freshness(spark, sf):
    e = raw_calls(spark, sf)
    st = e.groupBy("env", "user_id").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("last_success"), F.max("day").alias("newest_day"))
    today = F.lit("2024-01-31").cast("date")
    st = st.withColumn("listed_empty", F.when(F.col("user_id") % 3 != 0, F.array(today)).otherwise(F.array().cast("array<date>")))
    return C.freshness(st, F.lit("2024-01-31 21:00:00").cast("timestamp"), "19:30:00").select("env", "user_id", "freshness")


@query("last_compaction", """
SELECT event_id, CASE WHEN CAST(ts AS TIME) < TIME '19:30:00' THEN CAST(ts AS DATE) - INTERVAL 1 DAY ELSE CAST(ts AS DATE) END + INTERVAL '19:30' HOUR TO MINUTE AS last
FROM events""".replace("INTERVAL '19:30' HOUR TO MINUTE", "INTERVAL 1170 MINUTE"))
def last_compaction(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", C.last_compaction(F.col("ts").cast("timestamp"), "19:30:00").alias("last"))


COVER = MIRROR + """
, ever AS (SELECT * FROM seen UNION SELECT * FROM listed),
fl AS (SELECT env, min(day) AS first_local FROM local GROUP BY env),
spine AS (SELECT env, CAST(d AS DATE) AS day, true AS w FROM (SELECT DISTINCT env FROM calls), generate_series(DATE '2024-01-03', DATE '2024-01-31', INTERVAL 1 DAY) g(d)
  UNION ALL SELECT env, day, false FROM local),
sp AS (SELECT env, day, bool_or(w) AS w FROM spine GROUP BY 1, 2),
cov AS (SELECT sp.env, sp.day, CASE WHEN l.size > 0 THEN 'present' WHEN w AND li.env IS NOT NULL THEN 'pending' WHEN w AND ev.env IS NOT NULL THEN 'lost'
  WHEN l.size = 0 AND ev.env IS NULL THEN 'empty' WHEN w AND l.size IS NULL AND sp.day >= fl.first_local AND isodow(sp.day) < 6 THEN 'unknown' END AS kind
  FROM sp LEFT JOIN local l ON l.env = sp.env AND l.day = sp.day LEFT JOIN listed li ON li.env = sp.env AND li.day = sp.day
  LEFT JOIN ever ev ON ev.env = sp.env AND ev.day = sp.day LEFT JOIN fl ON fl.env = sp.env)
"""


def _cov(spark, sf):
    s, local, listed, seen = _mirror(spark, sf)
    return C.coverage_days(local, listed, seen, s, 30, TODAY), s


@query("coverage_calendar", COVER + "SELECT env, day, kind FROM cov WHERE kind IS NOT NULL")
def coverage_calendar(spark, sf):
    return _cov(spark, sf)[0]


@query("missing_days", COVER + "SELECT env, day FROM cov WHERE kind IN ('pending','lost')")
def missing_days(spark, sf):
    return C.missing_days(_cov(spark, sf)[0])


@query("calendar_strip", COVER + """
, strip AS (SELECT env, CAST(d AS DATE) AS day FROM (SELECT DISTINCT env FROM calls), generate_series(DATE '2024-01-03', DATE '2024-02-01', INTERVAL 1 DAY) g(d))
SELECT strip.env, strip.day, CASE WHEN strip.day = DATE '2024-02-01' THEN 'today' WHEN kind IS NOT NULL THEN kind WHEN isodow(strip.day) >= 6 THEN 'weekend' ELSE 'before' END AS kind
FROM strip LEFT JOIN cov ON cov.env = strip.env AND cov.day = strip.day""")
def calendar_strip(spark, sf):
    cov, s = _cov(spark, sf)
    return C.calendar_strip(cov, s, 30, TODAY)


@query("env_cards", COVER + """
, lc AS (SELECT env, count(*) AS n_local_files, CAST(sum(size) AS BIGINT) AS local_bytes, max(day) AS latest_day FROM local WHERE size > 0 GROUP BY env),
ip AS (SELECT env, CAST(count_if(day(day) % 4 = 1) AS BIGINT) AS index_pending FROM local GROUP BY env)
SELECT lc.env, n_local_files, local_bytes, latest_day, index_pending, 'stale' AS freshness FROM lc JOIN ip ON lc.env = ip.env""")
def env_cards(spark, sf):
    s, local, _, _ = _mirror(spark, sf)
    idx = local.withColumn("size", F.when(F.dayofmonth("day") % 4 == 1, F.col("size") + 1).otherwise(F.col("size")))
    st = s.groupBy("env").agg(F.max("mtime").alias("last_success")).withColumn("freshness", F.lit("stale"))
    return C.env_cards(s.select("env").distinct(), local, C.index_plan(local, idx), st).drop("last_success")


BADGES = W + """
, c AS (SELECT user_id, env, count(*) AS n, max(k) AS mk, min(k) AS nk, max(event_id) AS me FROM calls GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN me % 11 = 0 THEN 'running' WHEN me % 7 = 0 THEN 'queued' WHEN me % 5 = 0 THEN 'unreachable' WHEN nk > 0 THEN 'errors'
  WHEN n % 4 = 0 THEN 'lost' WHEN n % 4 = 1 THEN 'pending' WHEN n % 3 = 0 THEN 'fresh' WHEN n % 3 = 1 THEN 'empty_today' WHEN mk % 2 = 0 THEN 'never' ELSE 'stale' END AS badge FROM c),
t AS (SELECT *, CASE WHEN badge IN ('lost','errors') THEN 'bad' WHEN badge IN ('pending','unreachable','stale','never') THEN 'warn' ELSE '' END AS attention FROM b)
"""


def _badges(spark, sf):
    c = raw_calls(spark, sf).groupBy("user_id", "env").agg(
        F.count("*").alias("n"), F.max("k").alias("mk"), F.min("k").alias("nk"), F.max("event_id").alias("me"))
    c = c.select(
        "user_id", "env", (F.col("me") % 11 == 0).alias("running"), (F.col("me") % 7 == 0).alias("queued"), (F.col("me") % 5 != 0).alias("reachable"),
        F.col("nk").alias("failed"), (F.col("n") % 4 == 0).cast("int").alias("lost"), (F.col("n") % 4 == 1).cast("int").alias("pending"),
        F.when(F.col("n") % 3 == 0, "fresh").when(F.col("n") % 3 == 1, "empty_today").otherwise("stale").alias("freshness"),
        F.when(F.col("mk") % 2 != 0, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("last_success"))
    return C.badges(c)


@query("env_badges", BADGES + "SELECT user_id, env, badge, attention FROM t")
def env_badges(spark, sf):
    return _badges(spark, sf).select("user_id", "env", "badge", "attention")


@query("overall_attention", BADGES + """
SELECT env, CASE WHEN bool_or(attention='bad') THEN 'bad' WHEN bool_or(attention='warn') THEN 'warn' ELSE '' END AS level,
 CAST(count_if(attention <> '') AS BIGINT) AS n_attention, bool_or(badge IN ('running','queued')) AS running FROM t GROUP BY env""")
def overall_attention(spark, sf):
    return C.overall_attention(_badges(spark, sf), ["env"])


@query("pending_day_sentences", COVER + """
, p AS (SELECT env, day, row_number() OVER (PARTITION BY env ORDER BY day) AS rn, count(*) OVER (PARTITION BY env) AS n FROM cov WHERE kind = 'pending')
SELECT env, n, string_agg(strftime(day, '%d/%m/%Y'), ', ' ORDER BY day) FILTER (rn <= 5) || CASE WHEN n > 5 THEN ' e altri '||(n-5) ELSE '' END AS sentence FROM p GROUP BY env, n""")
def pending_day_sentences(spark, sf):
    return R.day_sentences(_cov(spark, sf)[0], "pending")


@query("listing_pages", W + """
SELECT DISTINCT env, day, strftime(day, '%Y%m%d')||'.txt' AS name, CAST(sum(event_id) AS BIGINT) AS size FROM calls GROUP BY env, day""")
def listing_pages(spark, sf):
    from ..sources.listing import parse_listing

    files = day_files(spark, sf)
    row = F.concat(F.lit('<a href="'), F.date_format("day", "yyyyMMdd"), F.lit('.txt">x</a>   '), F.date_format("day", "dd-MMM-yyyy"),
                   F.lit(" 21:00   "), F.col("size").cast("string"), F.lit("\n"))
    junk = F.lit('<a href="20241399.txt">x</a>  01-Jan-2024 00:00  12\n<a href="loose.json">l</a> 01-Jan-2024 00:00 5\n')
    # One page per env and month: a calendar bounds it.
    pages = files.groupBy("env", F.trunc("day", "month").alias("month")).agg(F.concat(F.array_join(F.array_sort(F.collect_list(row)), ""), junk).alias("html"))
    return parse_listing(pages).select("env", "day", "name", "size")


@query("listing_page_facts", W + """
SELECT env, day, CAST(count(*) AS INTEGER) AS n_loose, (day(day) % 2 = 0) AS abbreviated, (day(day) % 2 = 1) AS reachable FROM calls WHERE k < 20 GROUP BY env, day""")
def listing_page_facts(spark, sf):
    from ..sources.listing import page_facts

    e = raw_calls(spark, sf).where(F.col("k") < 20).groupBy("env", "day").agg(F.count("*").cast("int").alias("n"))
    size = F.when(F.dayofmonth("day") % 2 == 0, "98K").otherwise("98000")
    daily = F.concat(F.lit('<a href="'), F.date_format("day", "yyyyMMdd"), F.lit('.txt">x</a>  01-Jan-2024 00:00  '), size, F.lit("\n"))
    pages = e.withColumn("html", F.concat(daily, F.repeat(F.lit('<a href="x.json">x</a>\n'), F.col("n"))))
    return page_facts(pages).select("env", "day", "n_loose", "abbreviated", "reachable")


STATE_SQL = W + """
, s AS (SELECT user_id, env, max(day) AS newest, count(*) AS n, max(ts) AS last FROM calls GROUP BY 1, 2)
SELECT user_id, env, date_trunc('second', last) AS last_success, CAST(n AS INTEGER) AS last_remote_daily, CASE WHEN user_id % 2 = 0 THEN newest END AS newest_day,
  CAST(2 AS INTEGER) AS n_listed FROM s"""


@query("sync_state_documents", STATE_SQL)
def sync_state_documents(spark, sf):
    from ..sources.listing import parse_state

    s = raw_calls(spark, sf).groupBy("user_id", "env").agg(F.max("day").alias("newest"), F.count("*").alias("n"), F.max("ts").alias("last"))
    doc = F.concat(
        F.lit('{"envs":{"'), "env", F.lit('":{"last_success":"'), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('","last_remote_daily":'), F.col("n").cast("string"), F.lit(',"newest_day":"'),
        F.when(F.col("user_id") % 2 == 0, F.col("newest").cast("string")).otherwise("2024-13-01"),
        F.lit('","listed_nonempty":["2024-01-02","2024-01-01","2024-01-02",7,"x"]}}}'))
    st = parse_state(s.select("user_id", doc.alias("state")))
    return st.select("user_id", "env", "last_success", "last_remote_daily", "newest_day", F.size("listed_nonempty").alias("n_listed"))


@query("legacy_sync_state", W + """
SELECT user_id, env, CAST(max(day) AS TIMESTAMP) + INTERVAL 12 HOUR AS last_success FROM calls GROUP BY 1, 2""")
def legacy_sync_state(spark, sf):
    from ..sources.listing import parse_legacy_state

    s = raw_calls(spark, sf).groupBy("user_id", "env").agg(F.max("day").alias("d"))
    doc = F.concat(F.lit('﻿{"'), "env", F.lit('":"'), F.col("d").cast("string"), F.lit('","bad":"2024-99-99"}'))
    return parse_legacy_state(s.select("user_id", doc.alias("state")))


# ------------------------------------------------------------------ archive ---

FOUND = W + """
, f AS (SELECT event_id, day,
  CASE event_id % 9 WHEN 0 THEN 'svil/'||strftime(day,'%Y%m%d')||'.txt' WHEN 1 THEN strftime(day,'%Y/%m')||'/coll/'||strftime(day,'%d')||'.txt'
    WHEN 2 THEN 'x/coll_'||strftime(day,'%d-%m-%Y')||'.txt' WHEN 3 THEN 'coll'||strftime(day,'%Y%m%d')||'.txt' WHEN 4 THEN 'production/'||strftime(day,'%Y%m%d')||'.txt'
    WHEN 5 THEN 'svil/'||strftime(day,'%Y%m%d')||'_2024-03-03.txt' WHEN 6 THEN 'coll/log1234567.txt' WHEN 7 THEN 'coll/'||strftime(day,'%Y-%m-%d')||'.zip' ELSE 'coll/readme.md' END AS rel_path
  FROM calls)
"""


def _found(spark, sf):
    r = raw_calls(spark, sf)
    d = lambda fmt: F.date_format("day", fmt)
    m = F.col("event_id") % 9
    rel = (
        F.when(m == 0, F.concat(F.lit("svil/"), d("yyyyMMdd"), F.lit(".txt")))
        .when(m == 1, F.concat(d("yyyy/MM"), F.lit("/coll/"), d("dd"), F.lit(".txt")))
        .when(m == 2, F.concat(F.lit("x/coll_"), d("dd-MM-yyyy"), F.lit(".txt")))
        .when(m == 3, F.concat(F.lit("coll"), d("yyyyMMdd"), F.lit(".txt")))
        .when(m == 4, F.concat(F.lit("production/"), d("yyyyMMdd"), F.lit(".txt")))
        .when(m == 5, F.concat(F.lit("svil/"), d("yyyyMMdd"), F.lit("_2024-03-03.txt")))
        .when(m == 6, F.lit("coll/log1234567.txt"))
        .when(m == 7, F.concat(F.lit("coll/"), d("yyyy-MM-dd"), F.lit(".zip"))).otherwise(F.lit("coll/readme.md")))
    return r.select("event_id", rel.alias("rel_path"), (F.col("event_id") % 7).alias("size"), F.lit(True).alias("is_log"))


@query("found_file_classes", FOUND + """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'svil' WHEN 2 THEN 'coll' WHEN 3 THEN 'coll' END AS env,
 CASE WHEN event_id % 9 IN (0, 2, 3, 4) THEN day END AS day,
 CASE WHEN event_id % 9 IN (0, 2, 3) THEN 'importable' WHEN event_id % 9 = 4 THEN 'needs_env' ELSE 'ignored' END AS status,
 CASE event_id % 9 WHEN 0 THEN 'giorno mancante in archivio' WHEN 1 THEN 'nessuna data nel nome' WHEN 2 THEN 'giorno mancante in archivio' WHEN 3 THEN 'giorno mancante in archivio'
  WHEN 4 THEN 'ambiente non riconoscibile dal percorso' WHEN 5 THEN 'data ambigua' WHEN 6 THEN 'data ambigua'
  WHEN 7 THEN 'archivio compresso: estrailo nella cartella' ELSE 'nessuna data nel nome' END AS reason FROM f""")
def found_file_classes(spark, sf):
    out = A.classify(_found(spark, sf), ["svil", "coll"], dt.date(2024, 9, 24))
    return out.select("event_id", "env", "day", "status", "reason")


@query("found_file_report", FOUND + """
SELECT CAST(count_if(event_id % 9 IN (0,2,3)) AS BIGINT) AS importable, CAST(0 AS BIGINT) AS duplicate_same, CAST(count_if(event_id % 9 = 4) AS BIGINT) AS needs_env,
 CAST(0 AS BIGINT) AS conflict, CAST(count_if(event_id % 9 NOT IN (0,2,3,4)) AS BIGINT) AS ignored FROM f""")
def found_file_report(spark, sf):
    return A.report_counts(A.classify(_found(spark, sf), ["svil", "coll"], dt.date(2024, 9, 24)))


@query("folders_needing_env", FOUND + "SELECT DISTINCT 'production' AS rel_dir FROM f WHERE event_id % 9 = 4")
def folders_needing_env(spark, sf):
    return A.needs_env_dirs(A.classify(_found(spark, sf), ["svil", "coll"], dt.date(2024, 9, 24)))


@query("stray_files", FOUND + "SELECT CAST(count_if(event_id % 9 IN (0,2,3,4)) AS BIGINT) AS stray FROM f")
def stray_files(spark, sf):
    return A.stray_count(A.classify(_found(spark, sf), ["svil", "coll"], dt.date(2024, 9, 24)))


@query("found_file_plan", FOUND + """
SELECT CASE WHEN event_id % 9 IN (0, 2, 3) THEN 'importable' WHEN event_id % 9 = 4 THEN 'needs_env' ELSE 'ignored' END AS status, count(*) AS n FROM f GROUP BY 1""")
def found_file_plan(spark, sf):
    return R.status_plan(A.classify(_found(spark, sf), ["svil", "coll"], dt.date(2024, 9, 24)))


@query("folder_overrides", FOUND + """
SELECT event_id, CASE WHEN event_id % 9 = 2 THEN 'svil' WHEN event_id % 9 = 4 THEN 'ignora' WHEN event_id % 9 = 3 THEN 'coll'
  WHEN event_id % 9 = 1 THEN 'coll' ELSE 'coll' END AS choice FROM f""")
def folder_overrides(spark, sf):
    choice = paths.folder_choice(F.col("rel_path"), {"X": "SVIL", "production": "ignora", ".": "coll", "svil/deep": "svil"}, ["svil", "coll"])
    return _found(spark, sf).select("event_id", choice.alias("choice"))


# Copies of one day: each document is split in two files, one a prefix of the other or not.
COPIES = """
WITH d AS (SELECT doc_id, text FROM documents),
c AS (SELECT doc_id, 0 AS copy, text AS t FROM d UNION ALL SELECT doc_id, 1, substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) FROM d
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN 'X'||substr(text, 1, 9) ELSE text END FROM d),
g AS (SELECT doc_id, bool_or(copy = 2 AND doc_id % 3 = 0) AS div FROM c GROUP BY doc_id)
SELECT c.doc_id, c.copy, CASE WHEN div THEN 'conflict' WHEN copy = 0 THEN 'importable' ELSE 'duplicate_same' END AS status
FROM c JOIN g ON c.doc_id = g.doc_id"""


@query("copies_of_one_day", COPIES)
def copies_of_one_day(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("X"), F.substring("text", 1, 9))).otherwise(F.col("text"))
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    copies = d.select("doc_id", F.posexplode(F.array("text", half, other)).alias("copy", "t"))
    rel = F.concat_ws("/", F.col("doc_id").cast("string"), F.concat(F.col("copy").cast("string"), F.lit(".txt")))
    content = F.encode("t", "UTF-8")
    files = copies.select("doc_id", "copy", rel.alias("path"), content.alias("content"))
    found = files.select(
        "doc_id", "copy", "path", F.col("path").alias("rel_path"), F.octet_length("content").alias("size"),
        F.col("doc_id").cast("string").alias("env"), F.lit("2024-01-01").cast("date").alias("day"),
        F.lit("importable").alias("status"), F.lit("").alias("reason"))
    return A.resolve_copies(found, files).select("doc_id", "copy", "status")


@query("byte_relations", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'a_prefix' WHEN 2 THEN 'b_prefix' ELSE 'diverge' END AS relation FROM documents""")
def byte_relations(spark, sf):
    d = table(spark, sf, "documents")
    a = F.encode("text", "UTF-8")
    b = F.encode(F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!")))
                 .when(F.col("doc_id") % 4 == 2, F.left("text", F.length("text") - 1)).otherwise(F.concat(F.lit("\u0001"), "text")), "UTF-8")
    return d.select("doc_id", A.byte_relation(a, b).alias("relation"))


@query("import_outcomes", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 3 = 1 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'conflict' ELSE 'copied' END AS outcome FROM documents""")
def import_outcomes(spark, sf):
    return _import(spark, sf).select("doc_id", "outcome")


def _import(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    path, dest = F.concat(F.lit("/in/"), F.col("doc_id").cast("string")), F.concat(F.lit("/arch/"), F.col("doc_id").cast("string"))
    found = d.select("doc_id", path.alias("path"), dest.alias("dest"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), "sha",
                     F.when(F.col("doc_id") % 3 == 1, "duplicate_same").otherwise("importable").alias("status"), F.lit("coll").alias("env"))
    now = d.select(path.alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("now_size"), F.lit(1).alias("now_mtime"))
    # The archive holds every copy, but some destinations diverge.
    bad = (F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 3 != 1)
    written = d.select(dest.alias("dest"), F.col("n_chars").alias("dest_size"), F.when(bad, F.lit("?")).otherwise(F.col("sha")).alias("prefix_sha"))
    return A.import_outcome(found, now, written)


@query("import_counts", """
WITH o AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 3 = 1 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'conflict' ELSE 'copied' END AS outcome FROM documents)
SELECT CAST(count_if(outcome='copied') AS BIGINT) AS copied, CAST(count_if(outcome='skipped') AS BIGINT) AS skipped, CAST(count_if(outcome='conflict') AS BIGINT) AS conflicts,
 CAST(count_if(outcome='error') AS BIGINT) AS errors, CAST(count_if(outcome IN ('copied','skipped')) AS BIGINT) AS verified, 'coll' AS envs FROM o""")
def import_counts(spark, sf):
    return A.import_counts(_import(spark, sf)).withColumn("envs", F.array_join("touched_envs", ",")).drop("touched_envs")


@query("originals_safe_to_delete", """
SELECT doc_id, (doc_id % 5 <> 0 AND NOT (doc_id % 7 = 0 AND doc_id % 3 <> 1)) AS deletable FROM documents""")
def originals_safe_to_delete(spark, sf):
    return A.deletable(_import(spark, sf), "/arch").select("doc_id", F.col("keep_reason").isNull().alias("deletable"))


@query("expired_outputs", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
def expired_outputs(spark, sf):
    from ..sources.outputs import expired

    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("mtime"))
    return expired(e, F.lit("2024-01-30 00:00:00"), 24).select("event_id")


@query("path_dates", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts,'%Y-%m-%d') WHEN 1 THEN strftime(ts,'%Y-%m-%d') WHEN 2 THEN strftime(ts,'%Y-%m-%d') WHEN 3 THEN strftime(ts,'%Y-%m-%d') ELSE '' END AS days FROM events""")
def path_dates(spark, sf):
    e = table(spark, sf, "events")
    m, d = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    name = (F.when(m == 0, F.concat(F.lit("a_"), d("yyyyMMdd"), F.lit(".txt"))).when(m == 1, F.concat(F.lit("x "), d("dd.MM.yyyy")))
            .when(m == 2, d("yyyy_MM_dd")).when(m == 3, d("ddMMyyyy")).otherwise(F.concat(F.lit("1"), d("yyyyMMdd"))))
    days = paths.element_dates(name, F.lit("2024-09-24").cast("date"))
    return e.select("event_id", F.array_join(F.transform(days, lambda x: x.cast("string")), ",").alias("days"))
