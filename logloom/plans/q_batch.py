"""Batch queries: packages, targets, resolution, outcomes, headers and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from .registry import query, table
from .views import CALLS, entries

W = "WITH " + CALLS

# part as a package list: the brand is the package, the type the key, spelled in two cases.
PKG = """
WITH pk AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS template_key,
  CASE WHEN p_partkey % 19 = 0 THEN '_senza_pacchetto' ELSE p_brand END AS package FROM part),
packages AS (SELECT min(ord) AS ord, lower(template_key) AS lk, package, arg_min(template_key, ord) AS template_key FROM pk GROUP BY 2, 3)
"""


def _packages(spark, sf):
    from ..sources.packages import unique_packages

    p = table(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("template_key"),
        F.when(F.col("p_partkey") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_brand")).alias("package"))
    return unique_packages(rows)


@query("package_list", PKG + "SELECT ord, template_key, package FROM packages")
def package_list(spark, sf):
    return _packages(spark, sf).select("ord", "template_key", "package")


@query("package_summary", PKG + "SELECT package, count(DISTINCT lk) AS n_keys FROM packages GROUP BY package")
def package_summary(spark, sf):
    return B.package_summary(_packages(spark, sf))


@query("keys_of_packages", PKG + """
SELECT arg_min(template_key, ord) AS template_key, min(ord) AS ord FROM packages WHERE package IN ('Brand#3', 'Brand#7') GROUP BY lk""")
def keys_of_packages(spark, sf):
    return B.keys_of(_packages(spark, sf), ["Brand#3", "Brand#7"]).select("template_key", "ord")


@query("targets_from_keys", PKG + """
, keys AS (SELECT min(p_partkey) AS ord, lower(p_type) AS lk, arg_min(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END, p_partkey) AS value FROM
   (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_type||'?' ELSE p_type END AS p_type FROM part) GROUP BY 2),
f AS (SELECT lk, string_agg(package, '|' ORDER BY ord) AS folders FROM packages GROUP BY lk)
SELECT keys.ord, keys.value, coalesce(f.folders, '_senza_pacchetto') AS folders FROM keys LEFT JOIN f ON f.lk = keys.lk""")
def targets_from_keys(spark, sf):
    p = table(spark, sf, "part")
    t = F.when(F.col("p_partkey") % 11 == 0, F.concat("p_type", F.lit("?"))).otherwise(F.col("p_type"))
    keys = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, t).otherwise(F.lower(t)).alias("value"))
    return B.targets_from_keys(keys, _packages(spark, sf)).select("ord", "value", F.array_join("folders", "|").alias("folders"))


@query("targets_from_packages", PKG + """
, ch AS (SELECT * FROM packages WHERE package IN ('Brand#3', 'Brand#7'))
SELECT min(ord) AS ord, arg_min(template_key, ord) AS value, string_agg(package, '|' ORDER BY ord) AS folders FROM ch GROUP BY lk""")
def targets_from_packages(spark, sf):
    return B.targets_from_packages(_packages(spark, sf), ["Brand#3", "Brand#7"]).select("ord", "value", F.array_join("folders", "|").alias("folders"))


@query("targets_from_fdis", W + "SELECT min(event_id) AS ord, arg_min(upper(fdi), event_id) AS value FROM calls WHERE fdi IS NOT NULL GROUP BY lower(fdi)")
def targets_from_fdis(spark, sf):
    e = entries(spark, sf).where(F.col("fdi").isNotNull()).select(F.col("event_id").alias("ord"), F.concat(F.lit(" "), F.upper("fdi")).alias("value"))
    return B.targets_from_fdis(e).select("ord", "value")


@query("targets_from_hits", W + "SELECT event_id AS ord, template_key AS value, coalesce(fdi, '_senza_pacchetto') AS folder FROM calls")
def targets_from_hits(spark, sf):
    e = entries(spark, sf)
    twice = e.select("env", "day", "seq", "template_key", "fdi", F.explode(F.array(F.col("event_id"), F.col("event_id") + 10_000_000)).alias("ord"))
    return B.targets_from_hits(twice).select("ord", "value", F.get("folders", F.lit(0)).alias("folder"))


def _key_targets(spark, sf):
    p = entries(spark, sf).groupBy("template_key").agg(F.min("event_id").alias("ord"))
    rows = p.select("ord", F.lit("key").alias("kind"), F.col("template_key").alias("value"), F.array(F.lit("x")).alias("folders"))
    extra = spark.createDataFrame([(10_000_000, "key", "MOD_NEVER", ["x"])], "ord bigint, kind string, value string, folders array<string>")
    return rows.unionByName(extra)


SPREAD = W + """
, t AS (SELECT lower(template_key) AS lk, min(event_id) AS ord, template_key AS value FROM calls GROUP BY 1, 3 UNION ALL SELECT 'mod_never', 10000000, 'MOD_NEVER'),
d AS (SELECT lk, env, day, seq, template_key FROM (SELECT lower(template_key) AS lk, *, row_number() OVER (PARTITION BY lower(template_key), env, day
  ORDER BY request_date IS NULL, request_date DESC, seq DESC) AS rn FROM calls) WHERE rn = 1),
a AS (SELECT lk, env, max(day) AS d0 FROM d GROUP BY 1, 2),
-- Each kept day is the newest one old enough and older than the one kept before it.
k1 AS (SELECT a.*, (SELECT max(day) FROM d x WHERE x.lk = a.lk AND x.env = a.env AND x.day <= a.d0 - 1) AS d1 FROM a),
k2 AS (SELECT k1.*, (SELECT max(day) FROM d x WHERE x.lk = k1.lk AND x.env = k1.env AND x.day <= k1.d0 - 3 AND x.day < k1.d1) AS d2 FROM k1),
k3 AS (SELECT k2.*, (SELECT max(day) FROM d x WHERE x.lk = k2.lk AND x.env = k2.env AND x.day <= k2.d0 - 7 AND x.day < k2.d2) AS d3 FROM k2),
k4 AS (SELECT k3.*, (SELECT max(day) FROM d x WHERE x.lk = k3.lk AND x.env = k3.env AND x.day <= k3.d0 - 15 AND x.day < k3.d3) AS d4 FROM k3),
k AS (SELECT d.lk, d.env, d.day, d.seq, d.template_key, CASE WHEN d.env = 'coll' THEN 0 ELSE 1 END AS eno FROM d JOIN k4 ON k4.lk = d.lk AND k4.env = d.env
  WHERE d.day IN (d0, d1, d2, d3, d4)),
h AS (SELECT lk, arg_min(seq, (eno, -epoch(day))) AS seq, arg_min(template_key, (eno, -epoch(day))) AS key,
  string_agg(env||' '||strftime(day,'%Y-%m-%d'), '|' ORDER BY eno, day DESC) AS every FROM k GROUP BY lk)
SELECT t.ord, coalesce(h.key, t.value) AS key, h.seq, coalesce(every, '') AS tried FROM t LEFT JOIN h ON h.lk = t.lk"""


@query("newest_call_per_key", SPREAD)
def newest_call_per_key(spark, sf):
    c = B.key_calls(_key_targets(spark, sf), entries(spark, sf), ["coll", "svil"], per_env=8, most=16)
    tried = F.array_join(F.transform(F.concat(F.array_compact(F.array("hit")), "alternates"), lambda h: F.concat_ws(" ", h["env"], h["day"].cast("string"))), "|")
    return c.select("ord", "key", F.col("hit.seq").alias("seq"), tried.alias("tried"))


def _fdi_targets(spark, sf):
    e = entries(spark, sf).where((F.col("env") == "coll") & F.col("fdi").isNotNull())
    f = e.groupBy("fdi").agg(F.min("event_id").alias("ord"))
    keys = F.when(F.col("ord") % 2 == 0, F.array(F.lit("mod_VIEW"), F.lit("MOD_NEVER"))).otherwise(F.array().cast("array<string>"))
    return f.select("ord", F.lit("fdi").alias("kind"), F.upper("fdi").alias("value"), F.array().cast("array<string>").alias("folders"), keys.alias("keys"))


@query("calls_per_fdi", W + """
, c AS (SELECT * FROM calls WHERE env = 'coll' AND fdi IS NOT NULL),
t AS (SELECT fdi, min(event_id) AS ord FROM c GROUP BY fdi),
b AS (SELECT fdi, lower(template_key) AS lk, template_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY fdi, lower(template_key)
  ORDER BY day DESC, request_date IS NULL, request_date DESC, seq DESC) AS rn FROM c) WHERE rn = 1),
w AS (SELECT ord, fdi, 0 AS pos, 'mod_VIEW' AS want FROM t WHERE ord % 2 = 0 UNION ALL SELECT ord, fdi, 1, 'MOD_NEVER' FROM t WHERE ord % 2 = 0)
SELECT w.ord, CAST(w.pos AS INTEGER) AS pos, coalesce(b.template_key, w.want) AS key, b.seq FROM w LEFT JOIN b ON b.fdi = w.fdi AND b.lk = lower(w.want)
UNION ALL SELECT t.ord, CAST(0 AS INTEGER), b.template_key, b.seq FROM t JOIN b ON b.fdi = t.fdi WHERE t.ord % 2 = 1""")
def calls_per_fdi(spark, sf):
    return B.fdi_calls(_fdi_targets(spark, sf), entries(spark, sf), "coll").select("ord", "pos", "key", F.col("hit.seq").alias("seq"))


@query("exact_calls", W + "SELECT event_id AS ord, template_key AS key, fdi FROM calls WHERE event_id % 2 = 0")
def exact_calls(spark, sf):
    e = entries(spark, sf)
    t = e.where(F.col("event_id") % 2 == 0).select(
        F.col("event_id").alias("ord"), F.lit("call").alias("kind"), F.array(F.lit("x")).alias("folders"), "env", "day", "seq")
    return B.exact_calls(t, e).select("ord", "key", "fdi")


@query("resolved_targets", W + """
, t AS (SELECT lower(template_key) AS lk, template_key AS value FROM calls GROUP BY 1, 2), c AS (SELECT * FROM calls WHERE env = 'coll' AND fdi IS NOT NULL)
SELECT 'key' AS kind, count(*) + 1 AS n, count(*) AS n_hits FROM t
UNION ALL SELECT 'fdi', (SELECT 2 * count(*) FROM (SELECT fdi FROM c GROUP BY fdi HAVING min(event_id) % 2 = 0)) +
   (SELECT count(*) FROM (SELECT DISTINCT fdi, lower(template_key) FROM c) x(fdi, lk) JOIN (SELECT fdi FROM c GROUP BY fdi HAVING min(event_id) % 2 = 1) y ON x.fdi = y.fdi),
   (SELECT count(*) FROM (SELECT DISTINCT fdi FROM c WHERE lower(template_key) = 'mod_view') x JOIN (SELECT fdi FROM c GROUP BY fdi HAVING min(event_id) % 2 = 0) y ON x.fdi = y.fdi) +
   (SELECT count(*) FROM (SELECT DISTINCT fdi, lower(template_key) FROM c) x(fdi, lk) JOIN (SELECT fdi FROM c GROUP BY fdi HAVING min(event_id) % 2 = 1) y ON x.fdi = y.fdi)""")
def resolved_targets(spark, sf):
    t = _key_targets(spark, sf).unionByName(_fdi_targets(spark, sf), allowMissingColumns=True)
    calls = B.resolve(t, entries(spark, sf), "coll", ["svil", "coll"], per_env=8, most=16)
    kind = F.when(F.size("folders") == 1, F.when(F.get("folders", F.lit(0)) == "x", "key").otherwise("fdi"))
    return calls.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("hit").alias("n_hits"))


HTML = """, ans AS (SELECT template_key AS key, event_id AS t, CASE WHEN k % 3 = 0 THEN 'html' ELSE 'pdf' END AS doc_type FROM calls),
hk AS (SELECT lower(key) AS key_lc FROM ans GROUP BY 1 HAVING arg_max(doc_type, t) = 'html')"""


@query("html_key_memory", W + HTML + " SELECT key_lc FROM hk")
def html_key_memory(spark, sf):
    return B.html_memory(_answers(spark, sf))


def _answers(spark, sf):
    return entries(spark, sf).select(
        F.col("template_key").alias("key"), F.col("event_id").alias("ts"), F.when(F.col("k") % 3 == 0, "html").otherwise("pdf").alias("doc_type"))


@query("calls_to_send", W + HTML + """
, t AS (SELECT lower(template_key) AS lk, template_key AS value FROM calls GROUP BY 1, 2)
SELECT count(*) AS n_calls FROM t WHERE lk NOT IN (SELECT key_lc FROM hk)""")
def calls_to_send(spark, sf):
    calls = B.key_calls(_key_targets(spark, sf), entries(spark, sf), ["coll", "svil"], per_env=8, most=16)
    return B.count_calls(calls, B.html_memory(_answers(spark, sf)))


# Attempts from lineitem: an order is a call, its lines the attempts in order.
ATT = """
WITH a AS (SELECT l_orderkey AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
  CASE WHEN l_returnflag = 'A' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN l_linestatus = 'O' THEN 500 END AS http_status,
  CAST(l_quantity AS INTEGER) AS duration_ms, 'r'||CAST(l_quantity AS INTEGER) AS reason FROM lineitem),
st AS (SELECT ord, min(CASE WHEN NOT (status = 'failed' AND http_status IS NOT NULL) THEN n END) AS stop FROM a GROUP BY ord),
u AS (SELECT a.* FROM a JOIN st ON a.ord = st.ord WHERE stop IS NULL OR n <= stop),
o AS (SELECT ord, count(*) AS attempts, min(CASE WHEN status='ok' THEN n END) AS g, min(CASE WHEN status='failed' THEN n END) AS b FROM u GROUP BY ord),
oc AS (SELECT o.ord, u.status, u.http_status, u.duration_ms, CASE WHEN g IS NULL AND attempts > 1 THEN u.reason||' (provate '||attempts||' chiamate dei log, tutte rifiutate)' ELSE u.reason END AS reason, attempts
  FROM o JOIN u ON u.ord = o.ord AND u.n = coalesce(o.g, o.b))
"""


def _attempts(spark, sf):
    li = table(spark, sf, "lineitem")
    from pyspark.sql import Window

    # The attempts of one call: an order's few lines.
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("ord"), F.row_number().over(w).alias("n"),
        F.when(F.col("l_returnflag") == "A", "ok").otherwise("failed").alias("status"), F.when(F.col("l_linestatus") == "O", 500).alias("http_status"),
        F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("error_kind"), F.col("l_quantity").cast("int").alias("duration_ms"),
        F.concat(F.lit("r"), F.col("l_quantity").cast("int").cast("string")).alias("reason"), F.lit("coll").alias("env"), F.lit(None).cast("date").alias("day"))


@query("call_outcomes", ATT + "SELECT ord, status, CAST(http_status AS INTEGER) AS http_status, duration_ms, reason, attempts FROM oc")
def call_outcomes(spark, sf):
    return B.outcomes(_attempts(spark, sf), ["ord"]).select("ord", "status", "http_status", "duration_ms", "reason", "attempts")


STATUS = """
WITH s AS (SELECT o_orderkey AS ord, 'K'||(o_custkey % 40) AS key, CASE WHEN o_custkey % 3 = 0 THEN 'F'||(o_custkey % 50) END AS fdi,
  CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_call' WHEN 3 THEN 'html_skipped' WHEN 4 THEN 'cancelled' ELSE 'ok' END AS status, o_orderpriority, o_orderkey % 10 = 7 AS exact FROM orders)
"""


def _statuses(spark, sf):
    o = table(spark, sf, "orders")
    m = F.col("o_orderkey") % 6
    status = F.when(m == 1, "failed").when(m == 2, "no_call").when(m == 3, "html_skipped").when(m == 4, "cancelled").otherwise("ok")
    fdi = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("F"), (F.col("o_custkey") % 50).cast("string")))
    return o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("K"), (F.col("o_custkey") % 40).cast("string")).alias("key"), fdi.alias("fdi"),
        status.alias("status"), F.when(fdi.isNotNull(), F.array(fdi)).otherwise(F.array(F.lit("pk"))).alias("folders"),
        F.when(F.col("o_orderkey") % 10 == 7, F.struct(F.col("o_orderkey").alias("seq"))).alias("exact_hit"), "o_orderpriority")


@query("outcome_status_counts", STATUS + """
SELECT o_orderpriority, CAST(count_if(status='ok') AS BIGINT) AS ok, CAST(count_if(status='html_skipped') AS BIGINT) AS html_skipped, CAST(count_if(status='no_call') AS BIGINT) AS no_call,
 CAST(count_if(status='failed') AS BIGINT) AS failed, CAST(count_if(status='cancelled') AS BIGINT) AS cancelled,
 count_if(status='ok')||' generati · '||count_if(status='failed')||' non riusciti · '||count_if(status='no_call')||' senza chiamata · '||count_if(status='html_skipped')||' email saltate · '||count_if(status='cancelled')||' annullati' AS summary
FROM s GROUP BY 1""")
def outcome_status_counts(spark, sf):
    return B.report_summary(B.status_counts(_statuses(spark, sf), ["o_orderpriority"]))


RETRY = STATUS + """
, r AS (SELECT *, CASE WHEN exact THEN 'call' WHEN fdi IS NOT NULL THEN 'fdi' ELSE 'key' END AS kind FROM s WHERE status IN ('failed','no_call','cancelled')),
kf AS (SELECT 'fdi' AS kind, fdi AS value, ord, key FROM (SELECT fdi, key, min(ord) AS ord FROM r WHERE kind = 'fdi' GROUP BY 1, 2)),
tt AS (SELECT 'fdi' AS kind, value, min(ord) AS ord, string_agg(key, '|' ORDER BY ord) AS keys FROM kf GROUP BY value
 UNION ALL SELECT 'key', key, min(ord), '' FROM r WHERE kind = 'key' GROUP BY key
 UNION ALL SELECT 'call', key, ord, '' FROM r WHERE kind = 'call')
"""


@query("retry_targets", RETRY + "SELECT kind, value, ord, keys FROM tt")
def retry_targets(spark, sf):
    return B.retry_targets(_statuses(spark, sf)).select("kind", "value", "ord", F.array_join("keys", "|").alias("keys"))


@query("retry_count", RETRY + "SELECT CAST(sum(CASE WHEN kind = 'fdi' THEN len(string_split(keys, '|')) ELSE 1 END) AS BIGINT) AS n_calls FROM tt")
def retry_count(spark, sf):
    return B.retry_count(B.retry_targets(_statuses(spark, sf)))


@query("outcome_file_rows", STATUS + """
SELECT key AS template_key, coalesce(fdi, 'pk') AS cartella, coalesce(fdi, '') AS fdi,
 CASE status WHEN 'ok' THEN 'ok' WHEN 'html_skipped' THEN 'saltato: HTML' WHEN 'no_call' THEN 'nessuna chiamata nei log' WHEN 'failed' THEN 'non riuscito' ELSE 'annullato' END AS esito,
 CASE WHEN status = 'ok' THEN 'pdf' ELSE '' END AS tipo, '' AS file, '1500' AS durata_ms, '' AS stato_http, 'vedi https://host/p?sig=***' AS motivo, 'coll 05/01/2024' AS payload_da, '2' AS tentativi FROM s""")
def outcome_file_rows(spark, sf):
    from ..sources.outputs import outcome_rows

    s = _statuses(spark, sf).withColumn("doc_type", F.when(F.col("status") == "ok", "pdf")).withColumn("files", F.array().cast("array<string>"))
    s = s.withColumn("duration_ms", F.lit(1500)).withColumn("http_status", F.lit(None).cast("int")).withColumn("reason", F.lit("vedi https://host/p?sv=1&sig=abc%2F"))
    s = s.withColumn("used_env", F.lit("coll")).withColumn("used_day", F.lit("2024-01-05").cast("date")).withColumn("attempts", F.lit(2))
    return outcome_rows(s)


@query("reserved_names", """
SELECT lower('K'||(o_custkey % 40)) AS stem_ci, o_orderkey AS ord,
  'K'||(o_custkey % 40)||CASE WHEN row_number() OVER (PARTITION BY o_custkey % 40, o_orderstatus ORDER BY o_orderkey) = 1 THEN ''
    ELSE '_'||row_number() OVER (PARTITION BY o_custkey % 40, o_orderstatus ORDER BY o_orderkey) END AS name FROM orders""")
def reserved_names(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.array("o_orderstatus").alias("folders"), F.concat(F.lit("K"), (F.col("o_custkey") % 40).cast("string")).alias("key"))
    r = B.reserve_names(o)
    return r.select(F.lower(F.regexp_replace("name", r"_\d+$", "")).alias("stem_ci"), "ord", "name")


# Headers: a customer is a case; the layers come from its segment (profile), nation (initiative) and itself.
HEAD = """
WITH l AS (
 SELECT c_custkey AS case_id, 0 AS layer, 0 AS ord, 'current_timestamp' AS name, '1700000000000' AS value FROM customer
 UNION ALL SELECT c_custkey, 0, 1, 'template_key', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 0, 2, 'correlation_id', 'F'||c_nationkey FROM customer
 UNION ALL SELECT c_custkey, 0, 3, 'Postman-Token', 'tok' FROM customer
 UNION ALL SELECT c_custkey, 1, 0, 'X-Env', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 1, 1, 'Template_Key', 'profile' FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT c_custkey, 2, 0, 'x-env', 'N'||c_nationkey FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 3, 0, 'X-ENV', '' FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT c_custkey, 3, 1, 'postman-token', '' FROM customer WHERE c_custkey % 7 = 0),
w AS (SELECT case_id, lower(name) AS ln, arg_max(name, layer * 10 + ord) AS name, arg_max(value, layer * 10 + ord) AS value, CAST(max(layer) AS INTEGER) AS layer FROM l GROUP BY 1, 2)
SELECT case_id, CASE WHEN ln = 'postman-token' AND value = '' THEN 'Postman-Token' ELSE name END AS name,
 CASE WHEN ln = 'postman-token' AND value = '' THEN 'tok' ELSE value END AS value, layer
FROM w WHERE NOT (ln = 'postman-token' AND case_id % 11 = 0) AND (value <> '' OR ln = 'postman-token')"""


def _layers(spark, sf):
    c = table(spark, sf, "customer")

    def row(layer, ord_, name, value):
        return F.struct(F.lit(layer).alias("layer"), F.lit(ord_).alias("ord"), F.lit(name).alias("name"), value.alias("value"))

    k = F.col("c_custkey")
    rows = F.array_compact(F.array(
        row(1, 0, "X-Env", F.col("c_mktsegment")), F.when(k % 2 == 0, row(1, 1, "Template_Key", F.lit("profile"))),
        F.when(k % 3 == 0, row(2, 0, "x-env", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))),
        F.when(k % 5 == 0, row(3, 0, "X-ENV", F.lit(" "))), F.when(k % 7 == 0, row(3, 1, " postman-token", F.lit("")))))
    return c.select(F.col("c_custkey").alias("case_id"), F.inline(rows))


@query("layered_headers", HEAD)
def layered_headers(spark, sf):
    c = table(spark, sf, "customer")
    cases = c.select(
        F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("key"), F.lit("source").alias("correlation"), F.lit("").alias("correlation_value"),
        F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("source_fdi"), (F.col("c_custkey") % 11 == 0).alias("drop_token"),
        F.lit(1700000000000).alias("now_ms"))
    return B.resolve_headers(_layers(spark, sf), cases, "tok")


@query("header_table", """
WITH p AS (SELECT c_nationkey AS owner, c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'TEMPLATE_KEY' ELSE c_mktsegment END AS name, c_name AS value FROM customer),
q AS (SELECT owner, lower(name) AS ln, arg_max(name, ord) AS name, arg_max(value, ord) AS value FROM p GROUP BY 1, 2),
a AS (SELECT DISTINCT owner, x.name, lower(x.name) AS ln FROM p, (VALUES ('template_key'), ('current_timestamp'), ('correlation_id'), ('Postman-Token')) x(name))
SELECT coalesce(a.owner, q.owner) AS owner, coalesce(q.name, a.name) AS name, coalesce(q.value, '') AS value FROM a FULL JOIN q ON a.owner = q.owner AND a.ln = q.ln""")
def header_table(spark, sf):
    c = table(spark, sf, "customer")
    p = c.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("ord"),
                 F.when(F.col("c_custkey") % 4 == 0, "TEMPLATE_KEY").otherwise(F.col("c_mktsegment")).alias("name"), F.col("c_name").alias("value"))
    return B.header_table(p).select("owner", "name", "value")


@query("headers_of_a_call", """
WITH p AS (SELECT c_nationkey AS owner, lower(CASE WHEN c_custkey % 4 = 0 THEN 'Template_Key' ELSE c_mktsegment END) AS ln, arg_max(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, c_custkey) AS value FROM customer GROUP BY 1, 2)
SELECT n_nationkey AS owner, ln AS name, CASE WHEN ln = 'template_key' THEN n_name ELSE value END AS value FROM nation JOIN p ON p.owner = n_nationkey""")
def headers_of_a_call(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("ord"),
                    F.when(F.col("c_custkey") % 4 == 0, "Template_Key").otherwise(F.col("c_mktsegment")).alias("name"),
                    F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("value"))
    calls = table(spark, sf, "nation").select(F.col("n_nationkey").alias("owner"), F.lit(0).alias("call_ord"), F.col("n_name").alias("key"))
    return B.build_headers(rows, calls, F.lit(1), "tok").select("owner", F.lower("name").alias("name"), "value")


@query("header_row_problems", """
SELECT c_custkey AS ord, CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 5 = 1 THEN 1 WHEN c_custkey % 5 = 2 THEN 2 ELSE 0 END AS INTEGER)
  + CAST(CASE WHEN c_custkey % 5 IN (1, 3) AND c_custkey > min(c_custkey) OVER (PARTITION BY c_nationkey, CASE c_custkey % 5 WHEN 1 THEN 'h' WHEN 3 THEN c_mktsegment WHEN 2 THEN 'b' ELSE 'z'||c_custkey END) THEN 1
   WHEN c_custkey % 5 = 2 AND c_custkey > min(c_custkey) OVER (PARTITION BY c_nationkey, CASE c_custkey % 5 WHEN 1 THEN 'h' WHEN 3 THEN c_mktsegment WHEN 2 THEN 'b' ELSE 'z'||c_custkey END) THEN 1 ELSE 0 END AS INTEGER) AS n FROM customer""")
def header_row_problems(spark, sf):
    c = table(spark, sf, "customer")
    m = F.col("c_custkey") % 5
    name = F.when(m == 0, " ").when(m == 1, "HOST").when(m == 2, "bad name").when(m == 3, F.col("c_mktsegment")).otherwise(F.concat(F.lit("z"), F.col("c_custkey").cast("string")))
    rows = c.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("ord"), name.alias("name"), F.when(m == 2, "a\nb").otherwise("v").alias("value"))
    return B.header_problems(rows).select("ord", F.size("problems").alias("n"))


@query("generator_row_problems", """
SELECT s_suppkey AS ord, CAST((CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)
 + (CASE WHEN s_suppkey > min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 4 = 0) THEN 1 ELSE 0 END) AS INTEGER) AS n FROM supplier""")
def generator_row_problems(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "prod").otherwise("gen"), F.col("s_nationkey").cast("string"))
    rows = s.select(F.col("s_suppkey").alias("ord"), name.alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "http://h/x").otherwise("https://h/x").alias("url"))
    return B.generator_problems(rows).select("ord", F.size("problems").alias("n"))


@query("type_mismatches", """
WITH v AS (SELECT o_custkey AS c, max(CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'pdf' ELSE 'html' END END) AS t,
  max(CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey % 5 < 2 THEN 'pdf' ELSE 'html' END END) AS a FROM orders GROUP BY 1)
SELECT o_orderkey AS ord, coalesce(t, a) AS expected, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'html' END <> coalesce(t, a), false) AS mismatch FROM orders JOIN v ON v.c = o_custkey WHERE o_orderkey % 3 = 2""")
def type_mismatches(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    versions = o.where(k % 3 != 2).select(
        c.alias("case"), F.when(k % 3 == 0, "target").otherwise("asis").alias("kind"),
        F.when(k % 3 == 0, F.when(c % 2 == 0, "pdf").otherwise("html")).otherwise(F.when(c % 5 < 2, "pdf").otherwise("html")).alias("doc_type"))
    made = o.where(k % 3 == 2).select(k.alias("ord"), c.alias("case"), F.lit("tobe").alias("kind"), F.when(k % 2 == 0, "pdf").otherwise("html").alias("doc_type"))
    return B.type_mismatch(versions, made).select("ord", "expected", "mismatch")


@query("case_plan_results", """
WITH i AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS rep, o_custkey % 300 AS k, o_orderpriority AS v FROM orders),
f AS (SELECT k, v, min(ord) AS first FROM i WHERE rep IS NULL GROUP BY 1, 2)
SELECT i.ord, CASE WHEN rep IS NOT NULL THEN CASE WHEN c.c_custkey IS NULL THEN 'failed' WHEN i.ord % 2 = 0 THEN 'unchanged' ELSE 'replaced' END
 WHEN i.ord > f.first OR i.k IN (SELECT c_custkey % 300 FROM customer WHERE c_custkey % 300 < 20 AND c_mktsegment = 'MACHINERY') AND i.v = '5-LOW' THEN 'failed' ELSE 'added' END AS result
FROM i LEFT JOIN customer c ON c.c_custkey = rep LEFT JOIN f ON f.k = i.k AND f.v = i.v AND rep IS NULL""")
def case_plan_results(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")
    items = o.select(
        k.alias("ord"), F.when(k % 3 == 0, F.col("o_custkey")).alias("replace"), (F.col("o_custkey") % 300).cast("string").alias("key"),
        F.col("o_orderpriority").alias("variant"), F.lit("f").alias("fdi"), F.when(k % 2 == 0, "same").otherwise("new").alias("payload_sha"))
    seg = (F.col("c_custkey") % 300 < 20) & (F.col("c_mktsegment") == "MACHINERY")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.when(seg, (F.col("c_custkey") % 300).cast("string")).otherwise("-").alias("key"),
                     F.lit("5-low").alias("variant"), F.lit("f").alias("source_fdi"), F.lit("same").alias("payload_sha"))
    return B.plan_cases(items, cases).select("ord", "result")


@query("free_variants", """
SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_nationkey % 3 = 0 THEN 'base-abcdef12' WHEN c_nationkey % 3 = 1 THEN 'base-abcdef12-2' ELSE 'base-abcdef12-3' END AS chosen FROM customer""")
def free_variants(spark, sf):
    c = table(spark, sf, "customer")
    wanted = c.select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("case_key"), F.lit("abcdef12-9999").alias("fdi"),
                      F.when(F.col("c_custkey") % 4 == 0, " new").otherwise("base").alias("variant"))
    n = table(spark, sf, "nation")
    m = F.col("n_nationkey") % 3
    names = F.when(m == 0, F.array(F.lit("Base"))).when(m == 1, F.array(F.lit("base"), F.lit("base-abcdef12"))).otherwise(
        F.array(F.lit("base"), F.lit("base-abcdef12"), F.lit("BASE-abcdef12-2"), F.lit("base-abcdef12-4")))
    return B.free_variants(wanted, n.select(F.col("n_nationkey").alias("case_key"), F.explode(names).alias("variant")))
