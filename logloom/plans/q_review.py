"""Verdict, review-state and report queries over difference tables derived from ``lineitem``.

An order is a case and a line a difference: class, type, zone, texts, tolerances and marks are
functions of the line's columns, so both engines build the same review.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import review as V
from .registry import dealt, query, table

BASE = """
WITH ln AS (SELECT l_orderkey AS c, l_linenumber AS ln, max(l_partkey) AS pk, max(l_suppkey) AS sk, CAST(max(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2),
base AS (SELECT *, CASE pk % 8 WHEN 0 THEN 'variabile' WHEN 1 THEN 'rumore' WHEN 2 THEN 'arredo' WHEN 3 THEN 'stile' WHEN 4 THEN 'zona' ELSE 'testo' END AS klass0,
  CASE pk % 5 WHEN 0 THEN 'maiuscole' WHEN 1 THEN 'punteggiatura' WHEN 2 THEN 'numeri' ELSE 'parola' END AS tipo,
  CASE sk % 6 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'numero_pagina' ELSE 'corpo' END AS zone,
  'T'||ln AS left_text, 'g'||(q % 4) AS tg, 'g'||(CASE WHEN q % 3 = 0 THEN q % 4 ELSE (q + 1) % 4 END) AS ag,
  CAST(sk % 3 AS INTEGER) AS page FROM ln),
cs AS (SELECT DISTINCT c, CASE c % 3 WHEN 0 THEN 'tollerante' WHEN 1 THEN 'stretto' ELSE 'solo_testo' END AS profile,
  c % 4 <> 0 AS has_asis, c % 23 <> 0 AS tt, c % 17 <> 0 AS att, c % 5 = 0 AS silent FROM ln),
b AS (SELECT base.*, CASE WHEN klass0 = 'variabile' AND pk % 16 = 0 THEN 'testo' ELSE klass0 END AS klass, profile, tt, has_asis AND att AS three, silent FROM base JOIN cs ON cs.c = base.c),
f AS (SELECT *, CASE profile WHEN 'tollerante' THEN klass IN ('testo','composizione','link','zona') WHEN 'stretto' THEN klass IN ('testo','composizione','link','stile','spaziatura','zona') ELSE klass IN ('testo','zona') END AS cnt,
  klass IN ('variabile','rumore','arredo') AS nov, silent AND tipo = 'maiuscole' AS sil, q % 11 = 0 AS tol, q % 5 <> 0 AS in_t, three AND q % 7 <> 0 AS in_a FROM b WHERE tt),
v1 AS (SELECT *, CASE WHEN nov THEN NULL WHEN NOT cnt OR sil OR tol THEN 'tollerata' WHEN NOT three THEN 'da_fare' WHEN NOT in_a THEN 'regressione' WHEN ag = tg THEN 'da_fare' ELSE 'in_corso' END AS v0 FROM f WHERE in_t),
v2 AS (SELECT *, coalesce(v0 IN ('da_fare','in_corso','regressione'), false) AS op0, q % 6 = 0 AS hasmark, 1 + q % 4 AS mv, CASE WHEN q % 12 = 0 THEN 'g'||(q % 4) ELSE 'gX' END AS mg FROM v1),
v3 AS (SELECT *, hasmark AND mv < 3 AND op0 AND mg = tg AS stuck, hasmark AND mv < 3 AND op0 AND mg <> tg AS changed,
  q % 13 = 0 AND (pk % 3 = 0 OR pk % 3 = 1) AS rem FROM v2),
jt AS (SELECT c, ln, klass, tipo, zone, left_text, tg AS right_text, page, 0 AS part, CASE WHEN changed THEN 'in_corso' ELSE v0 END AS verdict,
  op0 AND hasmark AND mv >= 3 AS marked, op0 AND (stuck OR rem) AS unresolved,
  CASE WHEN nov OR NOT cnt THEN '' WHEN sil THEN 'Tollera tutte: solo maiuscole' WHEN tol THEN 'ok' ELSE '' END AS tolerated_note,
  CASE WHEN changed THEN mg WHEN v0 = 'in_corso' THEN ag ELSE '' END AS previous_text FROM v3),
ja AS (SELECT c, ln, klass, tipo, zone, left_text, ag AS right_text, page, 1 AS part, 'fatta' AS verdict, false AS marked, false AS unresolved, '' AS tolerated_note, '' AS previous_text
  FROM f WHERE in_a AND NOT in_t AND cnt AND NOT sil),
j AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, page, ln) AS id FROM (SELECT * FROM jt UNION ALL SELECT * FROM ja)),
st AS (SELECT *, CASE WHEN verdict IS NULL THEN klass WHEN marked AND verdict IN ('da_fare','in_corso','regressione') THEN 'da_verificare'
  WHEN unresolved AND verdict IN ('da_fare','in_corso') THEN 'non_risolta' ELSE verdict END AS state FROM j),
sm AS (SELECT cs.c, count_if(coalesce(verdict='fatta', false)) AS fatte, count_if(coalesce(verdict='da_fare', false)) AS da_fare, count_if(coalesce(verdict='in_corso', false)) AS in_corso, count_if(coalesce(verdict='regressione', false)) AS regressioni,
  count_if(coalesce(marked, false)) AS da_verificare, count_if(coalesce(unresolved, false)) AS non_risolte, count_if(coalesce(verdict='tollerata', false)) AS tollerate, count_if(coalesce(klass='variabile', false)) AS variabili,
  count_if(coalesce(klass='rumore', false)) AS rumore, count_if(coalesce(klass='arredo', false)) AS arredo, any_value(tt) AS tt, any_value(NOT (has_asis AND att)) AS two_way
  FROM cs LEFT JOIN j ON j.c = cs.c GROUP BY cs.c)
"""


#: For each part the reader makes: its lines are short, and become a review of many columns.
PARTS = 32


def _lines(spark, sf):
    # Lines are dealt by order once: all that follows goes by case, so nothing wider is shuffled. Parts do not merge, as a review takes many times their room.
    ln = dealt(spark, sf, "lineitem", "l_orderkey", PARTS).groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("pos")).agg(
        F.max("l_partkey").alias("pk"), F.max("l_suppkey").alias("sk"), F.max("l_quantity").cast("int").alias("q"))
    pk, sk, q = F.col("pk"), F.col("sk"), F.col("q")
    g = lambda n: F.concat(F.lit("g"), n.cast("string"))
    d = ln.select(
        "*",
        F.when(pk % 8 == 0, "variabile").when(pk % 8 == 1, "rumore").when(pk % 8 == 2, "arredo").when(pk % 8 == 3, "stile")
        .when(pk % 8 == 4, "zona").otherwise("testo").alias("klass"),
        F.when(pk % 5 == 0, "maiuscole").when(pk % 5 == 1, "punteggiatura").when(pk % 5 == 2, "numeri").otherwise("parola").alias("tipo"),
        F.when(sk % 6 == 0, "header").when(sk % 6 == 1, "footer").when(sk % 6 == 2, "numero_pagina").otherwise("corpo").alias("zone"),
        F.lit("cambiato").alias("op"), F.concat(F.lit("T"), F.col("pos").cast("string")).alias("left_text"),
        g(q % 4).alias("tg"), g(F.when(q % 3 == 0, q % 4).otherwise((q + 1) % 4)).alias("ag"), (sk % 3).cast("int").alias("page"),
        F.col("pos").cast("string").alias("context"))
    return V.with_anchor_id(d.withColumn("target_text", F.col("left_text")))


def _review(spark, sf):
    d = _lines(spark, sf)
    q, pk, c = F.col("q"), F.col("pk"), F.col("case")
    tobe = d.where(q % 5 != 0).withColumn("right_text", F.col("tg")).withColumn("generated", F.col("tg"))
    asis = d.where(q % 7 != 0).withColumn("right_text", F.col("ag")).withColumn("generated", F.col("ag"))
    cases = d.select("case").distinct().select(
        "case", F.lit(3).alias("version"), F.when(c % 3 == 0, "tollerante").when(c % 3 == 1, "stretto").otherwise("solo_testo").alias("profile"),
        (c % 4 != 0).alias("has_asis"), (c % 23 != 0).alias("tobe_has_text"), (c % 17 != 0).alias("asis_has_text"),
        F.when(c % 5 == 0, F.array(F.lit("maiuscole"))).otherwise(F.array().cast("array<string>")).alias("tolerated_tipi"))
    tol = d.where(q % 11 == 0).select("case", "anchor_id", F.col("tg").alias("generated"), F.lit("ok").alias("note"), F.col("pos").alias("ord"))
    marks = d.where(q % 6 == 0).select(
        "case", "anchor_id", F.when(q % 12 == 0, F.col("tg")).otherwise("gX").alias("generated"), (1 + q % 4).alias("version"), (1 + pk % 2).alias("engine"))
    nv = d.where(pk % 16 == 0).select("case", "anchor_id")
    unres = d.where(q % 13 == 0).select(
        "case", "anchor_id", F.lit(1).alias("version"), F.when(pk % 3 == 0, "").when(pk % 3 == 1, F.col("tg")).otherwise("gZ").alias("generated"))
    return tobe, asis, cases, tol, marks, nv, unres


def _judge(spark, sf):
    return V.judge(*_review(spark, sf))


@query("three_way_verdicts", BASE + """
SELECT c AS "case", id, CAST(ln AS INTEGER) AS pos, klass, verdict, marked, unresolved, tolerated_note, previous_text FROM j""")
def three_way_verdicts(spark, sf):
    return V.number(_judge(spark, sf)["judged"]).select(
        "case", "id", "pos", "klass", "verdict", "marked", "unresolved", "tolerated_note", "previous_text")


@query("done_differences", BASE + 'SELECT c AS "case", CAST(ln AS INTEGER) AS pos FROM ja')
def done_differences(spark, sf):
    return _judge(spark, sf)["judged"].where(F.col("verdict") == "fatta").select("case", "pos")


@query("mark_verification", BASE + """
, mk AS (SELECT f.c, f.q % 5 <> 0 AS here, 1 + f.pk % 2 AS engine, v3.op0, v3.stuck, v3.changed FROM f LEFT JOIN v3 ON v3.c = f.c AND v3.ln = f.ln WHERE f.q % 6 = 0 AND 1 + f.q % 4 < 3),
ft AS (SELECT c, CASE WHEN NOT here THEN CASE WHEN engine < 2 THEN 'dormant' ELSE 'resolved' END WHEN NOT op0 THEN 'dormant' WHEN stuck THEN 'unresolved' ELSE 'changed' END AS fate FROM mk)
SELECT c AS "case", count(*) AS checked, CAST(count_if(fate='resolved') AS BIGINT) AS resolved, CAST(count_if(fate='unresolved') AS BIGINT) AS unresolved, CAST(count_if(fate='changed') AS BIGINT) AS changed
FROM ft WHERE fate <> 'dormant' GROUP BY c""")
def mark_verification(spark, sf):
    return _judge(spark, sf)["verification"].drop("version")


@query("verification_outcomes", BASE + """
, mk AS (SELECT f.c, f.q % 5 <> 0 AS here, 1 + f.pk % 2 AS engine, v3.op0, v3.stuck, v3.changed FROM f LEFT JOIN v3 ON v3.c = f.c AND v3.ln = f.ln WHERE f.q % 6 = 0 AND 1 + f.q % 4 < 3),
ft AS (SELECT c, CASE WHEN NOT here THEN CASE WHEN engine < 2 THEN 'dormant' ELSE 'resolved' END WHEN NOT op0 THEN 'dormant' WHEN stuck THEN 'unresolved' ELSE 'changed' END AS fate FROM mk)
SELECT c AS "case", CASE WHEN count_if(fate IN ('unresolved','changed')) > 0 THEN 'warn' ELSE 'ok' END AS tone,
 concat_ws(',', CASE WHEN count_if(fate='resolved') > 0 THEN 'resolved='||count_if(fate='resolved') END, CASE WHEN count_if(fate='unresolved') > 0 THEN 'unresolved='||count_if(fate='unresolved') END,
  CASE WHEN count_if(fate='changed') > 0 THEN 'changed='||count_if(fate='changed') END) AS parts FROM ft WHERE fate <> 'dormant' GROUP BY c""")
def verification_outcomes(spark, sf):
    v = R.outcome_parts(_judge(spark, sf)["verification"])
    return v.select("case", "tone", F.array_join("parts", ",").alias("parts"))


@query("still_unresolved", BASE + 'SELECT c AS "case", CAST(ln AS INTEGER) AS pos FROM v3 WHERE stuck OR rem')
def still_unresolved(spark, sf):
    u = _judge(spark, sf)["unresolved"].select("case", "anchor_id").distinct()
    return u.join(_lines(spark, sf).select("case", "anchor_id", "pos"), ["case", "anchor_id"]).select("case", "pos")


@query("case_summaries", BASE + """
SELECT c AS "case", CAST(fatte AS BIGINT) AS fatte, CAST(da_fare AS BIGINT) AS da_fare, CAST(in_corso AS BIGINT) AS in_corso, CAST(regressioni AS BIGINT) AS regressioni, CAST(da_verificare AS BIGINT) AS da_verificare,
 CAST(non_risolte AS BIGINT) AS non_risolte, CAST(tollerate AS BIGINT) AS tollerate, CAST(variabili AS BIGINT) AS variabili, CAST(rumore AS BIGINT) AS rumore, CAST(arredo AS BIGINT) AS arredo,
 round(CASE WHEN NOT tt THEN 0.0 WHEN fatte + da_fare + in_corso + regressioni = 0 THEN 1.0 ELSE fatte / (fatte + da_fare + in_corso + regressioni) END, 6) AS avanzamento, two_way FROM sm""")
def case_summaries(spark, sf):
    return _judge(spark, sf)["summary"].drop("version").withColumn("avanzamento", F.round("avanzamento", 6))


@query("inactive_review_entries", BASE + """
, t AS (SELECT base.c FROM base LEFT JOIN j ON j.c = base.c AND j.ln = base.ln AND j.right_text = base.tg WHERE base.q % 11 = 0 AND j.c IS NULL),
n AS (SELECT base.c FROM base LEFT JOIN j ON j.c = base.c AND j.ln = base.ln WHERE base.pk % 16 = 0 AND j.c IS NULL),
m AS (SELECT base.c FROM base LEFT JOIN j ON j.c = base.c AND j.ln = base.ln AND j.marked WHERE base.q % 6 = 0 AND j.c IS NULL)
SELECT c AS "case", CAST(sum(k = 1) AS BIGINT) AS tolerances, CAST(sum(k = 2) AS BIGINT) AS not_variables, CAST(sum(k = 3) AS BIGINT) AS marks, count(*) AS inactive
FROM (SELECT c, 1 AS k FROM t UNION ALL SELECT c, 2 FROM n UNION ALL SELECT c, 3 FROM m) GROUP BY c""".replace("sum(k = 1)", "count_if(k = 1)").replace("sum(k = 2)", "count_if(k = 2)").replace("sum(k = 3)", "count_if(k = 3)"))
def inactive_review_entries(spark, sf):
    _, _, _, tol, marks, nv, _ = _review(spark, sf)
    return V.inactive(_judge(spark, sf)["judged"], tol, nv, marks)


@query("repeated_anchors", """
WITH d AS (SELECT l_orderkey AS c, CAST(l_linenumber AS INTEGER) AS page, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS pos,
  CASE WHEN l_partkey % 3 = 0 THEN 'a #2' ELSE 'a' END AS ctx FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY c, ctx ORDER BY page, pos) AS k, bool_or(ctx = 'a #2') OVER (PARTITION BY c) AS has2 FROM d)
SELECT c AS "case", page, pos, CASE WHEN k = 1 THEN ctx ELSE ctx||' #'||(k + CASE WHEN ctx = 'a' AND has2 THEN 1 ELSE 0 END) END AS context FROM k""")
def repeated_anchors(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    d = li.select(
        F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("page"), F.row_number().over(w).cast("bigint").alias("pos"), F.lit("cambiato").alias("op"),
        F.lit("testo").alias("klass"), F.when(F.col("l_partkey") % 3 == 0, "a #2").otherwise("a").alias("context"), F.lit("t").alias("target_text"))
    return V.unique_anchors(d, ["case"]).select("case", "page", "pos", "context")


@query("counting_differences", BASE + """
SELECT c AS pair_id, CAST(count_if(klass0 IN ('testo','composizione','link','zona')) AS BIGINT) AS n_counting, count_if(klass0 IN ('testo','composizione','link','zona')) = 0 AND any_value(c % 23 <> 0) AS equal FROM base GROUP BY c""")
def counting_differences(spark, sf):
    d = _lines(spark, sf).withColumnRenamed("case", "pair_id")
    comps = d.select("pair_id").distinct().select("pair_id", (F.col("pair_id") % 23 != 0).alias("left_has_text"), F.lit(True).alias("right_has_text"))
    return V.equal_for(d, comps).select("pair_id", F.col("n_counting").cast("bigint").alias("n_counting"), "equal")


# ---------------------------------------------------------- review actions ---
# A conversation is a case, a turn an action on one of three anchors.

ACT = """
WITH e AS (SELECT conv_id AS c, turn AS seq, 'a'||(length(text) % 3) AS a, turn AS version, 'n'||turn AS note,
  CASE (length(text) + turn) % 9 WHEN 0 THEN 'tolerate' WHEN 1 THEN 'mark_done' WHEN 2 THEN 'untolerate' WHEN 3 THEN 'tolerate' WHEN 4 THEN 'not_variable' WHEN 5 THEN 'mark_done' WHEN 6 THEN 'unmark' WHEN 7 THEN 'variable_again'
   ELSE CASE turn % 3 WHEN 0 THEN 'unmark_all' WHEN 1 THEN 'reset_tolerances' ELSE 'target_replaced' END END AS action FROM conversations),
k AS (SELECT *, CASE WHEN action IN ('tolerate','untolerate') THEN 'tolerance' WHEN action IN ('mark_done','unmark') THEN 'mark' WHEN action IN ('not_variable','variable_again') THEN 'not_variable' END AS kind,
  action IN ('tolerate','mark_done','not_variable') AS is_set FROM e)
"""


def _events(spark, sf):
    c = table(spark, sf, "conversations")
    m = (F.length("text") + F.col("turn")) % 9
    reset = F.when(F.col("turn") % 3 == 0, "unmark_all").when(F.col("turn") % 3 == 1, "reset_tolerances").otherwise("target_replaced")
    action = (
        F.when(m == 0, "tolerate").when(m == 1, "mark_done").when(m == 2, "untolerate").when(m == 3, "tolerate").when(m == 4, "not_variable")
        .when(m == 5, "mark_done").when(m == 6, "unmark").when(m == 7, "variable_again").otherwise(reset))
    return c.select(
        F.col("conv_id").alias("case"), F.col("turn").alias("seq"), action.alias("action"),
        F.concat(F.lit("a"), (F.length("text") % 3).cast("string")).alias("anchor_id"), F.col("turn").alias("version"),
        F.concat(F.lit("n"), F.col("turn").cast("string")).alias("note"))


@query("review_state", ACT + """
, r AS (SELECT c, 'mark' AS kind, max(seq) AS s FROM e WHERE action IN ('unmark_all','target_replaced') GROUP BY c UNION ALL SELECT c, x, max(seq) FROM e, (VALUES ('tolerance'), ('not_variable')) t(x) WHERE action = 'reset_tolerances' GROUP BY 1, 2),
a AS (SELECT k.* FROM k LEFT JOIN r ON r.c = k.c AND r.kind = k.kind WHERE k.kind IS NOT NULL AND (r.s IS NULL OR k.seq > r.s)),
l AS (SELECT c, kind, a, arg_max(is_set, seq) AS alive, max(CASE WHEN NOT is_set THEN seq END) AS un FROM a GROUP BY 1, 2, 3)
SELECT l.c AS "case", l.kind, l.a AS anchor_id, CASE WHEN l.kind = 'not_variable' THEN min(a.seq) ELSE max(a.seq) END AS seq
FROM l JOIN a ON a.c = l.c AND a.kind = l.kind AND a.a = l.a AND a.is_set AND (l.un IS NULL OR a.seq > l.un) WHERE l.alive GROUP BY 1, 2, 3""")
def review_state(spark, sf):
    return V.review_state(_events(spark, sf)).select("case", "kind", "anchor_id", "seq")


@query("undo_steps", ACT + """
, p AS (SELECT *, lag(action) OVER w AS pa, lag(note) OVER w AS pn FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY c, kind, a ORDER BY seq)),
u AS (SELECT *, coalesce(pa IN ('tolerate','mark_done','not_variable'), false) AS was FROM p),
w AS (SELECT *, CASE action WHEN 'tolerate' THEN CASE WHEN was THEN 'tolerate' ELSE 'untolerate' END WHEN 'untolerate' THEN 'tolerate' WHEN 'mark_done' THEN CASE WHEN was THEN 'mark_done' ELSE 'unmark' END WHEN 'unmark' THEN 'mark_done'
  WHEN 'not_variable' THEN CASE WHEN was THEN 'none' ELSE 'variable_again' END ELSE 'not_variable' END AS undo FROM u)
SELECT c AS "case", seq, undo, CASE WHEN undo IN ('tolerate','mark_done','not_variable') THEN pn END AS undo_note FROM w""")
def undo_steps(spark, sf):
    return V.undo_steps(_events(spark, sf)).select("case", "seq", "undo", "undo_note")


@query("saved_comparisons", """
WITH r AS (SELECT conv_id AS c, turn AS version, length(text) AS n FROM conversations)
SELECT c AS "case", max(version) AS version, arg_max(n, version) AS n FROM r GROUP BY c""")
def saved_comparisons(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case"), F.col("turn").alias("version"), F.length("text").cast("bigint").alias("n"))
    found = c.select("case", F.col("n").cast("string").alias("anchor_id"), "version", F.lit("g").alias("generated"))
    return V.save_compared(c, found)[0]


# ------------------------------------------------------------ filter panel ---
# Users are cases, their region an initiative; choices come from customers.

CHOICE = """
WITH rules AS (SELECT n_name AS name, n_nationkey AS ord, n_nationkey % 2 = 0 AS enabled FROM nation),
fr AS (SELECT * FROM (VALUES ('zona.header', false, true), ('zona.titolo', false, true), ('zona.footer', false, true), ('zona.spalla_sx', false, true), ('zona.spalla_dx', false, true), ('zona.numero_pagina', true, true),
  ('zona.filigrana', true, true), ('zona.invisibile', true, false), ('variabile.segnaposto', true, true), ('variabile.buco', true, true), ('variabile.cella', true, true), ('variabile.sezione', true, true), ('variabile.esecuzione', true, true),
  ('variabile.listino', true, true), ('decidere.maiuscole', false, true), ('decidere.punteggiatura', false, true)) t(filter_id, built_in, sw) UNION ALL SELECT 'avanzate.'||name, enabled, true FROM rules),
fid AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'zona.header' WHEN 1 THEN 'decidere.maiuscole' WHEN 2 THEN 'variabile.buco' ELSE 'avanzate.NATION_'||(c_custkey % 25) END AS filter_id, c_custkey % 3 = 0 AS "on" FROM customer),
cc AS (SELECT c_custkey AS c, 'i'||c_nationkey AS ini FROM customer)
"""


def _rules(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("ord"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))


def _fid():
    k = F.col("c_custkey")
    return F.when(k % 4 == 0, "zona.header").when(k % 4 == 1, "decidere.maiuscole").when(k % 4 == 2, "variabile.buco").otherwise(
        F.concat(F.lit("avanzate.NATION_"), (k % 25).cast("string")))


def _choices(spark, sf):
    c = table(spark, sf, "customer")
    own = c.where(F.col("c_custkey") % 5 == 0).select(
        F.lit("case").alias("level"), F.col("c_custkey").cast("string").alias("owner"), _fid().alias("filter_id"), (F.col("c_custkey") % 3 == 0).alias("on"))
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    ini = first.select(F.lit("initiative").alias("level"), F.concat(F.lit("i"), F.col("c_nationkey").cast("string")).alias("owner"), _fid().alias("filter_id"),
                       (F.col("c_custkey") % 3 == 0).alias("on"))
    return own.unionByName(ini)


@query("filter_switches", CHOICE + """
, ini AS (SELECT 'i'||c_nationkey AS ini, arg_min(filter_id, c_custkey) AS filter_id, arg_min("on", c_custkey) AS v FROM fid GROUP BY 1)
SELECT CAST(cc.c AS VARCHAR) AS "case", fr.filter_id, CASE WHEN NOT sw THEN true ELSE coalesce(ini.v, built_in) END AS default_on,
 CASE WHEN NOT sw THEN true ELSE coalesce(o."on", ini.v, built_in) END AS active
FROM cc CROSS JOIN fr LEFT JOIN ini ON ini.ini = cc.ini AND ini.filter_id = fr.filter_id
LEFT JOIN fid o ON o.c_custkey = cc.c AND o.filter_id = fr.filter_id AND o.c_custkey % 5 = 0""")
def filter_switches(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case"), F.concat(F.lit("i"), F.col("c_nationkey").cast("string")).alias("initiative"))
    return V.switches(V.filter_rows(_rules(spark, sf)), cases, _choices(spark, sf)).select("case", "filter_id", "default_on", "active")


@query("applied_choices", """
WITH ch AS (SELECT c_nationkey AS owner, c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN 'zona.header' WHEN 1 THEN 'decidere.maiuscole' WHEN 2 THEN 'zona.invisibile' WHEN 3 THEN 'boh' ELSE 'avanzate.'||c_mktsegment END AS filter_id,
 CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v FROM customer)
SELECT owner, filter_id, max(seq) AS seq, arg_max(CAST(coalesce(CAST(v AS INTEGER), 2) AS INTEGER), seq) = 1 AS "on" FROM ch WHERE filter_id NOT IN ('boh', 'zona.invisibile')
GROUP BY 1, 2 HAVING arg_max(coalesce(CAST(v AS INTEGER), 2), seq) < 2""")
def applied_choices(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    fid = F.when(k % 5 == 0, "zona.header").when(k % 5 == 1, "decidere.maiuscole").when(k % 5 == 2, "zona.invisibile").when(k % 5 == 3, "boh").otherwise(
        F.concat(F.lit("avanzate."), "c_mktsegment"))
    log = c.select(F.col("c_nationkey").alias("owner"), k.alias("seq"), fid.alias("filter_id"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("on"))
    return V.apply_choices(log)[0]


@query("pruned_choices", """
SELECT c_custkey AS owner, CASE c_custkey % 3 WHEN 0 THEN 'zona.header' WHEN 1 THEN 'avanzate.NATION_'||(c_custkey % 30) ELSE 'avanzate.Numero di pagina nel testo' END AS filter_id
FROM customer WHERE NOT (c_custkey % 3 = 1 AND c_custkey % 30 >= 25)""")
def pruned_choices(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    ch = c.select(k.alias("owner"), F.when(k % 3 == 0, "zona.header").when(k % 3 == 1, F.concat(F.lit("avanzate.NATION_"), (k % 30).cast("string")))
                  .otherwise("avanzate.Numero di pagina").alias("filter_id"))
    names = _rules(spark, sf).select("name").unionByName(spark.createDataFrame([("Numero di pagina nel testo",)], "name string"))
    return V.prune_choices(ch, names)


@query("legacy_preset_choices", """
SELECT c_custkey AS owner, 'avanzate.'||CASE WHEN c_custkey % 2 = 0 THEN 'Numero di pagina nel testo' ELSE c_mktsegment END AS filter_id, true AS "on" FROM customer WHERE c_custkey % 7 <> 0""")
def legacy_preset_choices(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return V.legacy_choices(c.select(k.alias("owner"), F.when(k % 7 == 0, " ").when(k % 2 == 0, " Numero di pagina ").otherwise(F.col("c_mktsegment")).alias("name")))


RULES = """
WITH r AS (SELECT c_nationkey AS ini, c_mktsegment||(c_custkey % 4) AS name, c_custkey % 3 AS level, c_custkey AS ord FROM customer)
"""


def _rule_log(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(F.col("c_nationkey").alias("ini"), F.concat("c_mktsegment", (k % 4).cast("string")).alias("name"), (k % 3).alias("level"), k.alias("ord"))


@query("rules_in_force", RULES + "SELECT ini, name, min(level) AS level, arg_min(ord, level * 1000000000 + ord) AS ord FROM r GROUP BY 1, 2")
def rules_in_force(spark, sf):
    return V.rule_rows(_rule_log(spark, sf), ["ini"])[0]


@query("rule_name_clashes", RULES + """
SELECT ini, name, level, ord FROM (SELECT *, row_number() OVER (PARTITION BY ini, name ORDER BY level, ord) AS rn FROM r) WHERE rn > 1""")
def rule_name_clashes(spark, sf):
    return V.rule_rows(_rule_log(spark, sf), ["ini"])[1].select("ini", "name", "level", "ord")


# --------------------------------------------------------- case status views ---
# A customer is a case, its orders are document versions.

VERS = """
WITH v AS (SELECT o_custkey AS c, CASE o_orderkey % 5 WHEN 0 THEN 'target' WHEN 1 THEN 'asis' ELSE 'tobe' END AS kind, o_orderkey AS number, o_orderdate AS created FROM orders),
acc AS (SELECT c, max(created) AS accepted_at FROM v WHERE number % 7 = 0 GROUP BY c)
"""


def _versions(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("case"), F.when(k % 5 == 0, "target").when(k % 5 == 1, "asis").otherwise("tobe").alias("kind"),
                    k.alias("number"), F.col("o_orderdate").alias("created"), F.lit(False).alias("missing"))


@query("acceptance", VERS + """
, a AS (SELECT v.c, max(CASE WHEN kind='tobe' AND created <= accepted_at THEN number END) AS accepted_version, max(CASE WHEN kind='tobe' THEN number END) AS latest_version, bool_or(created > accepted_at) AS reopened
 FROM v JOIN acc ON acc.c = v.c WHERE kind IN ('tobe','asis') GROUP BY v.c)
SELECT c AS "case", accepted_version, latest_version, reopened, NOT reopened AND accepted_version IS NOT DISTINCT FROM latest_version AS current FROM a""")
def acceptance(spark, sf):
    v = _versions(spark, sf)
    acc = v.where(F.col("number") % 7 == 0).select("case", F.col("created").alias("at"))
    return V.acceptance(acc, v).drop("accepted_at")


@query("asis_older_than_call", VERS + """
, r AS (SELECT c, max(created) AS att FROM v WHERE number % 11 = 0 GROUP BY c), a AS (SELECT c, max(created) AS created FROM v WHERE kind = 'asis' GROUP BY c)
SELECT a.c AS "case", coalesce(r.att > a.created, false) AS asis_predates_call FROM a LEFT JOIN r ON r.c = a.c""")
def asis_older_than_call(spark, sf):
    v = _versions(spark, sf)
    hist = v.where(F.col("number") % 11 == 0).select("case", F.lit("call_replaced").alias("kind"), F.col("created").alias("at"))
    return V.asis_predates_call(hist, v)


@query("tobe_reads_as_asis", BASE + """
, t AS (SELECT c, ln, klass0, tg FROM base WHERE klass0 IN ('testo','zona') AND q % 5 <> 0), a AS (SELECT c, ln, klass0, CASE WHEN c % 2 = 0 THEN tg ELSE ag END AS tg FROM base WHERE klass0 IN ('testo','zona') AND q % 5 <> 0),
n AS (SELECT coalesce(t.c, a.c) AS c, bool_and(t.c IS NOT NULL AND a.c IS NOT NULL) AS same FROM t FULL JOIN a ON t.c = a.c AND t.ln = a.ln AND t.klass0 = a.klass0 AND t.tg = a.tg GROUP BY 1)
SELECT cs.c AS "case", coalesce(n.same, false) AND cs.c % 9 <> 0 AS same_as_asis FROM cs LEFT JOIN n ON n.c = cs.c""")
def tobe_reads_as_asis(spark, sf):
    d = _lines(spark, sf).where(F.col("q") % 5 != 0)
    tobe = d.withColumn("right_text", F.col("tg"))
    asis = d.withColumn("right_text", F.when(F.col("case") % 2 == 0, F.col("tg")).otherwise(F.col("ag")))
    pages = _lines(spark, sf).select("case").distinct().select(
        "case", F.lit(2).alias("tobe_pages"), F.when(F.col("case") % 9 == 0, 3).otherwise(2).alias("asis_pages"), F.lit(True).alias("all_have_text"))
    return V.same_as_asis(tobe, asis, pages)


@query("followed_differences", BASE + """
SELECT c AS "case", CAST(ln AS BIGINT) AS follow_id, CAST(ln + CASE WHEN ln % 2 = 0 THEN 100 ELSE 0 END AS INTEGER) AS now_id,
  CAST(CASE WHEN ln % 2 = 1 THEN 1 WHEN pk % 3 <> 0 THEN 2 ELSE 3 END AS INTEGER) AS rule FROM base""")
def followed_differences(spark, sf):
    d = _lines(spark, sf)
    f = d.select("case", F.col("pos").alias("id"), F.col("pos").cast("bigint").alias("follow_id"), "op", "klass", "context", "target_text")
    rows = d.select("case", (F.col("pos") + F.when(F.col("pos") % 2 == 0, 100).otherwise(0)).alias("id"), "op",
                    F.when(F.col("pk") % 3 == 0, F.lit("composizione")).otherwise(F.col("klass")).alias("klass"), "context", "target_text")
    return V.follow(f, rows)


@query("live_marks", BASE + """
, m AS (SELECT c, count(*) AS n FROM base WHERE q % 6 = 0 GROUP BY c)
SELECT sm.c AS "case", CAST(least(coalesce(m.n, 0), sm.da_verificare) AS BIGINT) AS live_marks FROM sm LEFT JOIN m ON m.c = sm.c""")
def live_marks(spark, sf):
    r = _review(spark, sf)
    return V.live_marks(r[4], _judge(spark, sf)["summary"], r[2])


# ----------------------------------------------------------------- reports ---

@query("filter_panel", BASE + """
, z AS (SELECT c, 'zona.'||zone AS filter_id FROM base WHERE zone <> 'corpo' AND klass0 NOT IN ('variabile','rumore','link') UNION ALL SELECT c, 'decidere.'||tipo FROM base WHERE tipo IN ('maiuscole','punteggiatura') AND klass0 NOT IN ('variabile','rumore','arredo')
  UNION ALL SELECT c, 'variabile.buco' FROM base WHERE klass0 = 'variabile'),
n AS (SELECT c, filter_id, count(*) AS n FROM z GROUP BY 1, 2),
fr AS (SELECT * FROM (VALUES ('zona.header', false), ('zona.titolo', false), ('zona.footer', false), ('zona.spalla_sx', false), ('zona.spalla_dx', false), ('zona.numero_pagina', true),
  ('zona.filigrana', true), ('zona.invisibile', true), ('variabile.segnaposto', true), ('variabile.buco', true), ('variabile.cella', true), ('variabile.sezione', true), ('variabile.esecuzione', true),
  ('variabile.listino', true), ('decidere.maiuscole', false), ('decidere.punteggiatura', false)) t(filter_id, active))
SELECT cs.c AS "case", fr.filter_id, fr.active, coalesce(n.n, 0) AS n FROM cs CROSS JOIN fr LEFT JOIN n ON n.c = cs.c AND n.filter_id = fr.filter_id""")
def filter_panel(spark, sf):
    d, sw = _panel(spark, sf)
    return R.filter_panel(R.filter_found(d), sw).select("case", "filter_id", "active", "n")


def _panel(spark, sf):
    d = _lines(spark, sf).withColumn("right_text", F.col("tg")).withColumn("prova", F.when(F.col("klass") == "variabile", "buco").otherwise(""))
    cases = d.select("case").distinct().withColumn("initiative", F.lit("i"))
    none = spark.createDataFrame([], "name string, ord bigint, enabled boolean")
    choices = spark.createDataFrame([], "level string, owner string, filter_id string, on boolean")
    return d, V.switches(V.filter_rows(none), cases.withColumn("case", F.col("case").cast("string")), choices).withColumn("case", F.col("case").cast("bigint"))


@query("occurrences_set_aside", BASE + """
SELECT cs.c AS "case", CAST(count_if(base.zone = 'numero_pagina' AND klass0 NOT IN ('variabile','rumore','link')) + count_if(klass0 = 'variabile') AS BIGINT) AS filtered FROM cs JOIN base ON base.c = cs.c GROUP BY 1""")
def occurrences_set_aside(spark, sf):
    d, sw = _panel(spark, sf)
    return R.filtered_count(R.filter_panel(R.filter_found(d), sw))


@query("display_states", BASE + 'SELECT c AS "case", CAST(ln AS INTEGER) AS pos, state, coalesce(unresolved AND NOT marked AND verdict IN (\'da_fare\',\'in_corso\',\'regressione\'), false) AS flagged FROM st')
def display_states(spark, sf):
    return _judge(spark, sf)["judged"].select("case", "pos", R.state_of().alias("state"), R.flagged().alias("flagged"))


@query("tab_counts", BASE + """
, t AS (SELECT c, CASE WHEN state IN ('non_risolta','regressione','da_fare','in_corso') THEN 'guardare' WHEN state = 'da_verificare' THEN 'verificare' WHEN state = 'fatta' THEN 'fatte' WHEN state = 'tollerata' THEN 'tollerate' WHEN state = 'variabile' THEN 'variabili' ELSE 'tutte' END AS tab FROM st)
SELECT c AS "case", CAST(count_if(tab='guardare') AS BIGINT) AS guardare, CAST(count_if(tab='verificare') AS BIGINT) AS verificare, CAST(count_if(tab='fatte') AS BIGINT) AS fatte,
 CAST(count_if(tab='tollerate') AS BIGINT) AS tollerate, CAST(count_if(tab='variabili') AS BIGINT) AS variabili, count(*) AS tutte FROM t GROUP BY c""")
def tab_counts(spark, sf):
    return R.tab_counts(_judge(spark, sf)["judged"])


@query("tab_rows", BASE + """
SELECT c AS "case", CAST(ln AS INTEGER) AS pos, state FROM st WHERE state IN ('non_risolta','regressione','da_fare','in_corso','da_verificare')""")
def tab_rows(spark, sf):
    j = _judge(spark, sf)["judged"].withColumn("y0", F.lit(0.0)).withColumn("x0", F.col("pos").cast("double")).withColumn("id", F.col("pos"))
    return R.tab_rows(j, "guardare").select("case", "pos", "state")


@query("type_counts", BASE + """
SELECT c AS "case", CAST(count_if(klass <> 'arredo' AND tipo='maiuscole') AS BIGINT) AS maiuscole, CAST(count_if(klass <> 'arredo' AND tipo='punteggiatura') AS BIGINT) AS punteggiatura, CAST(0 AS BIGINT) AS spazi,
 CAST(count_if(klass <> 'arredo' AND tipo='numeri') AS BIGINT) AS numeri, CAST(count_if(klass <> 'arredo' AND tipo='parola') AS BIGINT) AS parola, CAST(0 AS BIGINT) AS frase, CAST(0 AS BIGINT) AS sezione, CAST(0 AS BIGINT) AS spostamento,
 CAST(0 AS BIGINT) AS zona, CAST(0 AS BIGINT) AS link, CAST(0 AS BIGINT) AS altro FROM j GROUP BY c""")
def type_counts(spark, sf):
    return R.type_counts(_judge(spark, sf)["judged"])


@query("type_groups", BASE + """
SELECT c AS "case", CASE WHEN klass = 'arredo' THEN 'arredo' ELSE tipo END AS type_group, count(*) AS n,
 CAST(CASE WHEN klass = 'arredo' THEN 11 WHEN tipo = 'maiuscole' THEN 0 WHEN tipo = 'punteggiatura' THEN 1 WHEN tipo = 'numeri' THEN 3 ELSE 4 END AS INTEGER) AS group_no FROM j GROUP BY 1, 2, 4""")
def type_groups(spark, sf):
    return R.type_groups(_judge(spark, sf)["judged"])


@query("zones_summary", BASE + """
, z AS (SELECT DISTINCT c, zone FROM j WHERE zone <> 'corpo' UNION SELECT c, 'titolo' FROM cs)
SELECT z.c AS "case", z.zone, CAST(count_if(coalesce(st.state IN ('non_risolta','regressione','da_fare','in_corso'), false)) AS BIGINT) AS n_open,
 z.zone = 'numero_pagina' AND NOT coalesce(bool_or(st.klass <> 'arredo'), false) AS ignored FROM z LEFT JOIN st ON st.c = z.c AND st.zone = z.zone GROUP BY 1, 2""")
def zones_summary(spark, sf):
    boxes = _lines(spark, sf).select("case").distinct().withColumn("zone", F.lit("titolo"))
    return R.zones_summary(_judge(spark, sf)["judged"], boxes)


BOARD = BASE + """
, m1 AS (SELECT *, least(da_verificare, in_corso) AS t1 FROM sm), m2 AS (SELECT *, least(da_verificare - t1, da_fare) AS t2 FROM m1), m3 AS (SELECT *, least(da_verificare - t1 - t2, regressioni) AS t3 FROM m2),
bd AS (SELECT c, CAST(regressioni - t3 AS BIGINT) AS regressione, CAST(non_risolte AS BIGINT) AS non_risolta, CAST(da_fare - t2 AS BIGINT) AS da_fare, CAST(in_corso - t1 AS BIGINT) AS in_corso, CAST(da_verificare AS BIGINT) AS da_verificare, CAST(fatte AS BIGINT) AS fatta FROM m3)
"""


@query("board_counts", BOARD + """
SELECT c AS "case", *EXCLUDE (c), CASE WHEN regressione > 0 THEN 'regressione' WHEN non_risolta > 0 THEN 'non_risolta' WHEN da_fare > 0 THEN 'da_fare' WHEN in_corso > 0 THEN 'in_corso' WHEN da_verificare > 0 THEN 'da_verificare' WHEN fatta > 0 THEN 'fatta' ELSE '' END AS worst FROM bd""")
def board_counts(spark, sf):
    return R.board_counts(_judge(spark, sf)["summary"]).drop("version", "tollerata", "variabile", "rumore", "arredo")


@query("board_rollup", BOARD + """
SELECT 'i'||(c % 7) AS initiative, c AS "case", CAST(sum(regressione) AS BIGINT) AS regressione, CAST(sum(da_fare) AS BIGINT) AS da_fare, CAST(sum(in_corso) AS BIGINT) AS in_corso, CAST(sum(fatta) AS BIGINT) AS fatta
FROM bd GROUP BY ROLLUP ('i'||(c % 7), c)""")
def board_rollup(spark, sf):
    b = R.board_counts(_judge(spark, sf)["summary"]).withColumn("initiative", F.concat(F.lit("i"), (F.col("case") % 7).cast("string")))
    return R.board_rollup(b)


@query("pill_counts", BASE + """
SELECT c AS "case", CAST(count_if(state = 'da_verificare') AS BIGINT) AS da_verificare, CAST(count_if(coalesce(state <> 'da_verificare' AND verdict = 'da_fare', false)) AS BIGINT) AS da_fare, CAST(count_if(coalesce(state <> 'da_verificare' AND verdict = 'in_corso', false)) AS BIGINT) AS in_corso,
 CAST(count_if(unresolved) AS BIGINT) AS non_risolta, CAST(count_if(state = 'variabile') AS BIGINT) AS variabile FROM st GROUP BY c""")
def pill_counts(spark, sf):
    return R.pill_counts(_judge(spark, sf)["judged"]).select("case", "da_verificare", "da_fare", "in_corso", "non_risolta", "variabile")


@query("state_counts", BASE + """
SELECT c AS "case", CAST(count_if(state='regressione') AS BIGINT) AS regressione, CAST(count_if(state='non_risolta') AS BIGINT) AS non_risolta, CAST(count_if(state='da_fare') AS BIGINT) AS da_fare, CAST(count_if(state='rumore') AS BIGINT) AS rumore FROM st GROUP BY c""")
def state_counts(spark, sf):
    return R.state_counts(_judge(spark, sf)["judged"]).select("case", "regressione", "non_risolta", "da_fare", "rumore")


@query("progress_percent", BASE + """
SELECT c AS "case", CAST(CASE WHEN NOT tt THEN 0 WHEN fatte + da_fare + in_corso + regressioni = 0 THEN 100 WHEN fatte = fatte + da_fare + in_corso + regressioni THEN 100 ELSE floor(100.0 * fatte / (fatte + da_fare + in_corso + regressioni) + 1e-9) END AS INTEGER) AS percent FROM sm""")
def progress_percent(spark, sf):
    return _judge(spark, sf)["summary"].select("case", R.percent(F.col("avanzamento")).alias("percent"))


@query("remaining_work", BOARD + """
SELECT c AS "case", concat_ws(', ', CASE WHEN regressione = 1 THEN '1 regressione' WHEN regressione > 1 THEN regressione||' regressioni' END, CASE WHEN non_risolta = 1 THEN '1 non risolta' WHEN non_risolta > 1 THEN non_risolta||' non risolte' END,
 CASE WHEN da_fare > 0 THEN da_fare||' da fare' END, CASE WHEN in_corso > 0 THEN in_corso||' in corso' END, CASE WHEN da_verificare > 0 THEN da_verificare||' da verificare' END) AS remaining FROM bd""")
def remaining_work(spark, sf):
    return R.remaining_text(R.board_counts(_judge(spark, sf)["summary"])).select("case", "remaining")


@query("minimap_segments", BASE + """
, s AS (SELECT c, CAST(ln AS INTEGER) AS id, page, state FROM st WHERE state <> 'fatta')
SELECT c AS "case", id, page, round((page * 842.0 + 10.0 * id) / (3 * 842.0), 6) AS top, round((page * 842.0 + 10.0 * id + 8) / (3 * 842.0), 6) AS bottom FROM s""")
def minimap_segments(spark, sf):
    j = _judge(spark, sf)["judged"].withColumn("id", F.col("pos"))
    words = j.select("case", "id", F.lit("left").alias("side"), "page", (F.col("id") * 10.0).alias("y0"), (F.col("id") * 10.0 + 8).alias("y1"))
    sizes = _lines(spark, sf).select("case").distinct().select("case", F.lit("left").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("page"), F.lit(842.0).alias("height"))
    m = R.minimap(words, j, sizes)
    return m.select("case", "id", "page", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("difference_lines", BASE + """
SELECT c AS "case", CAST(ln AS INTEGER) AS pos, 'pag. '||(page + 1)||' · cambiato'||CASE WHEN klass <> 'testo' THEN ' · '||klass ELSE '' END AS where_line,
 CASE WHEN klass = 'stile' THEN '«'||left_text||'»' ELSE '«'||left_text||'» → «'||right_text||'»' END AS what_line FROM j""")
def difference_lines(spark, sf):
    j = _judge(spark, sf)["judged"].withColumn("detail", F.lit(""))
    return R.difference_lines(j).select("case", "pos", "where_line", "what_line")


@query("difference_snippets", BASE + """
SELECT c AS "case", CAST(ln AS INTEGER) AS pos, '… b c d e ['||left_text||'→'||right_text||'] f' AS snippet FROM j""")
def difference_snippets(spark, sf):
    s = R.snippet(F.lit("a b c d e"), F.col("left_text"), F.col("right_text"), F.lit("f"))
    return _judge(spark, sf)["judged"].select("case", "pos", s.alias("snippet"))


@query("invisible_text_lines", """
WITH w AS (SELECT o_custkey AS c, CAST(o_orderkey % 2 AS INTEGER) AS page, o_orderkey AS pos, floor(o_orderkey / 700) * 20.0 + 10 AS y1 FROM orders)
SELECT c AS "case", page, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS text FROM w GROUP BY c, page, y1""")
def invisible_text_lines(spark, sf):
    o = table(spark, sf, "orders")
    y1 = F.floor(F.col("o_orderkey") / 700) * 20.0 + 10
    w = o.select(F.col("o_custkey").alias("case"), F.lit("left").alias("side"), (F.col("o_orderkey") % 2).cast("int").alias("page"), F.col("o_orderkey").alias("pos"),
                 F.col("o_orderkey").cast("string").alias("text"), (y1 - 10).alias("y0"), y1.alias("y1"))
    return R.invisible_lines(w).select("case", "page", "text")


@query("sliding_rate", """
SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS window_bytes FROM events""")
def sliding_rate(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("run"), "ts", F.col("event_id").alias("bytes"))
    return R.sliding_rate(e, seconds=300).select("event_id", "window_bytes")


@query("run_progress", """
WITH e AS (SELECT user_id AS run, CASE event_type WHEN 'click' THEN 'RemoteIndexRead' WHEN 'view' THEN 'FileDone' ELSE 'FileStarted' END AS type, event_id AS size FROM events)
SELECT run, CAST(coalesce(sum(CASE WHEN type='RemoteIndexRead' THEN size END),0) AS BIGINT) AS bytes_total, CAST(coalesce(sum(CASE WHEN type='FileDone' THEN size END),0) AS BIGINT) AS bytes_done,
 CAST(count_if(type = 'FileStarted') AS BIGINT) AS file_index FROM e GROUP BY run""")
def run_progress(spark, sf):
    t = F.when(F.col("event_type") == "click", "RemoteIndexRead").when(F.col("event_type") == "view", "FileDone").otherwise("FileStarted")
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), t.alias("type"), F.col("event_id").alias("size"), "ts")
    return R.progress(e).select("run", "bytes_total", "bytes_done", "file_index")


@query("initiative_board", """
WITH c AS (SELECT 'i'||c_nationkey AS initiative, CASE WHEN c_nationkey % 3 = 0 THEN 'Same' ELSE 'Name'||c_nationkey END AS name, c_custkey, c_mktsegment FROM customer),
v AS (SELECT o_custkey, max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END) AS gen, max(o_orderdate) AS act FROM orders GROUP BY 1)
SELECT initiative, name, max(gen) AS latest_generated, max(act) AS last_activity, CAST(count_if(c_mktsegment = 'BUILDING') AS BIGINT) AS accepted, count(*) AS n_cases,
 CASE WHEN name = 'Same' THEN 'Same ('||initiative||')' ELSE name END AS label FROM c LEFT JOIN v ON v.o_custkey = c.c_custkey GROUP BY 1, 2""")
def initiative_board(spark, sf):
    c = table(spark, sf, "customer")
    n = F.col("c_nationkey")
    cases = c.select(F.concat(F.lit("i"), n.cast("string")).alias("initiative"), F.when(n % 3 == 0, "Same").otherwise(F.concat(F.lit("Name"), n.cast("string"))).alias("name"),
                     F.col("c_custkey").alias("case"), F.when(F.col("c_mktsegment") == "BUILDING", "accepted").otherwise("open").alias("status"))
    return R.initiative_board(cases, _versions(spark, sf))


@query("last_runs", """
WITH r AS (SELECT user_id AS job, ts, event_id, event_id % 4 AS exit_code, event_id % 7 = 0 AS skipped FROM events)
SELECT job, max(ts) AS ts, arg_max(CASE WHEN skipped THEN 'saltata' WHEN exit_code = 3 THEN 'annullata' WHEN exit_code = 2 OR event_id % 5 = 0 THEN 'con avvisi' ELSE 'completata' END, ts) AS outcome FROM r GROUP BY job""")
def last_runs(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    r = e.select(F.col("user_id").alias("job"), "ts", (i % 4).alias("exit_code"), (i % 7 == 0).alias("skipped"), (i % 5 == 0).cast("int").alias("n_failed"), F.lit(0).alias("n_unreachable"))
    return R.last_run(r, ["job"]).select("job", "ts", "outcome")


@query("human_formats", """
SELECT event_id, CASE WHEN value < 1 THEN '' ELSE '' END || CAST(CAST(floor(event_id) AS BIGINT) AS VARCHAR)||' B' AS size FROM events WHERE event_id < 1024
UNION ALL SELECT event_id, replace(replace(printf('%.1f', event_id / 1024.0), '.', ','), ',0', ',0')||' KB' FROM events WHERE event_id >= 1024 AND printf('%.1f', event_id / 1024.0) NOT LIKE '%.0'
UNION ALL SELECT event_id, replace(printf('%.1f', event_id / 1024.0), '.0', '')||' KB' FROM events WHERE event_id >= 1024 AND printf('%.1f', event_id / 1024.0) LIKE '%.0'""")
def human_formats(spark, sf):
    from ..functions.text import human_size

    return table(spark, sf, "events").select("event_id", human_size("event_id").alias("size"))
