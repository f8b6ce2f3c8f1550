"""Payload, HTML, word-geometry, layout, version and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import layout as L
from ..operators import marks as M
from ..operators import payload as P
from ..operators import variables as Va
from ..sources import html as H
from ..sources import versions as V
from ..sources import words as Wd
from ..streaming import streams as T
from .registry import dealt, query, table

# ------------------------------------------------------------------ payload ---


def _payloads(spark, sf):
    e = table(spark, sf, "events")
    p = F.concat(
        F.lit('{"dossier":{"id":"D'), F.col("user_id").cast("string"), F.lit('","amount":'), F.col("value").cast("string"),
        F.lit(',"day":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('T00:00:00Z","ok":true},"items":[{"template":{"x":"hidden text"}},"'),
        F.col("event_type"), F.lit('"]}'))
    return e.select("event_id", "event_type", "value", "ts", "user_id", p.alias("payload"))


LEAVES = """
SELECT event_id, 'dossier.id' AS path, 'D'||user_id AS value FROM events UNION ALL SELECT event_id, 'dossier.day', strftime(ts,'%Y-%m-%d')||'T00:00:00Z' FROM events
UNION ALL SELECT event_id, 'dossier.ok', 'true' FROM events UNION ALL SELECT event_id, 'items[0].template.x', 'hidden text' FROM events UNION ALL SELECT event_id, 'items[1]', event_type FROM events"""


@query("payload_leaves", LEAVES)
def payload_leaves(spark, sf):
    f = P.leaves(_payloads(spark, sf).select("event_id", "payload"))
    return f.where(F.col("path") != "dossier.amount").select("event_id", "path", "value")


@query("deep_payload_leaves", """
SELECT event_id, 'a.a.a.a.a.a.a.a.a.a[0][0].b' AS path, 'D'||user_id AS value FROM events
UNION ALL SELECT event_id, 'a.a.a.a.a.a.a.a.a.a[1]', event_type FROM events UNION ALL SELECT event_id, 'x', '{["}' FROM events""")
def deep_payload_leaves(spark, sf):
    """Payloads thirteen levels deep, with brackets inside strings."""
    e = table(spark, sf, "events")
    inner = F.concat(F.lit('[[{"b":"D'), F.col("user_id").cast("string"), F.lit('"}],"'), F.col("event_type"), F.lit('"]'))
    body = F.concat(F.lit('{"x":"{[\\"}","a":' + '{"a":' * 9), inner, F.lit("}" * 10))
    return P.leaves(e.select("event_id", body.alias("payload"))).select("event_id", "path", "value")


@query("payload_index", """
SELECT event_id, 'D'||user_id AS printed, 'dossier.id' AS path FROM events WHERE length('D'||user_id) >= 4 UNION ALL SELECT event_id, strftime(ts,'%d/%m/%Y'), 'dossier.day' FROM events
UNION ALL SELECT event_id, event_type, 'items[1]' FROM events WHERE length(event_type) >= 4""")
def payload_index(spark, sf):
    f = P.leaves(_payloads(spark, sf).select("event_id", "payload"))
    return P.payload_index(f, ["event_id"]).where(F.col("printed").isNotNull()).select("event_id", "printed", "path")


@query("payload_first_key", "SELECT event_id, 'K'||user_id AS key FROM events")
def payload_first_key(spark, sf):
    from ..sources.outputs import payload_key

    body = F.concat(F.lit('{"documents":[{"template":{"templateKey":"K'), F.col("user_id").cast("string"), F.lit('"}},{"template":{"templateKey":"Z"}}]}'))
    return table(spark, sf, "events").select("event_id", payload_key(body).alias("key"))


@query("value_dictionary", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment||': '||c_name ELSE c_mktsegment||': Prezzo' END AS name, count(*) AS n FROM customer GROUP BY 1""")
def value_dictionary(spark, sf):
    c = table(spark, sf, "customer")
    head = c.select(F.col("c_mktsegment").alias("sheet")).distinct().select("sheet", F.lit(-1).cast("bigint").alias("row"), F.lit(2).alias("col"), F.lit("text").alias("kind"), F.lit("Prezzo").alias("value"))
    lab = c.where(F.col("c_custkey") % 2 == 0).select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.col("c_name").alias("value"))
    num = c.select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("row"), F.lit(2).alias("col"), F.lit("number").alias("kind"), F.col("c_acctbal").cast("string").alias("value"))
    d = P.dictionary(head.unionByName(lab).unionByName(num))
    return d.where(F.col("number").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))


def _values(spark, sf):
    li = table(spark, sf, "part")
    v = F.translate(F.format_number("p_retailprice", 1), ",.", ".,")
    values = li.select(F.col("p_size").alias("case"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("("), v, F.lit(")"))).alias("value"))
    index = li.where(F.col("p_partkey") % 3 == 0).groupBy(F.col("p_size").alias("case"), F.col("p_name").alias("printed")).agg(F.lit("d.name").alias("path")).withColumn(
        "number", F.lit(None).cast("decimal(38,18)"))
    entries = spark.createDataFrame([("listino: a", 900.1)], "name string, n double").select("name", F.col("n").cast("decimal(38,18)").alias("number"), F.lit(None).cast("string").alias("text_lc"))
    return P.lookup(values, index, entries, ["case"])


@query("value_proofs", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'd.name' WHEN round(p_retailprice, 1) = 900.1 THEN 'listino: a' ELSE '' END AS found_name,
 CASE WHEN p_partkey % 3 = 0 THEN 'payload' WHEN round(p_retailprice, 1) = 900.1 THEN 'listino' END AS proof FROM part""")
def value_proofs(spark, sf):
    return _values(spark, sf).select("p_partkey", "found_name", "proof")


@query("structural_keys", """
SELECT p_partkey, p_partkey % 4 < 2 AS structural FROM part""")
def structural_keys(spark, sf):
    m = F.col("p_partkey") % 4
    k = F.when(m == 0, "attributeOrder").when(m == 1, "tipoOfferta").when(m == 2, "customerName").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", P.structural(k).alias("structural"))


@query("visible_leaves", "SELECT event_id, 'items[1]' AS path FROM events WHERE event_id % 2 = 0")
def visible_leaves(spark, sf):
    p = _payloads(spark, sf)
    docs = p.select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tipo "), "event_type", F.lit(" fine"))).otherwise("altro").alias("text"),
                    F.array().cast("array<decimal(38,18)>").alias("numbers"))
    return P.visible_leaves(P.leaves(p.select("event_id", "payload")), docs, ["event_id"]).select("event_id", "path")


@query("perturbed_values", "SELECT p_partkey, length(p_name) AS n, true AS same_shape, true AS changed FROM part")
def perturbed_values(spark, sf):
    new = P.perturbed(F.col("p_name"), F.col("p_partkey"))
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[0-9]", "9")
    return table(spark, sf, "part").withColumn("new", new).select(
        "p_partkey", F.length("new").cast("bigint").alias("n"), (shape(F.col("new")) == shape(F.col("p_name"))).alias("same_shape"), (F.col("new") != F.col("p_name")).alias("changed"))


@query("leaf_subsets", """
WITH r AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT c AS "case", CAST(0 AS INTEGER) AS level, CAST(0 AS INTEGER) AS part, count(*) AS n FROM r GROUP BY 1
UNION ALL SELECT c, CAST(1 AS INTEGER), CAST(CASE WHEN i < (n + 1) // 2 THEN 0 ELSE 1 END AS INTEGER), count(*) FROM r WHERE n > 1 GROUP BY 1, 3""")
def leaf_subsets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("ord"))
    return P.leaf_subsets(o, ["case"], levels=2).groupBy("case", "level", "part").agg(F.count("*").alias("n"))


@query("leaf_subsets_to_single_leaves", """
WITH RECURSIVE o AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT c, 0 AS lo, n AS hi, 0 AS level, 0 AS part FROM o
  UNION ALL SELECT c, CASE s WHEN 0 THEN lo ELSE lo + (hi - lo + 1) // 2 END, CASE s WHEN 0 THEN lo + (hi - lo + 1) // 2 ELSE hi END, level + 1, 2 * part + s
  FROM t, (SELECT unnest([0, 1]) AS s) WHERE hi - lo > 1)
SELECT c AS "case", CAST(level AS INTEGER) AS level, CAST(part AS INTEGER) AS part, CAST(hi - lo AS BIGINT) AS n FROM t""")
def leaf_subsets_to_single_leaves(spark, sf):
    """Every customer's orders, split until single."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("ord"))
    return P.leaf_subsets(o, ["case"]).groupBy("case", "level", "part").agg(F.count("*").alias("n"))


@query("structure_changes", """
SELECT o_custkey AS pair_id, bool_or(o_orderkey % 7 = 0) OR o_custkey % 5 = 0 AS structure_changed FROM orders GROUP BY o_custkey""")
def structure_changes(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("pair_id"), F.when(F.col("o_orderkey") % 7 == 0, "sezione_assente").otherwise("cambiato").alias("op"))
    c = d.select("pair_id").distinct().select("pair_id", F.lit(2).alias("left_pages"), F.when(F.col("pair_id") % 5 == 0, 3).otherwise(2).alias("right_pages"))
    return P.structure_changed(d, c)


@query("control_keys", "SELECT p_partkey, sha256(p_name||'{\"a\":1,\"b\":'||p_partkey||'}') AS sha FROM part")
def control_keys(spark, sf):
    from ..sources.outputs import canonical_json, control_sha

    raw = F.concat(F.lit('{"b": '), F.col("p_partkey").cast("string"), F.lit(', "a": 1}'))
    return table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("c"), canonical_json(raw).alias("j")).select(
        "p_partkey", control_sha(F.col("c"), F.col("j")).alias("sha"))


@query("pretty_bodies", """
SELECT event_id, '{' || chr(10) || '    "k": ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || chr(10) || '}' || chr(10) AS pretty FROM events""")
def pretty_bodies(spark, sf):
    from ..sources.outputs import pretty_json

    return table(spark, sf, "events").select("event_id", pretty_json(F.encode("props", "UTF-8")).alias("pretty"))


def _doc_words(spark, sf):
    d = table(spark, sf, "benchmark")
    return d.select(F.col("item_id").alias("pair_id"), F.posexplode(F.split("text", r"\s+")).alias("pos", "key")).where(F.col("key") != "")


@query("proven_long_values", r"""
WITH w AS (SELECT item_id AS pair_id, string_split_regex(text, '\s+') AS ws FROM benchmark),
p AS (SELECT pair_id, ws, unnest(generate_series(1, len(ws) - 13)) AS i FROM w WHERE len(ws) > 16)
SELECT pair_id, CAST(i - 1 AS INTEGER) AS start, CAST(14 AS INTEGER) AS n FROM p WHERE ws[i:i+13] = ws[3:16]""")
def proven_long_values(spark, sf):
    """Values of fourteen tokens."""
    t = table(spark, sf, "benchmark").withColumn("ws", F.split("text", r"\s+")).where(F.size("ws") > 16)
    v = t.select(F.col("item_id").alias("pair_id"), F.array_join(F.slice("ws", 3, 14), " ").alias("value"))
    return P.proven_words(v, _doc_words(spark, sf)).select("pair_id", "start", "n")


@query("proven_words", r"""
WITH w AS (SELECT item_id AS pair_id, string_split_regex(text, '\s+') AS ws FROM benchmark),
p AS (SELECT pair_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w)
SELECT pair_id, CAST(i - 1 AS INTEGER) AS start, CAST(2 AS INTEGER) AS n FROM p WHERE ws[i] = ws[3] AND ws[i+1] = ws[4] AND len(ws) > 4""")
def proven_words(spark, sf):
    w = _doc_words(spark, sf)
    t = table(spark, sf, "benchmark").withColumn("ws", F.split("text", r"\s+")).where(F.size("ws") > 4)
    v = t.select(F.col("item_id").alias("pair_id"), F.concat_ws(" ", F.get("ws", F.lit(2)), F.get("ws", F.lit(3))).alias("value"))
    return P.proven_words(v, w).select("pair_id", "start", "n")


# --------------------------------------------------------------------- html ---


@query("html_blocks")
def html_blocks(spark, sf):
    return H.html_blocks(table(spark, sf, "pages")).select("page_id", "id", "dom_path", "text", F.size("attrs").alias("n_attrs"))


@query("html_links", """
SELECT page_id, len(regexp_extract_all(html, '<a href="')) AS n FROM pages WHERE len(regexp_extract_all(html, '<a href="')) > 0""")
def html_links(spark, sf):
    a = H.block_attrs(H.html_blocks(table(spark, sf, "pages")))
    return a.where(F.col("name") == "href").groupBy("page_id").agg(F.count("*").alias("n"))


@query("link_differences", """
WITH a AS (SELECT page_id, list_slice(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1, 1) AS f FROM pages)
SELECT page_id AS pair_id, 'href' AS name, f[1] AS old, f[1]||'?x' AS new FROM a WHERE len(f) > 0""")
def link_differences(spark, sf):
    from ..operators.diff import link_changes

    a = H.block_attrs(H.html_blocks(table(spark, sf, "pages"))).where(F.col("name") == "href")
    first = a.groupBy("page_id").agg(F.min_by(F.struct("id", "ord", "name", "value"), F.struct("id", "ord")).alias("f")).select("page_id", "f.*")
    both = first.select(F.col("page_id").alias("pair_id"), F.lit("L").alias("side"), F.col("id").alias("block"), "ord", "name", "value")
    right = both.withColumn("side", F.lit("R")).withColumn("value", F.concat("value", F.lit("?x")))
    pairs = both.select("pair_id", F.col("block").alias("l"), F.col("block").alias("r"))
    return link_changes(pairs, both.unionByName(right)).select("pair_id", "name", "old", "new")


# Every link: those of even length get another query, the others only a tracking parameter, which is no difference.
@query("all_link_differences", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS v FROM pages)
SELECT page_id AS pair_id, 'href' AS name, v AS old, v||'?x=1' AS new FROM a WHERE length(v) % 2 = 0""")
def all_link_differences(spark, sf):
    """All links of all blocks, compared in the normal form of URLs."""
    from ..functions.text import url_norm
    from ..operators.diff import link_changes

    a = H.block_attrs(H.html_blocks(table(spark, sf, "pages"))).where(F.col("name") == "href")
    left = a.select(F.col("page_id").alias("pair_id"), F.lit("L").alias("side"), F.col("id").alias("block"), "ord", "name", "value")
    edited = F.concat("value", F.when(F.length("value") % 2 == 0, "?x=1").otherwise("?utm_source=z"))
    right = left.withColumn("side", F.lit("R")).withColumn("value", edited)
    both = left.unionByName(right).withColumn("value", url_norm(F.col("value")))
    pairs = left.select("pair_id", F.col("block").alias("l"), F.col("block").alias("r")).distinct()
    return link_changes(pairs, both).select("pair_id", "name", "old", "new")


@query("document_types", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' END AS doc_type FROM pages")
def document_types(spark, sf):
    m = F.col("page_id") % 3
    c = F.when(m == 0, F.encode("html", "UTF-8")).when(m == 1, F.encode(F.concat(F.lit("﻿%PDF-1.4 "), "url"), "UTF-8")).otherwise(F.encode(F.lit("{}"), "UTF-8"))
    return table(spark, sf, "pages").select("page_id", H.sniff(c).alias("doc_type"))


@query("decoded_documents", "SELECT page_id, length(html) AS n FROM pages")
def decoded_documents(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(H.decoded(F.encode("html", "UTF-8"))).cast("bigint").alias("n"))


@query("sanitised_pages", "SELECT page_id, false AS has_script, len(regexp_extract_all(html, '<p>')) AS n_p FROM pages")
def sanitised_pages(spark, sf):
    s = H.sanitise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", s.alias("h")).select(
        "page_id", F.lower("h").contains("<script").alias("has_script"), F.regexp_count("h", F.lit("<p>")).cast("bigint").alias("n_p"))


# ----------------------------------------------------------- positioned words ---
# A document is laid out on pages of 40 lines: its lines down the page, its tokens along them.


def _words(spark, sf):
    d = dealt(spark, sf, "documents", "doc_id")
    ln = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "t"))
    w = ln.select("doc", "n", F.posexplode(F.filter(F.split("t", r"\s+"), lambda x: x != "")).alias("k", "text"))
    size = F.when(F.col("n") == 0, 20.0).otherwise(10.0)
    w = w.withColumn("size", size).withColumn("page", F.floor(F.col("n") / 40).cast("int")).withColumn(
        "y0", F.when(F.col("n") == 0, 30.0).otherwise(60.0 + (F.col("n") % 40) * 18.0))
    o = Window.partitionBy("doc", "n").orderBy("k")
    width = 0.5 * F.col("size") * F.length("text")
    w = w.withColumn("x1", 40.0 + F.sum(width + 0.3 * F.col("size")).over(o) - 0.3 * F.col("size")).withColumn("x0", F.col("x1") - width)
    return w.withColumn("y1", F.col("y0") + 1.15 * F.col("size")).withColumn("pos", F.col("n") * 100000 + F.col("k")).withColumn(
        "bold", F.lit(False)).withColumn("angle", F.lit(0)).withColumn("light", F.lit(False))


def _pages_of(words):
    return words.groupBy("doc", "page").agg(F.lit(10000000.0).alias("width"), F.lit(842.0).alias("height"))


LINE_COUNT = r"""
WITH l AS (SELECT doc_id AS doc, unnest(generate_series(0, len(p) - 1)) AS n, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
k AS (SELECT doc, n // 40 AS page, n, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS w FROM l)
"""


@query("page_lines", LINE_COUNT + "SELECT doc, CAST(page AS INTEGER) AS page, count(*) AS n_lines, CAST(sum(w) AS BIGINT) AS n_words FROM k WHERE w > 0 GROUP BY 1, 2")
def page_lines(spark, sf):
    t = Wd.line_table(_words(spark, sf))
    return t.groupBy("doc", "page").agg(F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"))


@query("words_from_characters", r"""
SELECT item_id AS doc, count(*) AS n FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY 1""")
def words_from_characters(spark, sf):
    b = table(spark, sf, "benchmark")
    c = b.select(F.col("item_id").alias("doc"), F.posexplode(F.split("text", "")).alias("i", "c"))
    x = F.col("i") * 5.0
    c = c.select("doc", F.lit(0).alias("page"), "i", "c", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 5.0).alias("x1"), F.lit(11.5).alias("y1"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    return Wd.chars_to_words(c).groupBy("doc").agg(F.count("*").alias("n"))


@query("reading_order", LINE_COUNT + "SELECT doc, CAST(page AS INTEGER) AS page, CAST(sum(w) AS INTEGER) AS last_pos FROM k WHERE w > 0 GROUP BY 1, 2")
def reading_order(spark, sf):
    w = _words(spark, sf)
    r = Wd.reading_order(w, _pages_of(w))
    return r.groupBy("doc", "page").agg(F.max("pos").alias("last_pos"))


@query("scanned_documents", LINE_COUNT + """
, p AS (SELECT doc, page, sum(w) AS n FROM k GROUP BY 1, 2), m AS (SELECT doc, max(n) AS most FROM p GROUP BY 1)
SELECT doc, NOT (most < 5 AND doc % 2 = 0) AS has_text FROM m""")
def scanned_documents(spark, sf):
    w = _words(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    return Wd.has_text(w, docs.where(F.col("doc") % 2 == 0), docs)


@query("paragraph_blocks")
def paragraph_blocks(spark, sf):
    w = _words(spark, sf)
    b = Wd.blocks(Wd.line_table(w), Wd.char_widths(w))
    return b.groupBy("doc", "page", "block", "kind").agg(F.count("*").alias("n_lines"))


@query("line_ends", LINE_COUNT + "SELECT doc, count(*) AS n_ends FROM k WHERE w > 0 GROUP BY 1")
def line_ends(spark, sf):
    from ..operators.noise import line_flags

    return line_flags(_words(spark, sf)).where("ends_line").groupBy("doc").agg(F.count("*").alias("n_ends"))


@query("comparison_units")
def comparison_units(spark, sf):
    from ..operators.noise import units

    w = _words(spark, sf).withColumn("key", F.col("text"))
    return units(w).groupBy("doc").agg(F.count("*").alias("n_units"))


@query("repeated_page_lines")
def repeated_page_lines(spark, sf):
    w = _words(spark, sf)
    # A running head and a numbered foot on every page of more than one.
    t = Wd.line_table(w).select("doc", "page", "text", "y0", "y1")
    head = t.select("doc", "page").distinct().select("doc", "page", F.lit("Servizi SpA").alias("text"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("y1"))
    return L.repeated_lines(t.unionByName(head), _pages_of(w)).select("doc", "text", "zone", "on_pages")


@query("page_number_lines", LINE_COUNT + """
, p AS (SELECT doc, page, count(*) OVER (PARTITION BY doc) AS n FROM (SELECT DISTINCT doc, page FROM k WHERE w > 0))
SELECT doc, CAST(page AS INTEGER) AS page, CAST(page + 1 AS INTEGER) AS n FROM p""")
def page_number_lines(spark, sf):
    w = _words(spark, sf)
    p = _pages_of(w)
    foot = p.select("doc", "page", F.lit(99).alias("line"), F.format_string("Pag. %d di 9", F.col("page") + 1).alias("text"), F.lit(800.0).alias("y0"), F.lit(812.0).alias("y1"))
    return L.page_numbers(foot, p).select("doc", "page", "n")


@query("title_lines", LINE_COUNT + ", z AS (SELECT doc, sum(CASE WHEN n = 0 THEN w ELSE 0 END) AS t, sum(CASE WHEN n > 0 THEN w ELSE 0 END) AS b FROM k GROUP BY 1) SELECT doc, CAST(0 AS INTEGER) AS page FROM z WHERE t > 0 AND b > t")
def title_lines(spark, sf):
    w = _words(spark, sf)
    return L.titles(Wd.line_table(w), L.body_size(w), _pages_of(w)).select("doc", "page")


@query("body_sizes", LINE_COUNT + ", z AS (SELECT doc, sum(CASE WHEN n = 0 THEN w ELSE 0 END) AS t, sum(CASE WHEN n > 0 THEN w ELSE 0 END) AS b FROM k GROUP BY 1) SELECT doc, CASE WHEN t > b THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS body FROM z WHERE t <> b AND t + b > 0")
def body_sizes(spark, sf):
    w = _words(spark, sf)
    tie = w.groupBy("doc").agg((F.count_if(F.col("n") == 0) != F.count_if(F.col("n") > 0)).alias("ok")).where("ok").select("doc")
    return L.body_size(w).join(tie, "doc", "left_semi")


@query("zoned_words")
def zoned_words(spark, sf):
    w = _words(spark, sf)
    marks = w.where(F.col("n") == 0).select("doc", "page", "pos", F.lit("titolo").alias("zone"))
    return L.zone_boxes(L.zone_words(w, marks))


@query("zone_text_chunks", LINE_COUNT + "SELECT doc, 'titolo' AS zone, CAST(w AS BIGINT) AS n FROM k WHERE n = 0 AND w > 0")
def zone_text_chunks(spark, sf):
    w = _words(spark, sf)
    marks = w.where(F.col("n") == 0).select("doc", "page", "pos", F.lit("titolo").alias("zone"))
    t = L.zone_texts(L.zone_words(w, marks))
    return t.select("doc", "zone", F.size(F.split("text", " ")).cast("bigint").alias("n"))


# Every line's words fill a left column that ends at 250 less a point or two, a word stands right of the gutter; every tenth
# line runs across.
CORRIDORS_SQL = LINE_COUNT + """
, g AS (SELECT doc, page, count(*) AS n, count_if(n % 10 = 9) AS x FROM k WHERE w > 0 GROUP BY 1, 2),
e AS (SELECT doc, page, 250 - n % 3 AS x0, row_number() OVER (PARTITION BY doc, page ORDER BY n % 3 DESC) - 1 AS i, count(*) OVER (PARTITION BY doc, page) AS m FROM k WHERE w > 0 AND n % 10 <> 9)
SELECT doc, CAST(page AS INTEGER) AS page, CAST(x0 AS DOUBLE) AS x0, CAST(290 AS DOUBLE) AS x1 FROM e JOIN g USING (doc, page)
WHERE n >= 6 AND x <= CAST(0.2 AS DOUBLE) * n AND i = CAST(floor(CAST(0.9 AS DOUBLE) * (m - 1)) AS BIGINT)"""


def _two_columns(spark, sf):
    w = _words(spark, sf)
    across = F.col("n") % 10 == 9
    n_words = F.count("*").over(Window.partitionBy("doc", "n"))
    room = F.when(across, 400.0).otherwise(200.0 - F.col("n") % 3)
    at = lambda k: 50.0 + room * k / F.col("w")
    left = w.withColumn("w", n_words).select("doc", "page", F.col("n").alias("line"), at(F.col("k")).alias("x0"), F.when(
        F.col("k") == F.col("w") - 1, 50.0 + room).otherwise(at(F.col("k") + 0.99)).alias("x1"))
    right = w.where((F.col("k") == 0) & ~across).select("doc", "page", F.col("n").alias("line"), F.lit(290.0).alias("x0"), (390.0 + F.col("n") % 5 * 20).alias("x1"))
    char = w.select("doc").distinct().withColumn("char", F.lit(5.0))
    return C.line_parts(left.unionByName(right), char)


@query("column_corridors", CORRIDORS_SQL)
def column_corridors(spark, sf):
    return C.corridors(_two_columns(spark, sf))


# A diagonal mark of two words on every page, a little off its place and size, and a large level price.
@query("watermark_marks", LINE_COUNT + """
, p AS (SELECT doc, page, count(*) OVER (PARTITION BY doc) AS n FROM (SELECT DISTINCT doc, page FROM k WHERE w > 0))
SELECT doc, CAST(page AS INTEGER) AS page, 'bozza copia' AS text, n > 1 AS repeated, n > 1 OR doc % 3 = 0 AS accepted FROM p
UNION ALL SELECT doc, CAST(page AS INTEGER), 'prezzo', n > 1, false FROM p""")
def watermark_marks(spark, sf):
    pages = _words(spark, sf).select("doc", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    x, y, size = 97.0 + F.col("page") % 7, 297.0 + F.col("page") % 5, 40.0 + F.col("page") % 3
    word = lambda pos, text, angle, x, y, light: F.struct(
        F.lit(pos).alias("pos"), F.lit(text).alias("text"), F.lit(angle).alias("angle"), size.alias("size"), light.alias("light"),
        x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 40).alias("y1"))
    pale = F.col("doc") % 3 == 0
    w = pages.select("doc", "page", F.inline(F.array(
        word(1, "Bozza", 45, x, y, pale), word(2, "COPIA", 45, x + 100, y + 60, pale), word(3, "Prezzo", 0, x + 300, y + 300, F.lit(False)))))
    w = w.withColumn("on_background", F.lit(False))
    large = M.watermark_candidates(w, pages.select("doc").distinct().withColumn("body", F.lit(10.0)))
    return M.marks(M.clusters(large), pages).select("doc", "page", "text", "repeated", "accepted")


@query("line_holes")
def line_holes(spark, sf):
    w = Wd.lines(_words(spark, sf))
    # Every tenth word is taken away: its place is a hole.
    kept = w.where(F.col("k") % 10 != 5)
    return L.holes(L.geometry(kept), Wd.char_widths(w)).groupBy("doc").agg(F.count("*").alias("n_holes"))


@query("value_runs", r"""
WITH w AS (SELECT item_id AS doc, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS t FROM (SELECT item_id, string_split_regex(text, '\s+') AS ws FROM benchmark)),
x AS (SELECT doc, pos, CASE WHEN pos % 6 = 2 THEN '12' WHEN pos % 6 = 3 THEN 'euro' ELSE regexp_replace(t, '[0-9]', '', 'g') END AS t FROM w)
SELECT doc, CAST(pos AS INTEGER) AS start, t || CASE WHEN EXISTS (SELECT 1 FROM x y WHERE y.doc = x.doc AND y.pos = x.pos + 1) THEN ' euro' ELSE '' END AS value FROM x WHERE pos % 6 = 2""")
def value_runs(spark, sf):
    w = _doc_words_all(spark, sf)
    t = F.when(F.col("pos") % 6 == 2, "12").when(F.col("pos") % 6 == 3, "euro").otherwise(F.regexp_replace("text", r"[0-9]|^[€%/().,:-]+$", ""))
    return L.value_runs(w.withColumn("text", t)).select("doc", "start", "value")


def _doc_words_all(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))


@query("hard_boundaries", """
WITH c AS (SELECT o_custkey AS p, min(o_orderkey) AS i1, max(o_orderkey) + 1 AS i2 FROM orders GROUP BY 1)
SELECT p AS pair_id, i1 + 1 AS s, i1 + 3 AS e, true AS section FROM c WHERE i2 - i1 > 4 UNION ALL SELECT p, i1, i1 + 1, false FROM c WHERE i2 - i1 > 4
UNION ALL SELECT p, i1 + 3, i2, false FROM c WHERE i2 - i1 > 4 UNION ALL SELECT p, i1, i2, false FROM c WHERE i2 - i1 <= 4""")
def hard_boundaries(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.min("o_orderkey").alias("i1"), (F.max("o_orderkey") + 1).alias("i2"))
    r = c.where(F.col("i2") - F.col("i1") > 4).select("pair_id", (F.col("i1") + 1).alias("start"), (F.col("i1") + 3).alias("end"), F.lit(2).alias("lines"))
    return L.hard_bounds(c, r).select("pair_id", "s", "e", "section")


@query("zone_differences", """
WITH c AS (SELECT l_orderkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN 'mancante' ELSE 'in_piu' END AS op, 't'||(l_partkey % 2) AS t, CAST(l_linenumber AS INTEGER) AS page FROM lineitem),
g AS (SELECT p, op, t, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM c GROUP BY 1, 2, 3),
m AS (SELECT a.p, a.t FROM g a JOIN g b ON a.p = b.p AND a.t = b.t AND a.op = 'mancante' AND b.op = 'in_piu')
SELECT g.p AS pair_id, g.op, g.t FROM g LEFT JOIN m ON m.p = g.p AND m.t = g.t WHERE m.p IS NULL UNION ALL SELECT p, 'spostato', t FROM m""")
def zone_differences(spark, sf):
    li = table(spark, sf, "lineitem")
    gone = F.col("l_linenumber") % 2 == 0
    t = F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string"))
    c = li.select(F.col("l_orderkey").alias("pair_id"), F.lit("header").alias("zone"), F.col("l_linenumber").alias("page"), F.when(gone, "mancante").otherwise("in_piu").alias("op"),
                  F.when(gone, t).otherwise("").alias("left_text"), F.when(gone, "").otherwise(t).alias("right_text"))
    out = L.zone_differences(c)
    return out.select("pair_id", "op", F.coalesce(F.nullif("left_text", F.lit("")), "right_text").alias("t"))


@query("recognised_variables", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'variabile' ELSE 'testo' END AS klass,
 CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'listino' ELSE 'buco' END ELSE '' END AS prova FROM part""")
def recognised_variables(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    d = p.select(F.lit(1).alias("pair_id"), k.alias("id"), F.lit("testo").alias("klass"), F.when(k % 7 == 0, "maiuscole").otherwise("parola").alias("tipo"), F.concat(F.lit("v"), k.cast("string")).alias("right_text"))
    sites = p.where(k % 2 == 0).select(F.lit(1).alias("pair_id"), k.alias("id"), F.lit("buco").alias("prova"))
    proofs = p.where(k % 3 == 0).select(F.lit(1).alias("pair_id"), k.alias("id"), F.when(k % 5 == 0, "listino").otherwise("payload").alias("proof"), F.lit("n").alias("nome"))
    fixed = p.where(k < 0).select(F.lit(1).alias("pair_id"), F.lit("x").alias("value"))
    return L.recognise(d, sites, proofs, fixed, ["listino"]).select("id", "klass", "prova")


# Twelve rules of what a difference holds, by part: amounts and dates in added texts, sections, slots, placeholders, units.
SPLIT_SQL = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 12 AS m, p_name AS t, CAST(p_partkey % 90 + 10 AS VARCHAR) || ',50' AS v FROM part)
SELECT id, 0 AS part, CASE WHEN m IN (3, 4) THEN 'mancante' WHEN m = 5 THEN 'sezione_in_piu' WHEN m = 9 THEN 'cambiato' ELSE 'in_piu' END AS op,
  CASE WHEN m IN (1, 3, 4, 5, 9) THEN 'variabile' ELSE 'testo' END AS klass,
  CASE m WHEN 1 THEN 'buco' WHEN 2 THEN 'listino' WHEN 3 THEN 'cella' WHEN 4 THEN 'segnaposto' WHEN 5 THEN 'sezione' WHEN 9 THEN 'segnaposto' ELSE '' END AS prova,
  CASE m WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v || ' euro' WHEN 5 THEN t WHEN 6 THEN 'zona' WHEN 7 THEN v || ' euro' WHEN 8 THEN t WHEN 9 THEN t WHEN 10 THEN t || ' qui' WHEN 11 THEN t || ' ' || v ELSE '' END AS r,
  CASE WHEN m IN (1, 2, 5, 9) THEN 'n' || id WHEN m = 3 THEN 'c' || id WHEN m = 4 THEN '{{se vale ' || t || '}}' ELSE '' END AS nome FROM p
UNION ALL SELECT id, 1, 'in_piu', 'variabile', 'buco', CASE m WHEN 0 THEN v || ' euro' WHEN 6 THEN v || ' mesi' ELSE v END, 'n' || id FROM p WHERE m IN (0, 6, 10)"""


@query("split_variables", SPLIT_SQL)
def split_variables(spark, sf):
    """0 amount after a name, 1 alone, 2 its proof off, 3 a unit in a filled cell, 4 a conditional text left out, 5 a known section,
    6 a probable slot, 7 a fixed text, 8 no value, 9 a declared slot, 10 amount inside a text, 11 an amount without a source."""
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey")).withColumn("m", F.col("p_partkey") % 12)
    m, name = F.col("m"), F.col("p_name")
    v = F.concat((F.col("p_partkey") % 90 + 10).cast("string"), F.lit(",50"))
    keys = lambda *c: F.split(F.concat_ws(" ", *c), " ")
    none = F.array().cast("array<string>")
    right = (F.when(m == 0, keys(name, v, F.lit("euro"))).when(m == 1, keys(v)).when(m.isin(2, 7), keys(v, F.lit("euro"))).when(m.isin(3, 4), none)
             .when(m.isin(5, 8, 9), keys(name)).when(m == 6, keys(F.lit("zona"), v, F.lit("mesi"))).when(m == 10, keys(name, v, F.lit("qui"))).otherwise(keys(name, v)))
    left = F.when(m == 3, F.array(F.lit("euro"))).when(m == 4, keys(F.concat(F.lit("{{se vale "), name, F.lit("}}")))).when(m == 9, F.array(F.lit("........"))).otherwise(none)
    d = p.select(
        (F.col("id") % 7).alias("pair_id"), "id", "m", F.when(m.isin(3, 4), "mancante").when(m == 5, "sezione_in_piu").when(m == 9, "cambiato").otherwise("in_piu").alias("op"),
        F.when(m == 5, "composizione").when(m.isin(6, 9), "variabile").otherwise("testo").alias("klass"), F.lit("frase").alias("tipo"), F.lit("corpo").alias("zone"),
        F.when(m == 6, "probabile").when(m == 9, "certo").alias("slot"), left.alias("left_keys"), right.alias("right_keys"), F.lit("").alias("target_text"), name.alias("_name"), v.alias("_v"))
    n = F.size(F.split("_name", " "))
    sites = d.where(m.isin(0, 1, 2, 7, 8, 10, 11)).select("pair_id", "id", F.when(m.isin(0, 10, 11), n).otherwise(0).alias("s"), F.lit("buco").alias("prova"), F.lit("r").alias("room"))
    # the value is said per difference here, so that no other difference's source proves it
    d = d.withColumn("pair_id", F.col("id"))
    value = F.when(m.isin(0, 2, 7), F.concat_ws(" ", "_v", F.lit("euro"))).when(m == 6, F.concat_ws(" ", "_v", F.lit("mesi"))).when(m.isin(1, 10), F.col("_v")).when(m.isin(5, 9), F.col("_name"))
    sources = d.where(value.isNotNull()).select("pair_id", value.alias("value"), F.when(m == 2, "listino").otherwise("payload").alias("source"), F.concat(F.lit("n"), F.col("id")).alias("nome"))
    fixed = d.where(m == 7).select("pair_id", F.concat_ws(" ", "_v", F.lit("euro")).alias("value"))
    voids = d.where(m == 5).select("pair_id", "id")
    cells = d.where(m == 3).select("pair_id", "id", F.lit("12 euro").alias("filled"), F.concat(F.lit("c"), F.col("id")).alias("nome"))
    out = Va.recognise_variables(d.drop("m", "_name", "_v"), sites.withColumn("pair_id", F.col("id")), sources, fixed, voids, cells, on=[x for x in Va.ALL_PROOFS if x != "listino"])
    return out.select("id", "part", "op", "klass", "prova", F.array_join("right_keys", " ").alias("r"), "nome")


# ------------------------------------------------------- versions and delivery ---


def _version_files(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "target").when(k % 4 == 1, "asis").otherwise(F.concat(F.lit("tobe-"), (k % 90 + 1).cast("string")))
    ext = F.when(k % 3 == 0, ".meta.json").otherwise(".pdf")
    return o.select(F.concat(F.lit("/root/"), F.col("o_custkey").cast("string"), F.lit("/"), kind, ext).alias("path"), (k % 10).alias("size"), F.col("o_orderdate").alias("mtime"))


VER = """
WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CASE o_orderkey % 4 WHEN 0 THEN 'target' WHEN 1 THEN 'asis' ELSE 'tobe' END AS kind, CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey % 90 + 1 ELSE 0 END AS number,
  o_orderkey % 3 = 0 AS meta, o_orderkey % 10 AS size FROM orders),
v AS (SELECT c, kind, CAST(number AS INTEGER) AS number, NOT bool_or(NOT meta) AS missing, bool_or(NOT meta) AND max(CASE WHEN NOT meta THEN size END) = 0 AS broken FROM f GROUP BY 1, 2, 3)
"""


@query("document_versions", VER + 'SELECT c AS "case", kind, number, missing, coalesce(broken, false) AS broken FROM v')
def document_versions(spark, sf):
    return V.read_versions(_version_files(spark, sf)).select("case", "kind", "number", "missing", "broken")


@query("next_version_numbers", VER + """SELECT c AS "case", CAST(coalesce(max(CASE WHEN kind = 'tobe' THEN number END), 0) + 1 AS INTEGER) AS next_number FROM v GROUP BY c""")
def next_version_numbers(spark, sf):
    return V.next_numbers(V.read_versions(_version_files(spark, sf)))


def _cases(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case"), F.concat(F.lit("K"), (F.col("c_custkey") % 1000).cast("string")).alias("key"), F.col("c_mktsegment").alias("variant"))


PLAN = VER + """
, cs AS (SELECT CAST(c_custkey AS VARCHAR) AS c, 'K'||(c_custkey % 1000) AS key, c_mktsegment AS variant, count(*) OVER (PARTITION BY c_custkey % 1000) AS n FROM customer),
lt AS (SELECT v.* FROM v WHERE kind <> 'tobe' OR number = (SELECT max(number) FROM v w WHERE w.c = v.c AND w.kind = 'tobe')),
s AS (SELECT cs.*, x.slot, x.stem FROM cs, (VALUES ('target','atteso'), ('asis','as-is'), ('tobe','to-be')) x(slot, stem)),
p AS (SELECT s.c AS "case", key, slot, CASE WHEN lt.c IS NULL THEN 'assente' WHEN missing THEN 'sparito' WHEN broken THEN 'illeggibile' END AS reason, stem||CASE WHEN n > 1 THEN ' ('||variant||')' ELSE '' END||'.pdf' AS nm
  FROM s LEFT JOIN lt ON lt.c = s.c AND lt.kind = s.slot)
"""


@query("delivery_plan", PLAN + 'SELECT "case", slot, CASE WHEN reason IS NULL THEN nm END AS file_name, reason FROM p')
def delivery_plan(spark, sf):
    return V.delivery_plan(_cases(spark, sf), V.read_versions(_version_files(spark, sf))).select("case", "slot", "file_name", "reason")


@query("delivery_conflicts", PLAN + """SELECT "case", slot FROM p WHERE reason IS NULL AND CAST("case" AS INTEGER) % 3 = 0""")
def delivery_conflicts(spark, sf):
    plan = V.delivery_plan(_cases(spark, sf), V.read_versions(_version_files(spark, sf)))
    have = plan.where((F.col("case").cast("int") % 3 == 0) & F.col("file_name").isNotNull()).select(F.upper(F.concat_ws("/", F.lit("/out"), "key", "file_name")).alias("path"))
    return V.delivery_conflicts(plan.where((F.col("case").cast("int") % 3 == 0)), have, "/out").select("case", "slot")


@query("extraction_misses", """
WITH d AS (SELECT sha256(text) AS sha, min(doc_id) AS first FROM documents GROUP BY 1), x AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 4 = 0)
SELECT sha FROM d WHERE sha NOT IN (SELECT sha FROM x)""")
def extraction_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    have = d.where(F.col("doc_id") % 4 == 0).select(F.sha2("content", 256).alias("sha"), F.lit(2).alias("format"))
    return V.cache_misses(d, have, 2).select("sha")


# ------------------------------------------------------------------- events ---


@query("largest_copy_per_day", "SELECT event_type AS env, CAST(ts AS DATE) AS day, max(event_id) AS size FROM events GROUP BY 1, 2")
def largest_copy_per_day(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("env"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("size"))
    return T.keep_largest(e)


@query("throttled_progress", """
WITH e AS (SELECT *, epoch_ms(ts) // 3600000 AS tick, event_id % 50 = 0 AS final FROM events)
SELECT event_id FROM e WHERE final UNION ALL SELECT arg_max(event_id, ts) FROM e WHERE NOT final GROUP BY user_id, event_type, tick""")
def throttled_progress(spark, sf):
    e = table(spark, sf, "events")
    final = F.col("event_id") % 50 == 0
    ev = e.select("event_id", F.col("user_id").alias("run"), F.col("event_type").alias("name"), "ts", F.when(final, 1).otherwise(0).alias("done"), F.lit(1).alias("size"))
    return T.throttle(ev, 3_600_000).select("event_id")


@query("window_rates", """
SELECT event_type AS run, CAST(sum(event_id) AS BIGINT) AS bytes, date_trunc('hour', ts) AS start FROM events GROUP BY 1, 3""")
def window_rates(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("bytes"))
    return T.window_rates(e, "1 day", "1 hour", "1 hour").select("run", "bytes", F.col("window.start").alias("start"))


@query("batch_totals", """
SELECT user_id AS run, CAST(count_if(event_type='click') AS BIGINT) AS started, CAST(count_if(event_type='view') AS BIGINT) AS done, CAST(count_if(event_type='view' AND event_id % 2 = 0) AS BIGINT) AS failed FROM events GROUP BY 1""")
def batch_totals(spark, sf):
    t = F.when(F.col("event_type") == "click", "BatchStarted").when(F.col("event_type") == "view", "BatchItemDone").otherwise("x")
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), t.alias("type"), F.when(F.col("event_id") % 2 == 0, "failed").otherwise("ok").alias("status"))
    return T.batch_totals(e)
