"""Document queries: tokens, noise rules, masks, URLs, block pairs, word changes, types.

A pair is a document and its edited copy; the edits are per-line rules both engines state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import comparison as Cm
from ..operators import control as Co
from ..operators import diff as D
from ..operators import noise as N
from ..operators import noise_keys as K
from ..operators import regions as R
from ..operators import source_lines as S
from ..session import by_merge
from .registry import dealt, query, table


def _lines(spark, sf, together=False):
    """The lines of all documents; ``together``: dealt by the document."""
    d = dealt(spark, sf, "documents", "doc_id") if together else table(spark, sf, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """
ln AS (SELECT doc_id, source, CAST(unnest(generate_series(0, len(parts) - 1)) AS INTEGER) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
"""

# Presets RE2 can run, alone over the lines.
PRESET_SQL = {
    "Data": r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b|\b\d{1,2}°? (?i:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre) \d{4}\b",
    "IBAN": N.PRESETS["IBAN"], "Codice fiscale": N.PRESETS["Codice fiscale"], "Importo": N.PRESETS["Importo"],
    "Marcatore di firma": r"['`]sig,[^'`\n]*['`]",
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HIT_SQL = "WITH " + LINES + " UNION ALL ".join(
    f"SELECT source, {_q(n)} AS rule, CAST(sum(len(regexp_extract_all(line, {_q(p)}))) AS BIGINT) AS hits FROM ln GROUP BY source"
    for n, p in PRESET_SQL.items())


@query("noise_hits_per_rule", HIT_SQL)
def noise_hits_per_rule(spark, sf):
    rules = [(n, N.PRESETS[n]) for n in PRESET_SQL]
    return N.hit_counts(_lines(spark, sf), rules, ["source"])


@query("noise_hits_all_presets")
def noise_hits_all_presets(spark, sf):
    good, _errors = N.usable_rules([(n, p, True) for n, p in N.PRESETS.items()])
    return N.hit_counts(_lines(spark, sf), good, ["source"])


@query("noise_applied", "WITH " + LINES + f"""
SELECT doc_id, line_no, regexp_replace(regexp_replace(line, {_q(PRESET_SQL['Data'])}, '⁣NOISE:Data', 'g'), {_q('[a-z]+ing')}, '⁣NOISE:ing', 'g') AS noise_line,
 CAST(len(regexp_extract_all(line, {_q(PRESET_SQL['Data'])})) AS INTEGER) AS n_dates, CAST(len(regexp_extract_all(regexp_replace(line, {_q(PRESET_SQL['Data'])}, '#', 'g'), '[a-z]+ing')) AS INTEGER) AS n_ing FROM ln""")
def noise_applied(spark, sf):
    out = N.apply_rules(_lines(spark, sf), [("Data", N.PRESETS["Data"]), ("ing", "[a-z]+ing")])
    n = lambda i: F.get("hits", F.lit(i))["n"]
    return out.select("doc_id", "line_no", "noise_line", n(0).alias("n_dates"), n(1).alias("n_ing"))


@query("noise_spans")
def noise_spans(spark, sf):
    spans = N.match_spans(r"[a-z]+ing\b")
    return _lines(spark, sf).where(F.col("line").contains("ing")).select("doc_id", "line_no", F.explode(spans("line")).alias("s")).select(
        "doc_id", "line_no", "s.start", "s.end")


@query("noise_key_ranges", """
WITH h AS (SELECT conv_id AS doc, turn * 3 AS first, turn * 3 + length(text) % 8 AS last FROM conversations),
r AS (SELECT *, max(last) OVER (PARTITION BY doc ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY first, last) AS g FROM r)
SELECT doc, min(first) AS first, max(last) AS last FROM g GROUP BY doc, g""")
def noise_key_ranges(spark, sf):
    c = table(spark, sf, "conversations")
    return N.noise_ranges(c.select(F.col("conv_id").alias("doc"), (F.col("turn") * 3).alias("first"), (F.col("turn") * 3 + F.length("text") % 8).alias("last")))


# Rules whose matches never lie side by side; the second one spans two keys.
KEY_RULES = [("NUM", r"\d+"), ("DUE", "[a-z]+ing [a-z]+")]


@query("noise_over_keys", "WITH " + LINES + r"""
, k AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS keys FROM ln),
t AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(array_to_string(keys, ' '), '\d+', '⁣NOISE:NUM', 'g'), '[a-z]+ing [a-z]+', '⁣NOISE:DUE', 'g'), ' ') AS keys
  FROM k WHERE len(keys) > 0),
u AS (SELECT doc_id, line_no, generate_subscripts(keys, 1) AS i, unnest(keys) AS key FROM t),
c AS (SELECT *, (length(key) - length(replace(key, '⁣NOISE:DUE', ''))) // 10 AS due, (length(key) - length(replace(key, '⁣NOISE:', ''))) // 7 AS n_hits FROM u)
SELECT doc_id, row_number() OVER w - 1 AS n, key, coalesce(sum(1 + due) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
  (sum(1 + due) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS end, n_hits::INTEGER AS n_hits FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, i)""")
def noise_over_keys(spark, sf):
    """Final keys of every document and the ranges of keys they stand for; whole lines, as SQL has no pieces."""
    final = K.noise_over_keys(_keys(spark, sf), KEY_RULES, by=["doc_id"], cap=None)
    return final.select("doc_id", "n", "key", "first", "end", F.size("hits").alias("n_hits"))


def _keys(spark, sf):
    """(doc_id, pos, key, ends_line): the tokens of every document."""
    from pyspark.sql import Window

    t = _lines(spark, sf, together=True).select("doc_id", "line_no", F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("i", "key"))
    w = Window.partitionBy("doc_id").orderBy("line_no", "i")
    return t.select("doc_id", (F.row_number().over(w) - 1).alias("pos"), "key", (F.lead("line_no").over(w) != F.col("line_no")).alias("ends_line"))


@query("repeated_rule_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_rule_names(spark, sf):
    return N.duplicate_rule_names(table(spark, sf, "part").select(F.col("p_name").alias("name")))


@query("normalised_tokens")
def normalised_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("text")).where(F.col("text") != "")
    return N.with_normal_form(d).groupBy("key").agg(F.count("*").alias("n"))


@query("ascii_token_counts", r"""
SELECT key, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS key FROM benchmark) WHERE key <> '' AND regexp_full_match(replace(key, '`', ''), '[\x00-\x7f]*') AND NOT contains(key, '`') GROUP BY key""")
def ascii_token_counts(spark, sf):
    d = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("text")).where((F.col("text") != "") & F.col("text").rlike(r"^[\x00-\x7f]*$") & ~F.col("text").contains("`"))
    return N.with_normal_form(d).groupBy("key").agg(F.count("*").alias("n"))


@query("masked_texts", """
SELECT page_id, 'vedi https://h'||page_id||'.it/a/b?sig=*** e sig=*** fine' AS shown, 'vedi https://h'||page_id||'.it/… e sig=*** fine' AS logged FROM pages""")
def masked_texts(spark, sf):
    t = F.concat(F.lit("vedi https://user:pw@h"), F.col("page_id").cast("string"), F.lit(".it/a/b?sv=1&sig=abc%2Fd e sig%3Dzz fine"))
    return table(spark, sf, "pages").select("page_id", X.mask_text(t).alias("shown"), X.mask_text_for_log(t).alias("logged"))


@query("shown_headers", """
SELECT c_custkey, '***' AS auth, c_mktsegment AS seg FROM customer""")
def shown_headers(spark, sf):
    m = F.create_map(F.lit("Authorization"), F.col("c_name"), F.lit("x-seg"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", X.shown_headers(m).alias("h")).select(
        "c_custkey", F.col("h")["Authorization"].alias("auth"), F.col("h")["x-seg"].alias("seg"))


@query("normalised_urls", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)([^?#]*)(\?([^#]*))?(#(.*))?$', ['s','h','p','q0','q','f0','f']) AS x FROM pages),
k AS (SELECT page_id, x, list_sort(list_filter(string_split(x.q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|fbclid|msclkid|mkt_tok|mc_cid|mc_eid|_hsenc|_hsmktg)$'))) AS q FROM u)
SELECT page_id, x.s||'://'||lower(x.h)||x.p||CASE WHEN len(q) > 0 THEN '?'||array_to_string(q, '&') ELSE '' END||CASE WHEN x.f <> '' THEN '#'||x.f ELSE '' END AS url FROM k""")
def normalised_urls(spark, sf):
    up = F.regexp_replace("url", "^http", "HTTP")
    return table(spark, sf, "pages").select("page_id", X.url_norm(up).alias("url"))


@query("tracking_keys", r"""
WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages)
SELECT page_id, split_part(p, '=', 1) AS k, regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|fbclid|msclkid|mkt_tok|mc_cid|mc_eid|_hsenc|_hsmktg)$') AS tracking FROM q WHERE p <> ''""")
def tracking_keys(spark, sf):
    q = table(spark, sf, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("p")).where(F.col("p") != "")
    k = F.substring_index("p", "=", 1)
    return q.select("page_id", k.alias("k"), X.is_tracking_key(k).alias("tracking"))


@query("placeholders", """
SELECT p_partkey, p_partkey % 6 < 4 AS is_placeholder FROM part""")
def placeholders(spark, sf):
    m = F.col("p_partkey") % 6
    t = F.when(m == 0, "XXXX").when(m == 1, "[xx],").when(m == 2, "gg/mm/aaaa").when(m == 3, "{{NOME}}").when(m == 4, "xxxx").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.is_placeholder(t).alias("is_placeholder"))


@query("brace_rewrites", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a .... b' WHEN 1 THEN 'a se '||p_name||' vale b' ELSE p_name END AS t FROM part""")
def brace_rewrites(spark, sf):
    m = F.col("p_partkey") % 3
    t = F.when(m == 0, "a {{X_QF/X_QV}} b").when(m == 1, F.concat(F.lit("a {{se "), "p_name", F.lit(" vale}} b"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", N.rewrite_braces(t).alias("t"))


@query("brace_rewrites_mixed", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'se vale '||p_name||' poi .... fine' WHEN 1 THEN '...., poi se vale '||p_name||' fine'
  WHEN 2 THEN 'Voce .... '||p_name||' fine' ELSE 'il .... .... .... e ....' END AS t FROM part""")
def brace_rewrites_mixed(spark, sf):
    """Values and conditional texts side by side, nested, and values of several keys."""
    m, name = F.col("p_partkey") % 4, F.col("p_name")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    t = (F.when(m == 0, c("{{se vale ", name, "}} poi {{NOME}} fine")).when(m == 1, c("{{NOME}}, poi {{se vale ", name, "}} fine"))
         .when(m == 2, c("{{Voce {{E_PCV}} ", name, "}} fine")).otherwise(F.lit("il {{gg mese aaaa}} e {{X_QF/X_QV}}")))
    return table(spark, sf, "part").select("p_partkey", N.rewrite_braces(t).alias("t"))


@query("noise_first_rule_wins", """
SELECT p_partkey, chr(8291)||'NOISE:prima'||substr(p_name, length(split_part(p_name, ' ', 1)) + 1, 1)||
  array_to_string(list_transform(list_slice(string_split(p_name, ' '), 2, 99), lambda x: chr(8291)||'NOISE:tutto'), ' ') AS t,
  CAST(len(string_split(p_name, ' ')) - 1 AS INTEGER) AS n FROM part""")
def noise_first_rule_wins(spark, sf):
    """A rule that matches everything leaves alone what an earlier rule took."""
    out = N.apply_rules(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("line")), [("prima", "^[^ ]+"), ("tutto", "[^ ]+")])
    return out.select("p_partkey", F.col("noise_line").alias("t"), F.get("hits", F.lit(1))["n"].alias("n"))


@query("italian_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(round(l_extendedprice, 2)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3""")
def italian_numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.format_number(F.col("l_extendedprice"), 2)
    it = F.translate(s, ",.", ".,")
    return li.withColumn("v", X.italian_number(it)).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("v").cast("double").alias("v"))


@query("epoch_days", """
SELECT event_id, array_to_string(list_sort(list_distinct([strftime(ts, '%d/%m/%Y'), strftime(ts + INTERVAL 1 HOUR, '%d/%m/%Y'), strftime(ts + INTERVAL 2 HOUR, '%d/%m/%Y')])), ',') AS days FROM events""")
def epoch_days(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return table(spark, sf, "events").select("event_id", F.array_join(X.epoch_days(ms), ",").alias("days"))


@query("safe_names", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_')||'_x.pdf' WHEN 1 THEN 'CON_.txt' WHEN 2 THEN '_' ELSE repeat('a', 116)||'.pdf' END AS name,
 replace(lower(p_name), ' ', '-') AS slug FROM part""")
def safe_names(spark, sf):
    from ..functions import names

    m = F.col("p_partkey") % 4
    raw = F.when(m == 0, F.concat(F.translate("p_name", " ", "?"), F.lit(":x.pdf. "))).when(m == 1, "CON.txt").when(m == 2, " .. ").otherwise(
        F.concat(F.repeat(F.lit("a"), 130), F.lit(".pdf")))
    return table(spark, sf, "part").select("p_partkey", names.safe_component(raw).alias("name"), names.slug(F.concat(F.lit(" "), F.col("p_name"), F.lit("!"))).alias("slug"))


# ---------------------------------------------------------------- comparison ---

PAIR = "WITH " + LINES + """
, rt AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 1 THEN 'EDIT '||line ELSE line END AS line FROM ln WHERE line_no % 7 <> 3),
tk AS (SELECT doc_id, 'L' AS side, line_no, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS keys FROM ln UNION ALL
  SELECT doc_id, 'R', line_no, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') FROM rt),
bk AS (SELECT doc_id AS pair_id, side, row_number() OVER (PARTITION BY doc_id, side ORDER BY line_no) - 1 AS block, keys FROM tk WHERE len(keys) > 0),
hk AS (SELECT *, array_to_string(keys, chr(1)) AS h FROM bk), hn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, h ORDER BY block) AS k, count(*) OVER (PARTITION BY pair_id, side, h) AS n FROM hk),
ex AS (SELECT l.pair_id, l.block AS l, r.block AS r FROM hn l JOIN hn r ON l.side = 'L' AND r.side = 'R' AND l.pair_id = r.pair_id AND l.h = r.h AND l.k = r.k AND l.n = r.n)
"""


def _blocks(spark, sf, *more):
    """(pair_id, side, block, keys, …): non-blank lines of the document and of its edited copy."""
    from pyspark.sql import Window

    n = F.col("line_no")
    edited = F.when(n % 7 != 3, F.when(n % 5 == 1, F.concat(F.lit("EDIT "), "line")).otherwise(F.col("line")))
    both = _lines(spark, sf, together=True).select("doc_id", "line_no", F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), line.alias("line")) for side, line in (("L", F.col("line")), ("R", edited))])))
    b = both.withColumn("keys", F.filter(F.split("line", r"\s+"), lambda w: w != "")).where(F.size("keys") > 0)
    w = Window.partitionBy("doc_id", "side").orderBy("line_no")
    return b.select(F.col("doc_id").alias("pair_id"), "side", (F.row_number().over(w) - 1).cast("bigint").alias("block"), "keys",
                    F.lit(1).alias("lines"), F.lit(10.0).alias("size"), F.lit("paragrafo").alias("kind"), *more)


def _placed(blocks):
    """The blocks with ``pos``, the place of their first word among those of their side."""
    from pyspark.sql import Window

    o = Window.partitionBy("pair_id", "side").orderBy("block")
    return blocks.withColumn("pos", (F.sum(F.size("keys")).over(o) - F.size("keys")).cast("bigint"))


def _words(blocks):
    w = _placed(blocks).select("pair_id", "side", "block", "pos", F.posexplode("keys").alias("k", "key"))
    return w.select("pair_id", "side", "block", "key", (F.col("pos") + F.col("k")).alias("pos"))


@query("exact_block_matches", PAIR + "SELECT pair_id, l, r FROM ex")
def exact_block_matches(spark, sf):
    return D.exact_matches(_blocks(spark, sf))


@query("monotone_block_matches")
def monotone_block_matches(spark, sf):
    return D.monotone(D.exact_matches(_blocks(spark, sf)))


JACCARD = PAIR + """
, um AS (SELECT bk.* FROM bk LEFT JOIN ex ON ex.pair_id = bk.pair_id AND ((side = 'L' AND ex.l = block) OR (side = 'R' AND ex.r = block)) WHERE ex.pair_id IS NULL AND len(keys) >= 8),
sh AS (SELECT pair_id, side, block, list_distinct(list_transform(generate_series(1, len(keys) - 2), lambda i: array_to_string(keys[i:i+2], chr(1)))) AS s FROM um),
c AS (SELECT DISTINCT a.pair_id, a.block AS l, b.block AS r FROM (SELECT pair_id, block, unnest(s) AS x FROM sh WHERE side = 'L') a JOIN (SELECT pair_id, block, unnest(s) AS x FROM sh WHERE side = 'R') b ON a.pair_id = b.pair_id AND a.x = b.x)
SELECT c.pair_id, c.l, c.r, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard
FROM c JOIN sh a ON a.pair_id = c.pair_id AND a.side = 'L' AND a.block = c.l JOIN sh b ON b.pair_id = c.pair_id AND b.side = 'R' AND b.block = c.r"""


@query("candidate_block_pairs", JACCARD)
def candidate_block_pairs(spark, sf):
    b = _blocks(spark, sf)
    rest = D.unmatched(D.block_facts(b), D.exact_matches(b)).where(~F.col("short"))
    inst, cont = D.contents(rest)
    s = lambda side, n: inst.where(F.col("side") == side).select("pair_id", F.col("h").alias(f"{n}h"), F.col("block").alias(n))
    j = D.candidate_pairs(cont).join(by_merge(s("L", "l")), ["pair_id", "lh"]).join(by_merge(s("R", "r")), ["pair_id", "rh"])
    common = F.col("shared")
    return j.select("pair_id", "l", "r", F.round(common / (F.col("ls") + F.col("rs") - common), 6).alias("jaccard"))


@query("scored_block_pairs")
def scored_block_pairs(spark, sf):
    b = _blocks(spark, sf)
    return D.scored_candidates(D.unmatched(D.block_facts(b), D.exact_matches(b)))


@query("aligned_blocks")
def aligned_blocks(spark, sf):
    return D.align(_blocks(spark, sf))


@query("unique_word_anchors", PAIR + """
, w AS (SELECT pair_id, side, unnest(keys) AS key, unnest(generate_series(1, len(keys))) AS k, block FROM bk),
p AS (SELECT pair_id, side, key, row_number() OVER (PARTITION BY pair_id, side ORDER BY block, k) - 1 AS pos FROM w)
SELECT pair_id, min(CASE WHEN side='L' THEN pos END) AS i, min(CASE WHEN side='R' THEN pos END) AS j FROM p GROUP BY pair_id, key HAVING count_if(side='L') = 1 AND count_if(side='R') = 1""")
def unique_word_anchors(spark, sf):
    return D.unique_anchors(_words(_blocks(spark, sf)))


@query("anchor_runs")
def anchor_runs(spark, sf):
    return D.anchor_runs(_words(_blocks(spark, sf)))


@query("word_changes")
def word_changes(spark, sf):
    b = _blocks(spark, sf)
    fixed = D.monotone(D.exact_matches(b)).where("kept").select("pair_id", "l", "r")
    c = D.word_changes(_placed(b), fixed)
    return c.select("pair_id", "op", "i1", "i2", "j1", "j2")


# Gaps bounded by every pair of a known alignment: equal lines, and edited ones, which begin a gap.
CUTS_SQL = PAIR + """
, pl AS (SELECT pair_id, side, block, len(keys) AS n, coalesce(sum(len(keys)) OVER (PARTITION BY pair_id, side ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at,
    ln AS line_no FROM (SELECT bk.*, tk.line_no AS ln FROM bk JOIN (SELECT doc_id, side, line_no, row_number() OVER (PARTITION BY doc_id, side ORDER BY line_no) - 1 AS block FROM tk WHERE len(keys) > 0) tk
      ON tk.doc_id = bk.pair_id AND tk.side = bk.side AND tk.block = bk.block)),
al AS (SELECT l.pair_id, l.at AS i, l.n, l.line_no, r.at AS j, sum(CASE WHEN r.at IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.pair_id ORDER BY l.line_no) AS g,
    max(r.at + r.n) OVER (PARTITION BY l.pair_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach
  FROM pl l LEFT JOIN pl r ON r.pair_id = l.pair_id AND r.side = 'R' AND r.line_no = l.line_no WHERE l.side = 'L')
SELECT pair_id, 'in_piu' AS op, CAST(i AS BIGINT) AS i1, CAST(i AS BIGINT) AS i2, CAST(j AS BIGINT) AS j1, CAST(j + 1 AS BIGINT) AS j2 FROM al WHERE line_no % 5 = 1 AND j IS NOT NULL
UNION ALL SELECT pair_id, 'mancante', CAST(min(i) AS BIGINT), CAST(max(i + n) AS BIGINT), CAST(coalesce(max(reach), 0) AS BIGINT), CAST(coalesce(max(reach), 0) AS BIGINT) FROM al WHERE j IS NULL GROUP BY pair_id, g"""


@query("aligned_word_changes", CUTS_SQL)
def aligned_word_changes(spark, sf):
    """The word diff between the pairs of an alignment that the edits state: unequal pairs bound gaps as equal ones do."""
    b = _blocks(spark, sf, "line_no")
    of = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("block")))
    met = b.where(F.col("pair_id").isNotNull()).groupBy("pair_id", "line_no").agg(of("L").alias("ls"), of("R").alias("rs"))
    pairs = met.select("pair_id", F.explode("ls").alias("l"), "rs").select("pair_id", "l", F.explode("rs").alias("r"))
    return D.word_changes(_placed(b), D.sync_pairs(pairs, b)).select("pair_id", "op", "i1", "i2", "j1", "j2")


@query("document_differences")
def document_differences(spark, sf):
    b = _blocks(spark, sf)
    return D.compare(_placed(b), b).select("pair_id", "id", "op", "klass", "tipo", "left_text", "right_text", "context")


# Parts in documents of twenty, a row of ten keys each. In the copy every row n: n % 3 = 1 has another quantity, row 2 (of two lines) is
# gone, n % 3 = 2 another discount, which is noise; every fifth document ends with a note.
WHOLE_SQL = """
WITH r AS (SELECT p_partkey // 20 AS doc, p_partkey % 20 AS n, p_partkey AS k, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey % 20) - 1) * 10 AS pos FROM part),
d AS (SELECT doc, pos, 'cambiato' AS op, 'testo' AS klass, 'parola' AS tipo, 'Q' || k % 50 AS l, 'X' || k % 50 AS r FROM r WHERE n % 3 = 1
UNION ALL SELECT doc, pos, 'sezione_assente', 'composizione', 'sezione', 'riga ' || n || ' parte P' || k || ' S' || k % 97 || ' quantita Q' || k % 50 || ' sconto D' || k % 10 || ' fine', '' FROM r WHERE n = 2
UNION ALL SELECT doc, pos, 'cambiato', 'rumore', 'numeri', 'D' || k % 10, 'D1' || k % 10 FROM r WHERE n % 3 = 2 AND n <> 2
UNION ALL SELECT doc, max(pos) + 10, 'in_piu', 'testo', 'frase', '', 'nota del documento ' || doc || ' in fondo' FROM r WHERE doc % 5 = 0 GROUP BY doc)
SELECT doc AS pair_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS id, op, klass, tipo, l AS left_text, r AS right_text FROM d"""


@query("compared_documents", WHOLE_SQL)
def compared_documents(spark, sf):
    """Every stage of the comparison on documents whose edits are rules."""
    from pyspark.sql import Window

    k, s = F.col("p_partkey"), lambda head, c: F.concat(F.lit(head), c.cast("string"))
    p = table(spark, sf, "part").select(F.floor(k / 20).alias("pair_id"), (k % 20).alias("n"), k.alias("k"))

    def rows(side, quantity, discount):
        keys = F.array(F.lit("riga"), F.col("n").cast("string"), F.lit("parte"), s("P", F.col("k")), s("S", F.col("k") % 97), F.lit("quantita"), quantity, F.lit("sconto"), discount, F.lit("fine"))
        return p.select("pair_id", F.lit(side).alias("side"), "n", keys.alias("keys"), F.when(F.col("n") == 2, 2).otherwise(1).alias("lines"))

    n, q, d = F.col("n"), F.col("k") % 50, F.col("k") % 10
    right = rows("R", F.when(n % 3 == 1, s("X", q)).otherwise(s("Q", q)), F.when((n % 3 == 2) & (n != 2), s("D1", d)).otherwise(s("D", d))).where("n <> 2")
    note = p.where("pair_id % 5 = 0").select("pair_id").distinct().select(
        "pair_id", F.lit("R").alias("side"), F.lit(99).cast("bigint").alias("n"), F.split(F.concat_ws(" ", F.lit("nota del documento"), "pair_id", F.lit("in fondo")), " ").alias("keys"), F.lit(1).alias("lines"))
    w = Window.partitionBy("pair_id", "side").orderBy("n")
    b = rows("L", s("Q", q), s("D", d)).unionByName(right).unionByName(note).withColumn("block", (F.row_number().over(w) - 1).cast("bigint")).drop("n")
    b = b.withColumn("size", F.lit(10.0)).withColumn("kind", F.lit("paragrafo"))
    x, y = F.col("k") * 30.0, F.col("block") * 20.0
    words = b.select("pair_id", "side", "block", "size", F.posexplode("keys").alias("k", "key"), (F.size("keys") - 1).alias("last")).select(
        "pair_id", "side", "block", "size", "key", "k", x.alias("x0"), (x + 28).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), F.lit(0).alias("page"),
        F.lit(False).alias("bold"), F.lit("corpo").alias("zone"), (F.col("k") == F.col("last")).alias("ends_line"))
    words = words.withColumn("pos", (F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("block", "k")) - 1).cast("bigint")).drop("k")
    return Cm.compare_pairs(words, b, [("SCONTO", r"\bD\d+\b")]).select("pair_id", "id", "op", "klass", "tipo", "left_text", "right_text")


# The rows of those documents as blocks: what the stages say on their own.
RULE_ROWS = """
WITH r AS (SELECT p_partkey // 20 AS doc, p_partkey % 20 AS n, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey % 20) - 1 AS l, count(*) OVER (PARTITION BY p_partkey // 20) AS m FROM part)
"""


def _rule_rows(spark, sf, right):
    """Blocks of documents of twenty parts; ``right`` says (what to keep, the order, the keys) of the copy by n and k."""
    from pyspark.sql import Window

    k, s = F.col("p_partkey"), lambda head, c: F.concat(F.lit(head), c.cast("string"))
    p = table(spark, sf, "part").select(F.floor(k / 20).alias("pair_id"), (k % 20).alias("n"), k.alias("k"))
    keys = lambda q: F.array(F.lit("riga"), F.col("n").cast("string"), F.lit("parte"), s("P", F.col("k")), s("S", F.col("k") % 97), F.lit("quantita"), q, F.lit("sconto"), s("D", F.col("k") % 10), F.lit("fine"))
    keep, order, quantity = right
    left = p.select("pair_id", F.lit("L").alias("side"), F.col("n").alias("o"), keys(s("Q", F.col("k") % 50)).alias("keys"))
    copy = p.where(keep).select("pair_id", F.lit("R").alias("side"), order.alias("o"), keys(quantity).alias("keys"))
    w = Window.partitionBy("pair_id", "side").orderBy("o")
    return left.unionByName(copy).withColumn("block", (F.row_number().over(w) - 1).cast("bigint")).withColumn("lines", F.lit(1)).withColumn(
        "size", F.lit(10.0)).withColumn("kind", F.lit("paragrafo")).drop("o")


def _edited_rows(spark, sf):
    q = F.col("k") % 50
    return _rule_rows(spark, sf, (F.col("n") != 2, F.col("n"), F.concat(F.when(F.col("n") % 3 == 1, "X").otherwise("Q"), q.cast("string"))))


def _moved_rows(spark, sf):
    return _rule_rows(spark, sf, (F.lit(True), F.when(F.col("n") == 3, 99).otherwise(F.col("n")), F.concat(F.lit("Q"), (F.col("k") % 50).cast("string"))))


@query("aligned_rows", RULE_ROWS + """
SELECT doc AS pair_id, l, CAST(CASE WHEN n <> 2 THEN l - CASE WHEN n > 2 THEN count_if(n = 2) OVER (PARTITION BY doc) ELSE 0 END END AS BIGINT) AS r, CAST(l + 1 AS INTEGER) AS ord FROM r""")
def aligned_rows(spark, sf):
    """Every third row edited, row 2 gone: exact pairs, scored pairs, one unpaired, in target order."""
    return D.align(_edited_rows(spark, sf)).select("pair_id", "l", "r", "ord")


@query("moved_rows", RULE_ROWS + "SELECT doc AS pair_id, l AS l1, l AS l2, m - 1 AS r1, m - 1 AS r2 FROM r WHERE n = 3 AND m > l + 1")
def moved_rows(spark, sf):
    """Row 3 of every document is read last."""
    b = _moved_rows(spark, sf)
    return D.block_moves(D.exact_matches(b)).select("pair_id", "l1", "l2", "r1", "r2")


@query("monotone_rows", RULE_ROWS + """
SELECT doc AS pair_id, l, CAST(CASE WHEN n = 3 THEN m - 1 WHEN n > 3 THEN l - count_if(n = 3) OVER (PARTITION BY doc) ELSE l END AS BIGINT) AS r, n <> 3 OR m <= l + 1 AS kept FROM r""")
def monotone_rows(spark, sf):
    return D.monotone(D.exact_matches(_moved_rows(spark, sf)))


@query("reading_orders", RULE_ROWS + """
SELECT doc AS pair_id, CAST(CASE WHEN n = 3 THEN m - 1 WHEN n > 3 THEN l - count_if(n = 3) OVER (PARTITION BY doc) ELSE l END AS BIGINT) AS r, l AS ord FROM r""")
def reading_orders(spark, sf):
    """The generated rows as the word diff reads them: the moved one back at its partner's place."""
    b = _moved_rows(spark, sf)
    aligned = D.align(b)
    return Cm.reading_order(aligned, Cm.strong_pairs(aligned, b), b)[0].select("pair_id", "r", "ord")


@query("anchor_rows", RULE_ROWS + """
, c AS (SELECT doc, l, CAST(CASE WHEN n = 2 THEN NULL WHEN n > 2 THEN l - count_if(n = 2) OVER (PARTITION BY doc) ELSE l END AS BIGINT) AS r FROM r)
SELECT doc AS pair_id, min(l) AS i1, min(r) AS j1, count(*) AS n FROM c WHERE r IS NOT NULL GROUP BY doc, l - r""")
def anchor_rows(spark, sf):
    """One unique word a row, the third one gone: a run before it and one after it."""
    b = _edited_rows(spark, sf)
    return D.anchor_runs(b.select("pair_id", "side", F.col("block").alias("pos"), F.get("keys", F.lit(3)).alias("key")))


@query("moved_texts", "SELECT p_partkey // 20 AS pair_id, p_partkey * 100 AS i1, p_partkey * 100 + 50 AS j1 FROM part")
def moved_texts(spark, sf):
    """Twenty missing and twenty extra texts a document, alike but for one word of four."""
    k = F.col("p_partkey")
    keys, none = F.split(F.concat(F.lit("P"), k, F.lit(" uno due tre")), " "), F.array().cast("array<string>")
    p = table(spark, sf, "part")
    row = lambda op, left, right: p.select(F.floor(k / 20).alias("pair_id"), F.lit(op).alias("op"), (k * 100).alias("i1"), (k * 100 + 50).alias("j1"), left.alias("left_keys"), right.alias("right_keys"))
    return D.text_moves(row("mancante", keys, none).unionByName(row("in_piu", none, keys))).select("pair_id", "i1", "j1")


@query("whole_sections", """
SELECT p_partkey AS pair_id, CASE p_partkey % 4 WHEN 0 THEN 'sezione_assente' WHEN 1 THEN 'mancante' WHEN 2 THEN 'sezione_in_piu' ELSE 'cambiato' END AS op,
  CASE WHEN p_partkey % 4 IN (0, 2) THEN '2 righe' ELSE '' END AS detail FROM part""")
def whole_sections(spark, sf):
    """0 two lines gone, 1 a line and a half, 2 two lines more, 3 two lines changed."""
    p, m = table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id")), F.col("pair_id") % 4
    n = F.when(m == 1, 7).otherwise(10).cast("bigint")
    zero = F.lit(0).cast("bigint")
    c = p.select("pair_id", F.when(m < 2, "mancante").when(m == 2, "in_piu").otherwise("cambiato").alias("op"), zero.alias("i1"), F.when(m == 2, 0).otherwise(n).alias("i2"),
                 zero.alias("j1"), F.when(m < 2, 0).otherwise(n).alias("j2"))
    half = lambda lo, hi: F.struct(F.lit(lo).cast("bigint").alias("start"), F.lit(hi).cast("bigint").alias("end"), F.lit(1).alias("lines"))
    b = p.select("pair_id", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"), F.array(half(0, 5), half(5, 10)).alias("b")).select("pair_id", "side", F.inline("b"))
    return D.sections(c, b).select("pair_id", "op", "detail")


@query("unit_rules", """
SELECT p_partkey AS doc, CASE p_partkey % 5 WHEN 0 THEN '☐|voce' WHEN 1 THEN 'ABCD|fine' WHEN 2 THEN 'esempio|fine' WHEN 3 THEN '(nota)|fine' ELSE '☒|sì,|no' END AS units FROM part""")
def unit_rules(spark, sf):
    """0 an empty box, 1 a comb field, 2 a hyphen at a line's end, 3 brackets, 4 a ticked box and punctuation."""
    m = F.col("p_partkey") % 5
    line = lambda *t: F.array(*[F.struct(F.lit(x).alias("text"), F.lit(y).alias("y")) for x, y in t])
    t = (F.when(m == 0, line(("[", 0), ("]", 0), ("voce", 0))).when(m == 1, line(("A", 0), ("B", 0), ("C", 0), ("D", 0), ("fine", 1)))
         .when(m == 2, line(("esem-", 0), ("pio", 1), ("fine", 1))).when(m == 3, line(("(", 0), ("nota", 0), (")", 0), ("fine", 1)))
         .otherwise(line(("[", 0), ("x", 0), ("]", 0), ("sì", 1), (",", 1), ("no", 1))))
    x, y = F.col("pos") * 20.0, F.col("t.y") * 20.0
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.posexplode(t).alias("pos", "t")).select(
        "doc", "pos", F.col("t.text").alias("text"), F.col("t.text").alias("key"), F.lit(0).alias("page"),
        F.when(F.col("t.y") == 0, x).otherwise(x - 60).alias("x0"), F.when(F.col("t.y") == 0, x + 8).otherwise(x - 52).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    u = N.units(w).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("unit", "key"))).alias("u"))
    return u.select("doc", F.array_join(F.transform("u", lambda v: v["key"]), "|").alias("units"))


@query("block_moves")
def block_moves(spark, sf):
    return D.block_moves(D.exact_matches(_moved(_blocks(spark, sf))))


def _moved(b):
    """Every ninth block of the copy is read at the end: those are the moves."""
    late = (F.col("side") == "R") & (F.col("block") % 9 == 4)
    return b.withColumn("block", F.when(late, F.col("block") + 1_000_000).otherwise(F.col("block")))


@query("text_moves")
def text_moves(spark, sf):
    b = _moved(_blocks(spark, sf))
    fixed = D.monotone(D.exact_matches(b)).where("kept").select("pair_id", "l", "r")
    return D.text_moves(D.word_changes(_placed(b), fixed))


@query("section_changes")
def section_changes(spark, sf):
    b = _blocks(spark, sf)
    w = _placed(b)
    fixed = D.monotone(D.exact_matches(b)).where("kept").select("pair_id", "l", "r")
    spans = w.select("pair_id", "side", "block", F.col("pos").alias("start"), (F.col("pos") + F.size("keys")).alias("end"), F.lit(1).alias("lines"))
    c = D.sections(D.word_changes(w, fixed), spans)
    return c.groupBy("op").agg(F.count("*").alias("n"))


# A part's words between a changed first word and, on the generated side, a block of its own (three words).
@query("changes_cut_at_blocks", """
WITH p AS (SELECT p_partkey AS id, len(string_split(p_name, ' ')) AS n, p_partkey % 50 AS s FROM part)
SELECT id AS pair_id, 'cambiato' AS op, CAST(s AS BIGINT) AS i1, CAST(s + 1 AS BIGINT) AS i2, CAST(s AS BIGINT) AS j1, CAST(s + 1 AS BIGINT) AS j2, 'H' AS l, 'Y' AS r FROM p
UNION ALL SELECT id, 'in_piu', s + n + 1, s + n + 1, s + n + 1, s + n + 4, '', 'uno due tre' FROM p""")
def changes_cut_at_blocks(spark, sf):
    """A change that holds an unmatched block is split there; what is left of it keeps only the word that differs."""
    words, n, s = F.split("p_name", " "), F.size(F.split("p_name", " ")), (F.col("p_partkey") % 50).cast("bigint")
    c = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pair_id"), F.lit("cambiato").alias("op"), s.alias("i1"), (s + n + 1).alias("i2"), s.alias("j1"), (s + n + 4).alias("j2"),
        F.concat(F.array(F.lit("H")), words).alias("left_keys"), F.concat(F.array(F.lit("Y")), words, F.split(F.lit("uno due tre"), " ")).alias("right_keys"))
    blocks = c.select("pair_id", F.lit("R").alias("side"), (F.col("j2") - 3).alias("start"), F.col("j2").alias("end"))
    return _told(R.split_at_bounds(c, blocks))


def _told(changes):
    return changes.select("pair_id", "op", "i1", "i2", "j1", "j2", F.array_join("left_keys", " ").alias("l"), F.array_join("right_keys", " ").alias("r"))


@query("far_pieces_paired_again", """
WITH p AS (SELECT p_partkey AS id, p_name AS t, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part)
SELECT id AS pair_id, 'in_piu' AS op, CAST(0 AS BIGINT) AS i1, CAST(0 AS BIGINT) AS i2, CAST(0 AS BIGINT) AS j1, n AS j2, '' AS l, upper(t) AS r FROM p
UNION ALL SELECT id, 'in_piu', n, n, n * 2, n * 2 + 1, '', 'fine' FROM p""")
def far_pieces_paired_again(spark, sf):
    """Left: the name. Right: capitals on a page of their own, then the name and a word after it, a page further on."""
    words, n = F.split("p_name", " "), F.size(F.split("p_name", " ")).cast("bigint")
    right = F.concat(F.split(F.upper("p_name"), " "), words, F.array(F.lit("fine")))
    c = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pair_id"), F.lit("cambiato").alias("op"), F.lit(0).cast("bigint").alias("i1"), n.alias("i2"),
        F.lit(0).cast("bigint").alias("j1"), (2 * n + 1).alias("j2"), words.alias("left_keys"), right.alias("right_keys"), n.alias("n"))
    w = c.select("pair_id", "n", F.lit("L").alias("side"), F.posexplode("left_keys").alias("pos", "key")).unionByName(
        c.select("pair_id", "n", F.lit("R").alias("side"), F.posexplode("right_keys").alias("pos", "key")))
    x = F.col("pos") * 10.0
    w = w.select("pair_id", "side", F.col("pos").cast("bigint").alias("pos"), ((F.col("side") == "R") & (F.col("pos") >= F.col("n"))).cast("int").alias("page"),
                 x.alias("x0"), F.lit(50.0).alias("y0"), (x + 8).alias("x1"), F.lit(60.0).alias("y1"), F.lit("corpo").alias("zone"))
    return _told(R.spread_changes(c.drop("n"), w))


# Word changes with a known class and type: the part name against an edit of it.
TYPE = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'maiuscole' WHEN 1 THEN 'spazi' WHEN 2 THEN 'punteggiatura' WHEN 3 THEN 'numeri' WHEN 4 THEN 'parola' WHEN 5 THEN 'frase' WHEN 6 THEN 'altro' ELSE 'numeri' END AS tipo,
 CASE WHEN p_partkey % 8 = 1 THEN 'spaziatura' ELSE 'testo' END AS klass FROM part"""


@query("change_types", TYPE)
def change_types(spark, sf):
    m, n = F.col("p_partkey") % 8, F.col("p_name")
    right = (
        F.when(m == 0, F.upper(n)).when(m == 1, F.replace(n, F.lit(" "), F.lit(""))).when(m == 2, F.concat(n, F.lit(".")))
        .when(m == 3, F.concat(n, F.lit(" 12"))).when(m == 4, F.concat(n, F.lit(" zz"))).when(m == 5, F.concat(n, F.lit(" qq ww zz")))
        .when(m == 6, F.concat(n, F.lit(" §"))).otherwise(F.lit("")))
    left = F.when(m == 7, F.lit("1.234,56 €")).otherwise(n)
    d = table(spark, sf, "part").select("p_partkey", left.alias("left_text"), right.alias("right_text"))
    keys = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    op = F.when(F.col("right_text") == "", "mancante").otherwise("cambiato")
    d = d.withColumn("op", op).withColumn("klass", D.classify(op, keys(F.col("left_text")), keys(F.col("right_text"))))
    return D.with_type(d).select("p_partkey", "tipo", "klass")


@query("changed_characters", """
SELECT p_partkey, '0-'||CAST(strpos(p_name, ' ') - 1 AS VARCHAR) AS left_spans, '0-1' AS right_spans FROM part WHERE strpos(p_name, ' ') > 1""")
def changed_characters(spark, sf):
    d = table(spark, sf, "part").where(F.instr("p_name", " ") > 1)
    right = F.regexp_replace("p_name", r"^[^ ]+", "#")
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select("p_partkey", D.char_spans("p_name", right).alias("s")).select("p_partkey", show(F.col("s.left")).alias("left_spans"), show(F.col("s.right")).alias("right_spans"))


@query("token_spans", """
SELECT p_partkey, '0-'||CAST(CASE WHEN strpos(p_name, ' ') > 0 THEN strpos(p_name, ' ') - 1 ELSE length(p_name) END AS VARCHAR) AS spans FROM part""")
def token_spans(spark, sf):
    s = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(3).alias("end")))
    out = D.token_spans(F.col("p_name"), s)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


# Every line of a document is looked for in order: equal lines are found one after the other.
@query("located_lines", "WITH " + LINES + r"""
SELECT doc_id AS doc, CAST(line_no AS BIGINT) AS id, CAST(line_no AS INTEGER) AS line FROM ln WHERE len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) > 0""")
def located_lines(spark, sf):
    ln = _lines(spark, sf, together=True).where(F.size(F.filter(F.split("line", r"\s+"), lambda x: x != "")) > 0).select(
        F.col("doc_id").alias("doc"), F.lit("L").alias("side"), F.col("line_no").alias("line"), F.col("line").alias("text"))
    d = ln.select("doc", "side", F.col("line").alias("id"), "text", F.lit("").alias("before"), F.lit("").alias("after"))
    return S.located(d, ln).select("doc", "id", "line")


# A part's words, then its code, an amount and a date; the control prints the perturbed value of one of them, or prints it elsewhere.
@query("same_place_proofs", """
SELECT p_partkey AS id, CAST(len(string_split(p_name, ' ')) + CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS start, CAST(1 AS INTEGER) AS n
FROM part WHERE p_partkey % 4 <> 1""")
def same_place_proofs(spark, sf):
    k, name, m = F.col("p_partkey"), F.col("p_name"), F.col("p_partkey") % 4
    s = lambda head, c, tail="": F.concat(F.lit(head), c.cast("string"), F.lit(tail))
    keys = lambda *c: F.split(F.concat_ws(" ", *c), " ")
    date = F.lit("03/04/2026")
    left = keys(name, s("P", k), s("", k, ",50"), date)
    right = (F.when(m == 0, keys(name, s("Q", k), s("", k, ",50"), date)).when(m == 1, keys(F.lit("nuovo"), name, s("Q", k), s("", k, ",50"), date))
             .when(m == 2, keys(name, s("P", k), s("", k + 1, ",50"), date)).otherwise(keys(name, s("P", k), s("", k, ",50"), F.lit("05/06/2027."))))
    p = table(spark, sf, "part")
    d = p.select(k.alias("pair_id"), k.alias("id"), F.lit("cambiato").alias("op"), F.lit("testo").alias("klass"), left.alias("left_keys"), right.alias("right_keys"))
    was = F.when(m < 2, s("P", k)).when(m == 2, s("", k, ".5")).otherwise(F.lit("2026-04-03"))
    now = F.when(m < 2, s("Q", k)).when(m == 2, s("", k + 1, ".5")).otherwise(F.lit("2027-06-05"))
    c = p.select(k.alias("pair_id"), F.lit(1).alias("value_id"), was.alias("original"), now.alias("perturbed"))
    return Co.same_place_words(d, c).select("id", "start", "n")


# Every third word of a document as a change.
@query("display_contexts", "WITH " + LINES + r"""
, k AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS ws FROM ln),
b AS (SELECT doc_id, line_no, ws, lag(ws) OVER w AS pw, lead(ws) OVER w AS nw FROM k WHERE len(ws) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
u AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) - 1 AS pos FROM u)
SELECT doc_id AS pair_id, pos AS i1, coalesce(array_to_string(CASE WHEN i > 1 THEN ws[greatest(1, i - 5):i - 1] ELSE pw[greatest(1, len(pw) - 4):len(pw)] END, ' '), '') AS before,
  coalesce(array_to_string(CASE WHEN i < len(ws) THEN ws[i + 1:i + 5] ELSE nw[1:5] END, ' '), '') AS after FROM p WHERE pos % 3 = 0""")
def display_contexts(spark, sf):
    from pyspark.sql import Window

    k = _keys(spark, sf)
    block = F.coalesce(F.sum(F.coalesce("ends_line", F.lit(False)).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = k.select(F.col("doc_id").alias("pair_id"), F.lit("L").alias("side"), F.col("pos").cast("bigint").alias("pos"), F.col("key").alias("text"), block.alias("block"))
    c = w.where("pos % 3 = 0").select("pair_id", F.col("pos").alias("i1"), (F.col("pos") + 1).alias("i2"))
    return Co.display_context(c, w).select("pair_id", "i1", "before", "after")


@query("generated_texts", r"""
SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(replace(text, '`', chr(39)), '\s+'), lambda x: x <> ''), ' ') AS generated FROM conversations""")
def generated_texts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("right_text"))
    return Co.generated_texts(c, ["conv_id", "turn"]).select("conv_id", "turn", "generated")


@query("innermost_blocks", """
WITH n AS (SELECT l_orderkey AS doc, l_linenumber AS depth, l_linenumber * 10 AS st, l_linenumber * 10 + 25 AS en FROM lineitem GROUP BY 1, 2),
q AS (SELECT DISTINCT doc, st + 5 AS line FROM n)
SELECT q.doc, q.line, arg_max(n.depth, n.depth) AS node FROM q JOIN n ON n.doc = q.doc AND q.line >= n.st AND q.line < n.en GROUP BY 1, 2""")
def innermost_blocks(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("depth")).distinct()
    n = n.withColumn("start", F.col("depth") * 10).withColumn("end", F.col("depth") * 10 + 25).withColumn("node", F.col("depth"))
    return D.locate_blocks(n, n.select("doc", (F.col("start") + 5).alias("line")).distinct())
