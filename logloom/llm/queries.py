"""The registered queries of the training-data operators and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (hard_negatives, html_main, jaccard_join, merkle, mixing, nn_descent, packing, pieces, pii, quality,
               recurrent_lm, secrets, warc)
from .common import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base verdict and the forest's."""
    scratch = Scratch(spark, "op3")
    stats = scratch.write(quality.rule_statistics(_table(spark, sf_dir, "documents")), "stats")
    forest, threshold = quality.train(stats, _table(spark, sf_dir, "labels"))
    return quality.verdicts(stats, forest, threshold).select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")

@_query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.digest(secrets.find(_table(spark, sf_dir, "documents")))


@_query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


@_query("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op9")))


@_query("op8_retrieval_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


@_query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(_table(spark, sf_dir, "pages"))


@_query("op4_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM m""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    return warc.read(warc.write(_table(spark, sf_dir, "pages"), Scratch(spark, "op4")))


@_query("op10_jaccard_join", r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
      FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
    r AS (SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


@_query("op7_embedding_near_dedup", """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    l AS (
      SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
    c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
    SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN c ON c.x = e.vec_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))[0]


@_query("op5_recurrent_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and network log probabilities of every document."""
    return recurrent_lm.score(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@_query("op11_merkle_manifest", f"""
    WITH RECURSIVE bits(i, k, v) AS (
      SELECT i, 0, i FROM range(256) t(i) UNION ALL
      SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc(doc_id, s, p, c) AS (
      SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents UNION ALL
      SELECT doc_id, s, p + 1, xor(c >> 8, v) FROM crc JOIN bits ON k = 8 AND i = xor(c, ascii(substr(s, p + 1, 1))) & 255
      WHERE p < length(s)),
    hit AS (SELECT doc_id FROM crc WHERE p = length(s) AND xor(c, 4294967295) % 3 = 0),
    x AS (
      SELECT d.doc_id, coalesce(':' || lang, '') AS g, h.doc_id IS NOT NULL AS hit,
        coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') AS low
      FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id),
    n AS (
      SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
      FROM (SELECT doc_id, g, sha256(head || tail) AS leaf, sha256(head || CASE WHEN hit THEN low ELSE tail END) AS now FROM x)),
    up(g, lvl, nodes) AS (
      SELECT g, 0, list(leaf ORDER BY pos) FROM n GROUP BY g UNION ALL
      SELECT g, lvl + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))
      FROM up WHERE len(nodes) > 1),
    sub AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM up WHERE len(nodes) = 1),
    top(lvl, nodes) AS (
      SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL
      SELECT lvl + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))
      FROM top WHERE len(nodes) > 1),
    walk(doc_id, g, leaf, first, lvl, pos, proof, x) AS (
      SELECT doc_id, g, leaf, pos, 0, pos, '', now FROM n UNION ALL
      SELECT doc_id, w.g, leaf, first, w.lvl + 1, pos // 8,
        proof || array_to_string(nodes[pos // 8 * 8 + 1:pos], '') || array_to_string(nodes[pos + 2:pos // 8 * 8 + 8], ''),
        sha256(array_to_string(nodes[pos // 8 * 8 + 1:pos], '') || x || array_to_string(nodes[pos + 2:pos // 8 * 8 + 8], ''))
      FROM walk w JOIN up ON up.g = w.g AND up.lvl = w.lvl AND len(nodes) > 1),
    climb(doc_id, leaf, g, lvl, pos, proof, x) AS (
      SELECT doc_id, leaf, g, 0, place, proof, x
      FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY g, first ORDER BY lvl DESC) = 1) JOIN sub USING (g) UNION ALL
      SELECT doc_id, leaf, g, c.lvl + 1, pos // 8,
        proof || array_to_string(nodes[pos // 8 * 8 + 1:pos], '') || array_to_string(nodes[pos + 2:pos // 8 * 8 + 8], ''),
        sha256(array_to_string(nodes[pos // 8 * 8 + 1:pos], '') || x || array_to_string(nodes[pos + 2:pos // 8 * 8 + 8], ''))
      FROM climb c JOIN top ON top.lvl = c.lvl AND len(nodes) > 1),
    r AS (SELECT lvl AS height, nodes[1] AS root FROM top WHERE len(nodes) = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
    FROM climb JOIN r ON lvl = height JOIN sub USING (g)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document; a third of the texts lose their capitals before the check."""
    low = F.translate("text", UPPER, LOWER)
    return merkle.manifest(
        _table(spark, sf_dir, "documents"), Scratch(spark, "op11"), ["doc_id", "source", "lang", "n_chars", "text"],
        [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), low],
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


@_query("op12_hard_negatives", """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT p.anchor_id, p.other AS positive_id,
      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
      n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
      AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels moved on by one."""
    e = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(e.withColumn("label", moved).withColumn("anchor", F.col("vec_id") % 100 == 0), Scratch(spark, "op12"))


@_query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that comes back from them."""
    Scratch(spark, "op13")  # texts go to Python in small batches
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return pieces.digest(pieces.decode(encoded))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
