"""Daily request logs: listing, byte-exact scan, body reads.

A day file alternates a header line ``### <name>.json`` with one JSON body line. Everything is
computed on the ISO-8859-1 view of the bytes, where one character is one byte, so offsets
survive accents and broken UTF-8. Bodies are reduced to their facts inside the task that reads
the file; only the narrow per-line facts are shuffled to pair headers with bodies.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from ..functions.core import ascii_lower

# The shapes of a header line and of the fast request date.
HEADER = r"^### (.+?)\.json[ \t]*\r?$"
REQUEST_DATE = r'"requestDate":"([^"]*)"'
BLANKS = " \t\r\n"
SNIFF_BYTES = 65536
CANONICAL = r"([^/]+)/(\d{4})/(\d{2})/(\d{8})\.txt$"

ENTRY_COLUMNS = (
    "env", "day", "seq", "name", "name_bytes", "fdi", "template_key", "template_key_ci", "call_id",
    "well_formed", "header_offset", "header_len", "body_offset", "body_len", "request_date",
    "request_ts", "ndocs", "dossier_id", "dossier_number", "doc_keys", "json_ok",
)


def read_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Every file under ``root``, or of a list (path, modificationTime, length, content), 0-byte files included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _with_empty(files.withColumn("path", _plain_path(F.col("path"))), files)


def _with_empty(rows: DataFrame, source: DataFrame) -> DataFrame:
    """The file reader skips 0-byte files; the file index it lists anyway still names them.

    A quiet day is a 0-byte file, so the names the rows lack come back with no content and no
    time. Only names travel: one per file, the size of the listing itself.
    """
    names_ = source.sparkSession.createDataFrame([(unquote(p),) for p in source.inputFiles()], "path string")
    names_ = names_.select(_plain_path(F.col("path")).alias("path"))
    missing = names_.join(rows.select("path"), "path", "left_anti")
    empty = {"length": F.lit(0).cast("bigint"), "content": F.lit(b"").cast("binary")}
    return rows.unionByName(missing.select("path", *[
        empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields if f.name != "path"]))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")


def with_day_columns(files: DataFrame) -> DataFrame:
    """Keep canonical day files only and add ``env``, ``day``, ``rel_path``."""
    p = _plain_path(F.col("path"))
    env, year, month, stem = (F.regexp_extract(p, CANONICAL, i) for i in range(1, 5))
    day = F.try_to_date(stem, "yyyyMMdd")
    return (
        files.where(p.rlike(CANONICAL))
        .withColumn("env", env)
        .withColumn("day", day)
        .where(day.isNotNull() & (F.date_format(day, "yyyy") == year) & (F.date_format(day, "MM") == month))
        .withColumn("rel_path", paths.relative_path("env", "day"))
    )


def list_days(spark: SparkSession, root: str, env: str | None = None) -> DataFrame:
    """files(env, day, rel_path, path, size, mtime): metadata only, no bytes are read."""
    glob = f"{root.rstrip('/')}/{env or '*'}/*/*"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(glob)
        .select(_plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("mtime"))
    )
    files = _with_empty(files, files).withColumnRenamed("length", "size")
    out = with_day_columns(files).select("env", "day", "rel_path", "path", "size", "mtime")
    return out.where(~F.col("env").startswith("."))


def count_days(spark: SparkSession, root: str) -> DataFrame:
    return list_days(spark, root).agg(F.count("*").alias("n_files"))


def utf8_text(latin1: Column) -> Column:
    """Text of a one-character-per-byte string; bad bytes become U+FFFD."""
    return F.make_valid_utf8(F.encode(latin1, "ISO-8859-1").cast("string"))


def with_body_facts(df: DataFrame, body: Column, valid: Column | None = None, out: str = "facts") -> DataFrame:
    """Adds STRUCT ``facts`` of what one JSON body says.

    The body is parsed in a projection of its own, once per row, and every fact is read from
    the parsed value. Bad or non-object JSON falls back to the regex date.
    """
    parsed = F.try_parse_json(body)
    v = F.col("_v")
    staged = df.withColumn("_v", parsed if valid is None else F.when(valid, parsed))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    # Leaves are read as variants first: only a string leaf counts as text.
    staged = staged.select(
        "*", is_object.alias("_obj"),
        F.coalesce(F.try_variant_get(v, "$.documents", "array<variant>"), F.array().cast("array<variant>")).alias("_docs"),
        *[F.try_variant_get(v, f"$.dossier.{n}", "variant").alias(f"_{n}") for n in ("requestDate", "id", "number")],
    )

    def text_of(leaf: Column) -> Column:
        return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(leaf, "$", "string"))

    keys = F.array_compact(F.transform("_docs", lambda d: text_of(F.try_variant_get(d, "$.template.templateKey", "variant"))))
    fast = F.when(body.rlike(REQUEST_DATE), F.regexp_extract(body, REQUEST_DATE, 1))
    obj = F.col("_obj")
    facts = F.struct(
        F.when(obj, text_of(F.col("_requestDate"))).otherwise(fast).alias("request_date"),
        F.when(obj, F.size("_docs")).alias("ndocs"),
        F.when(obj, text_of(F.col("_id"))).alias("dossier_id"),
        F.when(obj, text_of(F.col("_number"))).alias("dossier_number"),
        F.when(obj, keys).otherwise(F.array().cast("array<string>")).alias("doc_keys"),
        obj.alias("json_ok"),
    )
    return staged.withColumn(out, facts).drop("_v", "_obj", "_docs", "_requestDate", "_id", "_number")


def fast_facts(body: Column) -> Column:
    """The request date alone, by regex: no JSON is parsed."""
    return F.struct(
        F.when(body.rlike(REQUEST_DATE), F.regexp_extract(body, REQUEST_DATE, 1)).alias("request_date"),
        F.lit(None).cast("int").alias("ndocs"),
        F.lit(None).cast("string").alias("dossier_id"),
        F.lit(None).cast("string").alias("dossier_number"),
        F.array().cast("array<string>").alias("doc_keys"),
        F.lit(False).alias("json_ok"),
    )


def scan_lines(files: DataFrame, parse_json: bool = True) -> DataFrame:
    """One narrow row per non-blank line: kind, offset, length, header name and body facts.

    ``files`` needs (path, content) and any key columns. The window is over one file, which the
    reader already bounds to one row.
    """
    keys = [c for c in files.columns if c not in ("content", "modificationTime", "length")]
    text = F.decode("content", "ISO-8859-1")
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    bom = (F.col("line_no") == 0) & F.col("line").startswith("ï»¿")
    line = F.when(bom, F.substring("line", 4, 1 << 30)).otherwise(F.col("line"))
    lines = lines.select(
        *keys, "line_no", (F.length("line") + 1).alias("span"),
        F.when(bom, F.lit(3)).otherwise(0).alias("skip"), line.alias("line"),
    )
    header = F.col("line").rlike(HEADER)
    blank = ~F.col("line").rlike(r"[^ \t\r\n]")
    lines = lines.select(
        *keys, "line_no", "span", "skip", blank.alias("blank"), header.alias("is_header"),
        F.length(F.regexp_replace("line", r"\r+$", "")).alias("len"),
        F.when(header, F.regexp_extract("line", HEADER, 1)).alias("header_name"),
        F.when(~header & ~blank, F.encode(F.regexp_replace("line", r"\r+$", ""), "ISO-8859-1").cast("string")).alias("raw"),
    )
    text_ = F.make_valid_utf8("raw")
    if parse_json:
        lines = with_body_facts(lines, text_, F.is_valid_utf8("raw"))
    else:
        lines = lines.withColumn("facts", fast_facts(text_))
    lines = lines.drop("raw")
    w = Window.partitionBy("path").orderBy("line_no")
    start = F.sum("span").over(w) - F.col("span") + F.col("skip")
    return lines.withColumn("offset", start.cast("bigint")).where(~F.col("blank")).drop("span", "skip", "blank")


def pair_lines(lines: DataFrame) -> DataFrame:
    """Mark each line: ``entry`` (a body right after a header), ``orphan`` or ``head`` (paired header)."""
    w = Window.partitionBy("path").orderBy("line_no")
    prev_header = F.coalesce(F.lag("is_header").over(w), F.lit(False))
    next_header = F.lead("is_header").over(w)
    role = (
        F.when(F.col("is_header") & F.coalesce(~next_header, F.lit(False)), "head")
        .when(~F.col("is_header") & prev_header, "entry")
        .otherwise("orphan")
    )
    return (
        lines.withColumn("role", role)
        .withColumn("h_name", F.lag("header_name").over(w))
        .withColumn("h_offset", F.lag("offset").over(w))
        .withColumn("h_len", F.lag("len").over(w))
    )


def scan_entries(files: DataFrame, parse_json: bool = True) -> DataFrame:
    """The ``entries`` table of day files (needs env, day, path, content)."""
    p = pair_lines(scan_lines(files, parse_json)).where(F.col("role") == "entry")
    w = Window.partitionBy("path").orderBy("line_no")
    name = utf8_text(F.col("h_name"))
    n = F.col("n")
    return (
        p.withColumn("seq", F.row_number().over(w) - 1)
        .withColumn("n", names.entry_name(name))
        .select(
            "env", "day", "seq", n["raw"].alias("name"),
            F.encode(F.col("h_name"), "ISO-8859-1").alias("name_bytes"),
            F.nullif(n["fdi"], F.lit("")).alias("fdi"), n["template_key"].alias("template_key"),
            ascii_lower(n["template_key"]).alias("template_key_ci"), n["call_id"].alias("call_id"),
            n["well_formed"].alias("well_formed"),
            F.col("h_offset").alias("header_offset"), F.col("h_len").alias("header_len"),
            F.col("offset").alias("body_offset"), F.col("len").alias("body_len"),
            "facts.request_date",
            F.col("facts.request_date").try_cast("timestamp").alias("request_ts"),
            "facts.ndocs", "facts.dossier_id", "facts.dossier_number", "facts.doc_keys", "facts.json_ok",
        )
    )


def scan_stats(files: DataFrame) -> DataFrame:
    """Entries and orphans per file."""
    keys = [c for c in files.columns if c in ("env", "day", "path")]
    lines = pair_lines(scan_lines(files, parse_json=False))
    found = lines.groupBy("path").agg(
        F.count_if(F.col("role") == "entry").alias("n_entries"),
        F.count_if(F.col("role") == "orphan").alias("n_orphans"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        files.select(*keys).join(found, "path", "left")
        .withColumn("n_entries", F.coalesce("n_entries", zero))
        .withColumn("n_orphans", F.coalesce("n_orphans", zero))
    )


def looks_like_log(content: Column) -> Column:
    """The first non-blank line of the first 64 KiB is a header."""
    head = F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1")
    head = F.regexp_replace(head, "^ï»¿", "")
    first = F.get(F.filter(F.split(head, "\n"), lambda s: s.rlike(r"[^ \t\r\n]")), F.lit(0))
    return F.coalesce(first.rlike(HEADER), F.lit(False))


def read_bodies(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Exact body bytes of the hits with a ``stale`` flag; one join on (env, day).

    ``files`` holds (env, day, content). Only the days the hits name are read: the hits side is
    reduced to its days first, so the file side is filtered before its bytes are decoded.
    """
    days = hits.select("env", "day").distinct()
    bytes_ = files.select("env", "day", "content").join(days, ["env", "day"], "left_semi")
    j = hits.join(bytes_, ["env", "day"], "left")
    h_end = F.col("header_offset") + F.col("header_len")
    expected = F.rtrim(F.concat(F.lit("### "), F.decode("name_bytes", "ISO-8859-1"), F.lit(".json")), F.lit(BLANKS))

    def cut(start: Column, n: Column) -> Column:
        return F.decode(F.substring(F.col("content"), (start + 1).cast("int"), n.cast("int")), "ISO-8859-1")

    head = F.substring_index(cut(F.col("header_offset"), F.col("header_len") + 8), "\n", 1)
    gap = cut(h_end, F.col("body_offset") - h_end)
    body = cut(F.col("body_offset"), F.col("body_len"))
    trailer = cut(F.col("body_offset") + F.col("body_len"), F.lit(1))
    ok = (
        F.col("content").isNotNull()
        & (F.rtrim(head, F.lit(BLANKS)) == expected)
        & ~gap.rlike(r"[^ \t\r\n]")
        & (gap.contains("\n"))
        & (F.length(body) == F.col("body_len"))
        & trailer.isin("", "\r", "\n")
        & ~body.contains("\n")
        & ~body.endswith("\r")
    )
    stale = ~F.coalesce(ok, F.lit(False))
    return (
        j.withColumn("stale", stale)
        .withColumn("body", F.when(~stale, F.encode(body, "ISO-8859-1")))
        .drop("content")
    )


def read_bodies_healing(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Read bodies; days found stale are rescanned and their hits found again, once.

    The same entry is the one with the same (name, seq), or the same name when it is the only
    one of its day.
    """
    extra = [c for c in hits.columns if c not in ("header_offset", "header_len", "body_offset", "body_len", "seq")]
    first = read_bodies(hits, files)
    good = first.where(~F.col("stale"))
    bad = first.where("stale").drop("stale", "body")
    stale_days = bad.select("env", "day").distinct()
    todo = files.join(stale_days, ["env", "day"], "left_semi")
    fresh = scan_entries(todo, parse_json=False).select(
        "env", "day", F.col("name_bytes").alias("f_name"), F.col("seq").alias("f_seq"),
        F.struct("header_offset", "header_len", "body_offset", "body_len", "seq").alias("at"),
    )
    per_name = fresh.groupBy("env", "day", "f_name").agg(
        F.count("*").alias("n"), F.min_by("at", "f_seq").alias("only"))
    j = (
        bad.alias("b")
        .join(fresh.alias("x"), (F.col("b.env") == F.col("x.env")) & (F.col("b.day") == F.col("x.day"))
              & (F.col("b.name_bytes") == F.col("x.f_name")) & (F.col("b.seq") == F.col("x.f_seq")), "left")
        .join(per_name.alias("p"), (F.col("b.env") == F.col("p.env")) & (F.col("b.day") == F.col("p.day"))
              & (F.col("b.name_bytes") == F.col("p.f_name")), "left")
        .withColumn("_at", F.coalesce(F.col("x.at"), F.when(F.col("p.n") == 1, F.col("p.only"))))
        .select(*[F.col(f"b.{c}") for c in extra], "_at.*")
    )
    again = read_bodies(j.where(F.col("seq").isNotNull()), files)
    lost = j.where(F.col("seq").isNull()).withColumn("stale", F.lit(True)).withColumn(
        "body", F.lit(None).cast("binary"))
    return good.unionByName(again).unionByName(lost)
