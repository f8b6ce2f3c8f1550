"""Document versions on disk, the extraction cache and delivery plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

VERSION_PATH = r"([^/]+)/(target|asis|tobe)(?:-(\d+))?\.(pdf|html|meta\.json)$"


def read_versions(files: DataFrame) -> DataFrame:
    """versions(case, kind, number, doc_type, has_content, has_meta, size): metadata or content makes a version."""
    p = F.col("path")
    f = files.where(p.rlike(VERSION_PATH)).select(
        F.regexp_extract(p, VERSION_PATH, 1).alias("case"), F.regexp_extract(p, VERSION_PATH, 2).alias("kind"),
        F.coalesce(F.regexp_extract(p, VERSION_PATH, 3).try_cast("int"), F.lit(0)).alias("number"),
        F.regexp_extract(p, VERSION_PATH, 4).alias("ext"), "size", "mtime")
    meta = F.col("ext") == "meta.json"
    g = f.groupBy("case", "kind", "number").agg(
        F.max(F.when(~meta, F.col("ext"))).alias("doc_type"), F.bool_or(~meta).alias("has_content"), F.bool_or(meta).alias("has_meta"),
        F.max(F.when(~meta, F.col("size"))).alias("size"), F.max("mtime").alias("created"))
    return g.withColumn("missing", ~F.col("has_content")).withColumn("broken", F.col("has_content") & (F.coalesce("size", F.lit(0)) == 0))


def next_numbers(versions: DataFrame) -> DataFrame:
    return versions.groupBy("case").agg(
        (F.coalesce(F.max(F.when(F.col("kind") == "tobe", F.col("number"))), F.lit(0)) + 1).alias("next_number"))


def cache_misses(documents: DataFrame, extracted: DataFrame, fmt: int) -> DataFrame:
    """Documents whose content (by SHA-256) has no extraction of this format yet; each content once."""
    d = documents.withColumn("sha", F.sha2("content", 256))
    have = extracted.where(F.col("format") == fmt).select("sha").distinct()
    return d.dropDuplicates(["sha"]).join(have, "sha", "left_anti")


def delivery_plan(cases: DataFrame, versions: DataFrame) -> DataFrame:
    """(case, slot, file_name, reason): target, AS-IS and the latest TO-BE of each case.

    The variant joins the name only where several cases share the key; a slot that cannot be
    delivered has a reason.
    """
    shared = cases.groupBy(F.lower("key").alias("_k")).agg(F.count("*").alias("_n"))
    last = versions.where(F.col("kind") == "tobe").groupBy("case").agg(F.max("number").alias("number"))
    v = versions.where(F.col("kind") != "tobe").unionByName(versions.join(last, ["case", "number"], "left_semi").where(F.col("kind") == "tobe"))
    slots = cases.withColumn("_k", F.lower("key")).join(shared, "_k").withColumn("slot", F.explode(F.array(*[F.lit(s) for s in ("target", "asis", "tobe")])))
    j = slots.join(v.withColumnRenamed("kind", "slot"), ["case", "slot"], "left")
    stem = F.when(F.col("slot") == "target", "atteso").when(F.col("slot") == "asis", "as-is").otherwise("to-be")
    suffix = F.when((F.col("_n") > 1) & (F.col("variant") != ""), F.concat(F.lit(" ("), F.col("variant"), F.lit(")"))).otherwise("")
    reason = F.when(F.col("number").isNull(), "assente").when(F.col("missing"), "sparito").when(F.col("broken"), "illeggibile")
    name = names.safe_component(F.concat(stem, suffix, F.lit("."), F.col("doc_type")))
    return j.select("case", "key", "slot", F.when(reason.isNull(), name).alias("file_name"), reason.alias("reason"))


def delivery_conflicts(plan: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """Planned paths that already exist (case-insensitive)."""
    p = plan.where(F.col("file_name").isNotNull()).withColumn(
        "path", F.concat_ws("/", F.lit(folder), names.safe_component("key"), "file_name"))
    return p.withColumn("_p", F.lower("path")).join(existing.select(F.lower("path").alias("_p")).distinct(), "_p", "left_semi").drop("_p")
