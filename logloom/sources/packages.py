"""The package list: a ``;`` text file of template keys and the packages that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import NO_PACKAGE
from ..operators.ranking import first_spelling

# The header names and the columns used without them.
KEY_HEADER = "template key"
PACKAGE_HEADER = "package name"
KEY_COLUMN, PACKAGE_COLUMN = 0, 4
CONTROL = r"[\x00-\x1f\x7f]"


class PackageListError(ValueError):
    """The list cannot be used."""


def unique_packages(rows: DataFrame) -> DataFrame:
    """packages(template_key, package, ord): trimmed, keyless rows out, unique per (key ignoring case, package)."""
    key, package = F.trim("template_key"), F.trim(F.coalesce("package", F.lit("")))
    r = rows.select("ord", key.alias("template_key"), F.coalesce(F.nullif(package, F.lit("")), F.lit(NO_PACKAGE)).alias("package"))
    r = r.where(F.col("template_key") != "").withColumn("key_lc", F.lower("template_key"))
    return first_spelling(r, ["key_lc", "package"])


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: ``has_nul`` and ``is_utf8``, read before the text is parsed."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", F.decode("content", "ISO-8859-1").contains("\x00").alias("has_nul"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"))


def load_packages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packages, skipped count) of one list file; raises :class:`PackageListError` for an unusable one."""
    facts = file_facts(spark, path).first()
    if facts is None or facts["has_nul"]:
        raise PackageListError("Il file non sembra un elenco CSV (testo con le colonne separate da punto e virgola).")
    encoding = "UTF-8" if facts["is_utf8"] else "windows-1252"
    raw = (
        spark.read.option("sep", ";").option("multiLine", "true").option("encoding", encoding).option("quote", '"')
        .option("escape", '"').option("header", "false").csv(path)
    )
    if not raw.columns:
        raise PackageListError("L'elenco è vuoto.")
    # One list file is one partition, so the id is the file position.
    rows = raw.withColumn("ord", F.monotonically_increasing_id()).where(
        F.length(F.trim(F.concat_ws("", *raw.columns))) > 0)
    swallowed = F.lit(False)
    for c in raw.columns:
        swallowed = swallowed | (F.col(c).rlike(r"[\r\n]") & F.col(c).contains(";"))
    head = rows.orderBy("ord").first()
    if head is None:
        raise PackageListError("L'elenco è vuoto.")
    if rows.where(F.coalesce(swallowed, F.lit(False))).limit(1).count():
        raise PackageListError("Il file non sembra un elenco CSV: una virgoletta non chiusa unisce più righe in una cella. Correggilo e ricaricalo.")
    titles = [(head[c] or "").strip().lstrip("﻿").lower() for c in raw.columns]
    if KEY_HEADER in titles:
        if PACKAGE_HEADER not in titles:
            raise PackageListError('Nell\'elenco manca la colonna "package name".')
        k, p = raw.columns[titles.index(KEY_HEADER)], raw.columns[titles.index(PACKAGE_HEADER)]
        rows = rows.where(F.col("ord") != head["ord"])
    elif len(raw.columns) <= PACKAGE_COLUMN:
        raise PackageListError("L'elenco ha meno di 5 colonne: servono la template key (colonna 1) e il package name (colonna 5), oppure un'intestazione.")
    else:
        k, p = raw.columns[KEY_COLUMN], raw.columns[PACKAGE_COLUMN]
    rows = rows.select("ord", F.regexp_replace(F.coalesce(k, F.lit("")), "^﻿", "").alias("template_key"), F.col(p).alias("package"))
    bad = F.trim("template_key").rlike(CONTROL) | F.coalesce(F.trim("package").rlike(CONTROL), F.lit(False))
    if rows.where(bad).limit(1).count():
        raise PackageListError("Il file non sembra un elenco CSV (testo con le colonne separate da punto e virgola).")
    skipped = rows.agg(F.count_if(F.trim("template_key") == "").alias("skipped"))
    return unique_packages(rows), skipped
