"""Archive discovery: find day files anywhere, classify them, resolve copies, plan the import."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import daily_log
from .ranking import top_per_group

# Statuses and reasons of a found file.
STATUSES = ("importable", "duplicate_same", "needs_env", "conflict", "ignored")
R_NEW = "giorno mancante in archivio"
R_EMPTY = "giorno senza chiamate"
R_MORE_COMPLETE = "più completo della copia in archivio"
R_SAME = "già in archivio"
R_ARCHIVE_BIGGER = "l'archivio ha già una copia più completa"
R_CONFLICT = "copie diverse dello stesso giorno"
R_NEEDS_ENV = "ambiente non riconoscibile dal percorso"
R_COMPRESSED = "archivio compresso: estrailo nella cartella"
R_NOT_A_LOG = "non è un log di chiamate"
R_IGNORED_FOLDER = "cartella da ignorare"
R_EMPTY_UNNAMED = "file vuoto: vale come giorno senza chiamate solo se è un .txt con la data nel nome"
COMPRESSED = r"(?i)[^/]\.(zip|gz|7z|rar|tgz)$"
SKIPPED_DIRS = ("$recycle.bin", "system volume information")
APP_FILE = r"(?i)(\.part|\.remote-\d+)$"


def walk(files: DataFrame, root: str) -> DataFrame:
    """Files under ``root`` with ``rel_path``; dot folders, recycle bins and the app's own files out."""
    p = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    rel = F.substr(p, F.lit(len(root.rstrip("/")) + 2))
    dirs = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    skip = F.exists(dirs, lambda d: d.startswith(".") | F.lower(d).isin(*SKIPPED_DIRS))
    return (
        files.withColumn("rel_path", rel)
        .where(~skip & ~F.col("rel_path").rlike(APP_FILE))
    )


def is_canonical(rel_path: Column) -> Column:
    """``<env>/YYYY/MM/YYYYMMDD.txt`` relative to the archive root."""
    p = r"^[^/]+/(\d{4})/(\d{2})/(\d{8})\.txt$"
    day = F.try_to_date(F.regexp_extract(rel_path, p, 3), "yyyyMMdd")
    return F.coalesce(
        rel_path.rlike(p) & (F.date_format(day, "yyyy") == F.regexp_extract(rel_path, p, 1))
        & (F.date_format(day, "MM") == F.regexp_extract(rel_path, p, 2)), F.lit(False))


def classify(found: DataFrame, env_names: Sequence[str], today: dt.date | Column,
             folder_envs: Mapping[str, str] | None = None, root: str = "") -> DataFrame:
    """Adds env, day, status, reason (before copies are resolved).

    Needs (rel_path, size, is_log); ``is_log`` comes from the first 64 KiB of the content.
    """
    t = today if isinstance(today, Column) else F.lit(today)
    rel = F.col("rel_path")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    parts = F.reverse(F.split(rel, "/"))
    parts = F.concat(parts, F.array(F.lit(base))) if base else parts
    name = F.substring_index(rel, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1))
    choice = paths.folder_choice(rel, folder_envs or {}, env_names, root)
    df = found.withColumn("_choice", choice).withColumn("_d", paths.path_day(parts, t))
    env = F.coalesce(F.col("_choice"), paths.path_env(parts, env_names))
    if len(env_names) == 1:
        env = F.coalesce(env, F.lit(env_names[0]))
    day = F.col("_d.day")
    empty_bad = (F.col("size") == 0) & (~suffix.isin("", ".txt") | (F.size(paths.element_dates(name, t)) == 0))
    ignored = F.coalesce(F.col("_choice") == paths.IGNORE_FOLDER, F.lit(False))
    reason = (
        F.when(rel.rlike(COMPRESSED), R_COMPRESSED).when(ignored, R_IGNORED_FOLDER)
        .when((F.col("size") > 0) & ~F.col("is_log"), R_NOT_A_LOG)
        .when(day.isNull(), F.col("_d.reason")).when(empty_bad, R_EMPTY_UNNAMED)
        .when(env.isNull(), R_NEEDS_ENV).otherwise(R_NEW)
    )
    df = df.withColumn("env", env).withColumn("reason", reason)
    early = F.col("reason").isin(R_COMPRESSED, R_IGNORED_FOLDER, R_NOT_A_LOG)
    status = (
        F.when(F.col("reason") == R_NEW, "importable").when(F.col("reason") == R_NEEDS_ENV, "needs_env")
        .otherwise("ignored")
    )
    return (
        df.withColumn("status", status)
        .withColumn("day", F.when(~early, day))
        .withColumn("env", F.when(F.col("status") == "importable", F.col("env")))
        .drop("_choice", "_d", "is_log")
    )


def byte_relation(a: Column, b: Column) -> Column:
    """``same``, ``a_prefix``, ``b_prefix`` or ``diverge`` of two contents in one row."""
    la, lb = F.length(a), F.length(b)
    n = F.least(la, lb)
    return (
        F.when(F.substring(a, F.lit(1), n) != F.substring(b, F.lit(1), n), "diverge")
        .when(la == lb, "same").when(la < lb, "a_prefix").otherwise("b_prefix")
    )


def prefix_digests(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, size, prefix_sha) for each wanted (path, size): only digests are shuffled onward."""
    return (
        wanted.select("path", "size").distinct().join(contents.select("path", "content"), "path")
        .select("path", "size", F.sha2(F.substring(F.col("content"), F.lit(1), F.col("size").cast("int")), 256).alias("prefix_sha"))
    )


def resolve_copies(found: DataFrame, contents: DataFrame, archive: DataFrame | None = None,
                   archive_contents: DataFrame | None = None) -> DataFrame:
    """Copies of the same (env, day): the largest leads, the rest must be prefixes of it.

    Files are compared by SHA-256 of equal-length prefixes. Contents never travel: each file
    sends its digest, and each leader its digest at the sizes of the other copies, so a day
    with very many copies costs one digest row per copy.
    """
    work = found.where(F.col("status") == "importable")
    rest = found.where(F.col("status") != "importable")
    sha = contents.select("path", F.sha2("content", 256).alias("sha"))
    work = work.join(sha, "path")
    lead = top_per_group(work, ["env", "day"], [F.desc("size"), F.asc("rel_path")]).select(
        "env", "day", F.col("path").alias("lead_path"), F.col("rel_path").alias("lead_rel"),
        F.col("size").alias("lead_size"), F.col("sha").alias("lead_sha"))
    sizes = work.groupBy("env", "day", "size").agg(F.count("*").alias("_n")).drop("_n")
    wanted = sizes.join(lead.select("env", "day", F.col("lead_path").alias("path")), ["env", "day"])
    digests = wanted.join(prefix_digests(wanted, contents), ["path", "size"]).select("env", "day", "size", "prefix_sha")
    j = work.join(lead, ["env", "day"]).join(digests, ["env", "day", "size"])
    diverges = j.where(F.col("sha") != F.col("prefix_sha")).select("env", "day").distinct().withColumn("_div", F.lit(True))
    if archive is not None:
        a = archive.select("env", "day", F.col("path").alias("a_path"), F.col("size").alias("a_size"))
        la = lead.join(a, ["env", "day"])
        n = F.least("lead_size", "a_size")
        left = prefix_digests(la.select(F.col("lead_path").alias("path"), n.alias("size")), contents)
        right = prefix_digests(la.select(F.col("a_path").alias("path"), n.alias("size")), archive_contents)
        la = la.withColumn("n", n)
        la = (
            la.join(left.select(F.col("path").alias("lead_path"), F.col("size").alias("n"), F.col("prefix_sha").alias("l_sha")),
                    ["lead_path", "n"])
            .join(right.select(F.col("path").alias("a_path"), F.col("size").alias("n"), F.col("prefix_sha").alias("r_sha")),
                  ["a_path", "n"])
        )
        verdict = (
            F.when(F.col("l_sha") != F.col("r_sha"), "diverge").when(F.col("lead_size") == F.col("a_size"), "same")
            .when(F.col("lead_size") < F.col("a_size"), "a_prefix").otherwise("b_prefix"))
        against = la.select("env", "day", verdict.alias("_arch"))
    else:
        against = lead.select("env", "day").withColumn("_arch", F.lit(None).cast("string"))
    j = j.join(diverges, ["env", "day"], "left").join(against, ["env", "day"], "left")
    arch = F.col("_arch")
    conflict = F.coalesce("_div", F.lit(False)) | F.coalesce(arch == "diverge", F.lit(False))
    is_lead = F.col("path") == F.col("lead_path")
    lead_status = F.when(arch.isin("same", "a_prefix"), "duplicate_same").otherwise("importable")
    lead_reason = (
        F.when(arch == "same", R_SAME).when(arch == "a_prefix", R_ARCHIVE_BIGGER).when(arch == "b_prefix", R_MORE_COMPLETE)
        .when(F.col("size") == 0, R_EMPTY).otherwise(R_NEW))
    out = j.withColumn(
        "status", F.when(conflict, "conflict").when(is_lead, lead_status).otherwise("duplicate_same")
    ).withColumn(
        "reason",
        F.when(conflict, R_CONFLICT).when(is_lead, lead_reason)
        .when(lead_status == "duplicate_same", R_SAME).otherwise(F.concat(F.lit("contenuto già in "), F.col("lead_rel"))),
    )
    return out.select(*found.columns).unionByName(rest)


def discover(files: DataFrame, root: str, env_names: Sequence[str], today: dt.date,
             folder_envs: Mapping[str, str] | None = None, archive_root: str | None = None,
             archive_files: DataFrame | None = None) -> DataFrame:
    """found_logs of a folder: walk, classify, resolve copies, destination; sorted by path."""
    walked = walk(files, root)
    if archive_root is not None:
        p = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
        inside = p.startswith(archive_root.rstrip("/") + "/") & is_canonical(
            F.substr(p, F.lit(len(archive_root.rstrip("/")) + 2)))
        walked = walked.where(~inside)
    narrow = walked.select(
        "path", "rel_path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        daily_log.looks_like_log(F.col("content")).alias("is_log"))
    found = classify(narrow, env_names, today, folder_envs, root)
    archive = None
    if archive_files is not None:
        archive = daily_log.with_day_columns(archive_files).select("env", "day", "path", F.col("length").alias("size"))
    out = resolve_copies(found, files.select("path", "content"), archive,
                         archive_files.select("path", "content") if archive_files is not None else None)
    dest = paths.local_path(archive_root, "env", "day") if archive_root else F.lit(None).cast("string")
    return out.withColumn("dest", F.when(F.col("env").isNotNull() & F.col("day").isNotNull(), dest)).orderBy("rel_path")


def report_counts(found: DataFrame) -> DataFrame:
    """One row of counts, zero included."""
    return found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def needs_env_dirs(found: DataFrame) -> DataFrame:
    folder = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    return found.where(F.col("status") == "needs_env").select(folder.alias("rel_dir")).distinct().orderBy("rel_dir")


def stray_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("status").isin("importable", "needs_env")).alias("stray"))


def import_outcome(found: DataFrame, now_files: DataFrame, written: DataFrame) -> DataFrame:
    """Outcome per importable or duplicate file after the copy.

    ``now_files`` (path, now_size, now_mtime) is the source as it is now; ``written`` (dest,
    dest_size, dest_sha, prefix_sha) what the archive holds, with the digest of its prefix as
    long as the source. A source changed since the analysis is an error.
    """
    j = found.where(F.col("status").isin("importable", "duplicate_same", "conflict")).join(now_files, "path", "left").join(
        written, "dest", "left")
    same_source = (F.col("now_size") == F.col("size")) & (F.col("now_mtime") == F.col("mtime"))
    contained = (F.col("dest_size") >= F.col("size")) & (F.col("prefix_sha") == F.col("sha"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = (
        F.when(F.col("status") == "conflict", "conflict").when(~yes(same_source), "error")
        .when((F.col("status") == "importable") & yes(contained), "copied")
        .when(yes(contained), "skipped")
        .when(F.col("status") == "importable", "conflict").otherwise("error"))
    return j.withColumn("outcome", outcome).withColumn("verified", F.col("outcome").isin("copied", "skipped"))


def import_counts(outcomes: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o == "copied").alias("copied"), F.count_if(o == "skipped").alias("skipped"),
        F.count_if(o == "conflict").alias("conflicts"), F.count_if(o == "error").alias("errors"),
        F.count_if("verified").alias("verified"),
        F.array_sort(F.collect_set(F.when(o == "copied", F.col("env")))).alias("touched_envs"))


def deletable(verified: DataFrame, archive_root: str) -> DataFrame:
    """Why an original may not be deleted (NULL: it may). Nothing is deleted here."""
    root = archive_root.rstrip("/") + "/"
    p, d = F.col("path"), F.col("dest")
    why = (
        F.when(~p.startswith("/"), "percorso non assoluto")
        .when(p.startswith(root), "si trova nell'archivio: non viene mai cancellato")
        .when(~d.startswith(root), "la copia indicata non è nell'archivio")
        .when(F.col("now_size").isNull(), "non è un file")
        .when(p == d, "è la copia in archivio: non viene mai cancellata")
        .when((F.col("now_size") != F.col("size")) | (F.col("now_mtime") != F.col("mtime")),
              "modificato dopo la verifica: non viene cancellato")
        .when(F.col("dest_size").isNull(), "la copia in archivio non c'è più")
        .when((F.col("dest_size") < F.col("size")) | (F.col("prefix_sha") != F.col("sha")),
              "non coincide più con la copia in archivio"))
    return verified.withColumn("keep_reason", why)
