"""Batch resolution: targets to calls, attempts to outcomes, headers and retry sets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.core import label
from ..session import by_merge
from .ranking import first_spelling, last_by, top_per_group
from .search import newest_first

NO_PACKAGE = "_senza_pacchetto"
RETRY_STATUSES = ("failed", "no_call", "cancelled")
STATUS_ORDER = ("ok", "html_skipped", "no_call", "failed", "cancelled")
AUTOMATIC_HEADERS = ("template_key", "current_timestamp", "correlation_id", "Postman-Token")
# What names production, a header name, and the headers the HTTP client owns.
PROD_LIKE = r"prod|(?<![a-z])prd(?![a-z])"
HEADER_NAME = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"
CLIENT_HEADERS = (
    "host", "content-length", "transfer-encoding", "connection", "keep-alive", "proxy-connection", "te",
    "trailer", "upgrade", "proxy-authenticate", "proxy-authorization", "expect",
)

# What is said of headers and generators that cannot be used.
SAY = {
    "no_name": "manca il nome dell'intestazione",
    "bad_name": "' non è un nome di intestazione valido",
    "client_name": "' è gestita dal client HTTP e non si può impostare",
    "value_of": "il valore dell'intestazione '",
    "line_end": "' non può andare a capo",
    "odd_value": "' contiene caratteri non ammessi (solo lettere accentate europee, niente simboli o emoji)",
    "repeated_header": "' è duplicata (il confronto ignora maiuscole/minuscole)",
    "no_generator_name": "manca il nome del generatore",
    "prod_name": "il nome non può contenere 'prod' o 'prd' (la produzione non è mai configurabile)",
    "prod_url": "l'URL non può contenere 'prod' o 'prd' (la produzione non è mai configurabile)",
    "ascii_url": "l'URL può contenere solo caratteri ASCII",
    "https_url": "l'URL deve iniziare con https://",
    "host_url": "l'URL deve indicare un host",
    "repeated_name": "nome duplicato (il confronto ignora maiuscole/minuscole)",
}


# ------------------------------------------------------------- package list ---

def package_summary(packages: DataFrame) -> DataFrame:
    """Distinct keys (ignoring case) per package, by name."""
    return packages.groupBy("package").agg(
        F.count_distinct(F.lower("template_key")).alias("n_keys")).orderBy(F.lower("package"), "package")


def keys_of(packages: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Keys of the chosen packages in file order, once each."""
    rows = packages.where(F.col("package").isin(*chosen)).select(F.lower("template_key").alias("key_lc"), "template_key", "ord")
    return first_spelling(rows, ["key_lc"]).orderBy("ord")


def packages_of(packages: DataFrame) -> DataFrame:
    """(key_lc, folders in file order); a key sits in as many rows as it has packages."""
    return packages.groupBy(F.lower("template_key").alias("key_lc")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("ord", "package"))), lambda s: s["package"]).alias("folders"))


def targets_from_keys(keys: DataFrame, packages: DataFrame | None) -> DataFrame:
    """One target per distinct key; folders are its packages, else the no-package folder."""
    rows = keys.withColumn("value", F.trim("value")).where(F.col("value") != "").withColumn("key_lc", F.lower("value"))
    one = first_spelling(rows.select("key_lc", "value", "ord"), ["key_lc"])
    none = F.array(F.lit(NO_PACKAGE))
    if packages is None:
        one = one.withColumn("folders", none)
    else:
        one = one.join(packages_of(packages), "key_lc", "left").withColumn("folders", F.coalesce("folders", none))
    return one.select("ord", F.lit("key").alias("kind"), "value", "folders")


def targets_from_packages(packages: DataFrame, chosen: Sequence[str]) -> DataFrame:
    kept = packages.where(F.col("package").isin(*chosen))
    return keys_of(packages, chosen).join(packages_of(kept), "key_lc").select(
        "ord", F.lit("key").alias("kind"), F.col("template_key").alias("value"), "folders")


def targets_from_fdis(fdis: DataFrame) -> DataFrame:
    rows = fdis.withColumn("value", F.trim("value")).where(F.col("value") != "").withColumn("k", F.lower("value"))
    return first_spelling(rows.select("k", "value", "ord"), ["k"]).select(
        "ord", F.lit("fdi").alias("kind"), "value", F.array().cast("array<string>").alias("folders"))


def targets_from_hits(hits: DataFrame) -> DataFrame:
    """One exact target per distinct call (env, day, seq), first position kept."""
    rows = hits.select("env", "day", "seq", "template_key", "fdi", "ord")
    one = first_spelling(rows, ["env", "day", "seq"])
    return one.select("ord", F.lit("call").alias("kind"), F.col("template_key").alias("value"),
                      F.array(F.coalesce("fdi", F.lit(NO_PACKAGE))).alias("folders"), "env", "day", "seq")


# --------------------------------------------------------------- resolution ---

HIT = ("env", "day", "seq", "template_key", "fdi", "request_date", "ndocs", "name")


def _hit_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in HIT])


def spread_days(days: Column, most: int | None = None) -> Column:
    """From days newest first, the newest and then the first at least 1, 3, 7, 15… days older; at most ``most``."""
    empty = F.array().cast("array<date>")

    def step(kept: Column, day: Column) -> Column:
        n = F.size(kept)
        far = F.datediff(F.get(kept, F.lit(0)), day) >= F.pow(F.lit(2.0), n) - 1
        room = F.lit(True) if most is None else n < most
        return F.when(room & ((n == 0) | far), F.concat(kept, F.array(day))).otherwise(kept)

    return F.aggregate(days, empty, step)


def key_calls(targets: DataFrame, entries: DataFrame, envs: Sequence[str], per_env: int | None = None, most: int | None = None) -> DataFrame:
    """Newest call of each key over the envs in order, with alternates spread back in time.

    ``per_env`` days of an env and ``most`` calls of a key are kept, all where they are not given.

    The entries are reduced to the first call of each (key, env, day) by a group-limited top 1
    before anything is gathered; what is gathered per key is bounded by the calendar.
    """
    order = F.lit(len(envs))
    for i in range(len(envs) - 1, -1, -1):
        order = F.when(F.col("env") == envs[i], F.lit(i)).otherwise(order)
    wanted = targets.where(F.col("kind") == "key").withColumn("key_lc", F.lower(F.trim("value")))
    rows = (
        entries.where(F.col("env").isin(*envs)).withColumn("key_lc", F.lower("template_key"))
        .join(wanted.select("key_lc").distinct(), "key_lc", "left_semi")
    )
    daily = top_per_group(rows, ["key_lc", "env", "day"], [F.desc_nulls_last("request_date"), F.desc("seq")])
    days = daily.groupBy("key_lc", "env").agg(F.sort_array(F.collect_list("day"), asc=False).alias("days"))
    kept = days.select("key_lc", "env", F.posexplode(spread_days(F.col("days"), per_env)).alias("pos", "day"))
    picked = daily.join(kept, ["key_lc", "env", "day"]).withColumn("env_no", order)
    # a calendar bounds the calls of a key: the spread keeps a few of each env
    calls = picked.groupBy("key_lc").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("env_no", "pos", _hit_struct().alias("hit")))), lambda s: s["hit"]).alias("hits"))
    if most is not None:
        calls = calls.withColumn("hits", F.slice("hits", 1, most))
    head = F.get("hits", F.lit(0))
    return wanted.join(calls, "key_lc", "left").select(
        "ord", F.coalesce(head["template_key"], F.trim("value")).alias("key"), "folders", head["fdi"].alias("fdi"),
        head.alias("hit"), F.lit(False).alias("exact"),
        F.coalesce(F.slice("hits", F.lit(2), F.size("hits")), F.array().cast("array<" + _hit_type() + ">")).alias("alternates"))


def _hit_type() -> str:
    return ("struct<env:string,day:date,seq:bigint,template_key:string,fdi:string,request_date:string,"
            "ndocs:int,name:string>")


def fdi_calls(targets: DataFrame, entries: DataFrame, env: str) -> DataFrame:
    """Newest call per key of exactly that FDI; a wanted key without a call stays as a row."""
    t = targets.where(F.col("kind") == "fdi").withColumn("fdi_lc", F.lower(F.trim("value")))
    keys = F.col("keys") if "keys" in targets.columns else F.array().cast("array<string>")
    t = t.withColumn("only", F.coalesce(keys, F.array().cast("array<string>")))
    rows = (
        entries.where((F.col("env") == env) & F.col("fdi").isNotNull() & (F.trim("template_key") != ""))
        .withColumn("fdi_lc", F.lower("fdi")).withColumn("key_lc", F.lower(F.trim("template_key")))
        .join(t.select("fdi_lc").distinct(), "fdi_lc", "left_semi")
    )
    best = top_per_group(rows, ["fdi_lc", "key_lc"], newest_first()).select(
        "fdi_lc", "key_lc", _hit_struct().alias("hit"))
    wanted_some = t.where(F.size("only") > 0).select(
        "ord", "value", "fdi_lc", F.posexplode("only").alias("pos", "want")).withColumn("key_lc", F.lower(F.trim("want")))
    wanted_some = wanted_some.join(best, ["fdi_lc", "key_lc"], "left").select(
        "ord", "pos", "value", F.coalesce(F.col("hit.template_key"), F.col("want")).alias("key"), "hit")
    wanted_all = t.where(F.size("only") == 0).select("ord", "value", "fdi_lc").join(best, "fdi_lc", "left").select(
        "ord", F.lit(0).alias("pos"), "value", F.coalesce(F.col("hit.template_key"), F.lit("")).alias("key"), "hit")
    return wanted_some.unionByName(wanted_all).select(
        "ord", "pos", "key", F.array("value").alias("folders"), F.col("value").alias("fdi"), "hit",
        F.lit(False).alias("exact"), F.array().cast("array<" + _hit_type() + ">").alias("alternates"))


def exact_calls(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """The call named by (env, day, seq); a blank key makes it unsendable."""
    t = targets.where(F.col("kind") == "call")
    j = t.select("ord", "folders", "env", "day", "seq").join(entries.select(*HIT), ["env", "day", "seq"])
    key = F.when(F.trim("template_key") != "", F.col("template_key")).otherwise("")
    return j.select(
        "ord", key.alias("key"), "folders", "fdi", _hit_struct().alias("hit"), F.lit(True).alias("exact"),
        F.array().cast("array<" + _hit_type() + ">").alias("alternates"))


def sendable(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("hit").isNotNull() & (F.trim("key") != ""))


def resolve(targets: DataFrame, entries: DataFrame, source_env: str, fallback_envs: Sequence[str] = (), per_env: int | None = None,
            most: int | None = None) -> DataFrame:
    """All targets to calls, in target order (an FDI's calls newest first); ``per_env`` and ``most`` as in ``key_calls``."""
    envs = [source_env] + [e for e in dict.fromkeys(fallback_envs) if e.lower() != source_env.lower()]
    cols = ["ord", "pos", "key", "folders", "fdi", "hit", "exact", "alternates"]
    zero = F.lit(0).alias("pos")
    parts = [
        key_calls(targets, entries, envs, per_env, most).withColumn("pos", F.lit(0)).select(*cols),
        fdi_calls(targets, entries, source_env).select(*cols),
    ]
    if {"env", "day", "seq"} <= set(targets.columns):
        parts.append(exact_calls(targets, entries).withColumn("pos", zero).select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_calls(calls: DataFrame, html_keys: DataFrame | None, save_html: bool = False) -> DataFrame:
    """Calls a run would send: sendable, minus keys remembered as HTML unless HTML is saved."""
    s = sendable(calls).withColumn("key_lc", F.lower(F.trim("key")))
    if html_keys is not None and not save_html:
        s = s.join(html_keys.select("key_lc"), "key_lc", "left_anti")
    return s.agg(F.count("*").alias("n_calls"))


def html_memory(answers: DataFrame) -> DataFrame:
    """Keys whose last answer was HTML (key_lc, spelling)."""
    rows = answers.withColumn("key_lc", F.lower(F.trim("key"))).where(
        (F.col("key_lc") != "") & F.col("doc_type").isin("html", "pdf"))
    return (
        rows.groupBy("key_lc").agg(F.max_by("doc_type", "ts").alias("doc_type"))
        .where(F.col("doc_type") == "html").select("key_lc")
    )


def outcomes(attempts: DataFrame, keys: Sequence[str] = ("run", "ord")) -> DataFrame:
    """One outcome per call from its attempts log (n, ok, doc_type, http_status, error_kind, reason…).

    An attempt is retried only after a refusal: a failure with an HTTP answer or an unreadable
    payload. Two aggregations on the same keys, no attempt list is gathered.
    """
    keys = list(keys)
    ok = F.col("status").isin("ok", "html_skipped")
    refusal = (F.col("status") == "failed") & (F.col("http_status").isNotNull() | (F.coalesce("error_kind", F.lit("")) == "payload"))
    stop = attempts.groupBy(*keys).agg(F.min(F.when(~refusal, F.col("n"))).alias("_stop"))
    j = attempts.join(stop, keys).where(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop")))
    sent = F.coalesce(F.col("sent"), F.lit(True)) if "sent" in attempts.columns else F.lit(True)
    s = F.struct("status", "doc_type", "http_status", "duration_ms", F.coalesce("reason", F.lit("")).alias("reason"), "env", "day")
    agg = j.groupBy(*keys).agg(
        F.min_by(F.when(ok, s), F.when(ok, F.col("n"))).alias("good"),
        F.min_by(F.when(~ok, s), F.when(~ok, F.col("n"))).alias("bad"),
        F.count_if(sent).alias("attempts"))
    pick = F.coalesce("good", "bad")
    tried = F.concat(pick["reason"], F.lit(" (provate "), F.col("attempts").cast("string"),
                    F.lit(" chiamate dei log, tutte rifiutate)"))
    return agg.select(
        *keys, pick["status"].alias("status"), pick["doc_type"].alias("doc_type"),
        pick["http_status"].alias("http_status"), pick["duration_ms"].alias("duration_ms"),
        text.mask_text(F.when(F.col("good").isNull() & (F.col("attempts") > 1), tried).otherwise(pick["reason"])).alias("reason"),
        pick["env"].alias("used_env"), pick["day"].alias("used_day"), "attempts")


def status_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = F.col("status")
    return results.groupBy(*by).agg(*[F.count_if(s == x).alias(x) for x in STATUS_ORDER])


def report_summary(counts: DataFrame) -> DataFrame:
    """"3 generati · 1 non riuscito · …" from a status_counts row."""
    words = {
        "ok": ("1 generato", "%d generati"), "failed": ("1 non riuscito", "%d non riusciti"),
        "no_call": ("1 senza chiamata", "%d senza chiamata"), "html_skipped": ("1 email saltata", "%d email saltate"),
        "cancelled": ("1 annullato", "%d annullati"),
    }
    parts = [F.when(F.col(k) == 1, F.lit(one)).when(F.col(k) > 1, F.format_string(many, F.col(k)))
             for k, (one, many) in words.items()]
    return counts.withColumn("summary", F.concat_ws(" · ", *parts))


def retry_targets(results: DataFrame) -> DataFrame:
    """Targets to call again from outcomes (ord, status, key, fdi, folders, exact_hit).

    An exact call comes back as itself, a call under its FDI folder as that FDI with its keys,
    anything else as its key; each once, at its first position.
    """
    r = results.where(F.col("status").isin(*RETRY_STATUSES))
    key, fdi = F.trim(F.coalesce("key", F.lit(""))), F.trim(F.coalesce("fdi", F.lit("")))
    r = r.withColumn("_key", key).withColumn("_fdi", fdi)
    is_fdi = (F.col("_fdi") != "") & (F.size("folders") == 1) & (F.get("folders", F.lit(0)) == F.col("_fdi"))
    kind = F.when(F.col("exact_hit").isNotNull(), "call").when(is_fdi, "fdi").when(F.col("_key") != "", "key")
    r = r.withColumn("kind", kind).where(F.col("kind").isNotNull())
    ident = (
        F.when(F.col("kind") == "call", F.to_json("exact_hit")).when(F.col("kind") == "fdi", F.lower("_fdi"))
        .otherwise(F.lower("_key")))
    r = r.withColumn("ident", ident)
    first = r.groupBy("kind", "ident").agg(
        F.min_by(F.struct("ord", "_key", "_fdi", "folders", "exact_hit"), "ord").alias("f"))
    spelled = (
        r.where(F.col("kind") == "fdi").where(F.col("_key") != "")
        .groupBy("ident", F.lower("_key").alias("key_lc")).agg(F.min_by(F.struct("ord", F.col("_key").alias("k")), "ord").alias("s"))
        .groupBy("ident").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["k"]).alias("fdi_keys"))
    )
    j = first.join(spelled, "ident", "left")
    whole = (F.col("kind") == "fdi") & (F.col("f._key") == "")
    keys = F.when((F.col("kind") == "fdi") & ~whole, F.col("fdi_keys"))
    return j.select(
        F.col("f.ord").alias("ord"), "kind",
        F.when(F.col("kind") == "fdi", F.col("f._fdi")).otherwise(F.col("f._key")).alias("value"),
        F.when(F.col("kind") == "fdi", F.array().cast("array<string>"))
        .when(F.size("f.folders") > 0, F.col("f.folders")).otherwise(F.array(F.lit(NO_PACKAGE))).alias("folders"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("keys"), F.col("f.exact_hit").alias("exact_hit"))


def retry_count(targets: DataFrame) -> DataFrame:
    n = F.when((F.col("kind") == "fdi") & (F.size("keys") > 0), F.size("keys")).otherwise(1)
    return targets.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_calls"))


# ------------------------------------------------------------ reserved names ---

def _family(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(_\d+)+$", "")


def _name_family(pdf: pd.DataFrame) -> pd.DataFrame:
    """Give each call of one name family, in call order, the first name still free."""
    taken: set[str] = set()
    nxt: dict[str, int] = {}
    out = []
    for stem in pdf.sort_values("ord")["stem"]:
        base = stem.lower()
        n = nxt.get(base, 1)
        while (base if n == 1 else f"{base}_{n}") in taken:
            n += 1
        nxt[base] = n + 1
        taken.add(base if n == 1 else f"{base}_{n}")
        out.append(n)
    pdf = pdf.sort_values("ord").copy()
    pdf["n"] = out
    return pdf[["folder_ci", "family", "ord", "stem", "n"]]


def reserve_names(calls: DataFrame, chunk: int = 10000) -> DataFrame:
    """Collision-free names per folder in call order: ``A``, ``A_2``, ``A_3``…

    Where a family of names (``A``, ``A_2``, …) has one spelling, the suffix is a rank, computed
    in two levels so a name asked a million times is no single task's work. Only families where
    one call's own name looks like another's suffixed name are walked in order.
    """
    rows = calls.select("ord", F.explode("folders").alias("folder"), "key").withColumn(
        "stem", names.safe_component("key")).withColumn("folder", names.safe_component("folder"))
    rows = rows.withColumn("folder_ci", F.lower("folder")).withColumn("stem_ci", F.lower("stem"))
    rows = rows.dropDuplicates(["ord", "folder_ci"])
    rows = rows.withColumn("family", _family(F.col("stem_ci")))
    kinds = rows.groupBy("folder_ci", "family").agg(
        F.min("stem_ci").alias("_lo"), F.max("stem_ci").alias("_hi")).select(
        "folder_ci", "family", (F.col("_lo") != F.col("_hi")).alias("mixed"))
    rows = rows.join(kinds, ["folder_ci", "family"])
    plain = rows.where(~F.col("mixed")).withColumn("bucket", F.floor(F.col("ord") / chunk))
    from .ranking import two_level_rank

    plain = two_level_rank(plain, ["folder_ci", "stem_ci"], "bucket", [F.asc("ord")], out="n").select(
        "folder_ci", "family", "ord", "stem", "n")
    mixed = rows.where("mixed").groupBy("folder_ci", "family").applyInPandas(
        _name_family, "folder_ci string, family string, ord bigint, stem string, n bigint")
    both = plain.unionByName(mixed)
    suffix = F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))
    root = F.regexp_replace(
        F.left("stem", F.lit(names.COMPONENT_CAP - 5) - F.length(suffix)), r"[ .]+$", "")
    return both.select("folder_ci", "ord", "n", F.concat(root, suffix).alias("name"))


# ------------------------------------------------------------------ headers ---

def header_table(profile: DataFrame) -> DataFrame:
    """Automatic rows, then the profile; a profile row of the same name replaces in place.

    ``profile`` is (owner, ord, name, value): one table per owner.
    """
    auto = F.array(*[F.struct(F.lit(i - len(AUTOMATIC_HEADERS)).cast("bigint").alias("pos"), F.lit(n).alias("name"))
                     for i, n in enumerate(AUTOMATIC_HEADERS)])
    base = profile.select("owner").distinct().select("owner", F.inline(auto)).withColumn("name_lc", F.lower("name"))
    prof = profile.withColumn("name", F.trim("name")).where(F.col("name") != "").withColumn("name_lc", F.lower("name"))
    first = prof.groupBy("owner", "name_lc").agg(F.min("ord").alias("_first"))
    prof = last_by(prof.select("owner", "name_lc", "ord", "name", F.coalesce("value", F.lit("")).alias("value")),
                   ["owner", "name_lc"], "ord").join(first, ["owner", "name_lc"])
    j = base.alias("b").join(prof.alias("p"), ["owner", "name_lc"], "full_outer")
    return j.select(
        "owner", F.coalesce("b.pos", "p._first").alias("pos"),
        F.coalesce("p.name", "b.name").alias("name"), F.coalesce("p.value", F.lit("")).alias("value"))


def stable_uuid(*parts: Column | str) -> Column:
    """A UUID made from its parts: the same again when a task runs again, another one for another run's token or time."""
    h = F.md5(F.to_json(F.struct(*[(F.col(p) if isinstance(p, str) else p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)])))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12))


def build_headers(rows: DataFrame, calls: DataFrame, now_ms: Column, token: str) -> DataFrame:
    """Headers of each call: last row per name wins, automatic empties computed.

    ``rows`` (owner, ord, name, value) is joined to ``calls`` (owner, call_ord, key).
    """
    last = last_by(
        rows.withColumn("name", F.trim("name")).where(F.col("name") != "").select(
            "owner", F.lower("name").alias("name_lc"), "ord", "name", F.trim(F.coalesce("value", F.lit(""))).alias("value")),
        ["owner", "name_lc"], "ord")
    computed = (
        F.when(F.col("name_lc") == "template_key", F.trim("key"))
        .when(F.col("name_lc") == "current_timestamp", now_ms.cast("string"))
        .when(F.col("name_lc") == "correlation_id", stable_uuid("owner", "call_ord", "key", now_ms, F.lit(token)))
        .when(F.col("name_lc") == "postman-token", F.lit(token)))
    j = calls.join(last, "owner")
    value = F.when((F.col("value") == "") & computed.isNotNull(), computed).otherwise(F.col("value"))
    return j.withColumn("value", value).drop("name_lc", "ord")


def resolve_headers(layers: DataFrame, cases: DataFrame, token: str) -> DataFrame:
    """Layered headers: automatic < profile < initiative < case; empties dropped.

    ``layers`` (case_id, layer, ord, name, value); ``cases`` (case_id, key, correlation, correlation_value,
    source_fdi, drop_token, now_ms). The token survives being emptied; only ``drop_token`` removes it.
    """
    corr = (
        F.when(F.col("correlation") == "source", F.nullif(F.trim("source_fdi"), F.lit("")))
        .when(F.col("correlation") == "fixed", F.nullif(F.trim("correlation_value"), F.lit("")))
        .otherwise(stable_uuid("case_id", "key", "now_ms", F.lit(token))))
    auto = cases.select("case_id", F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("current_timestamp").alias("name"), F.col("now_ms").cast("string").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("template_key").alias("name"), F.col("key").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("correlation_id").alias("name"), corr.alias("value")),
        F.struct(F.lit(3).alias("ord"), F.lit("Postman-Token").alias("name"), F.lit(token).alias("value")),
    ))).where(F.col("value").isNotNull()).withColumn("layer", F.lit(0))
    every = auto.select("case_id", "layer", "ord", "name", "value").unionByName(
        layers.select("case_id", "layer", "ord", F.trim("name").alias("name"), F.trim(F.coalesce("value", F.lit(""))).alias("value")))
    every = every.where(F.col("name") != "").withColumn("name_lc", F.lower("name"))
    won = every.groupBy("case_id", "name_lc").agg(
        F.max_by(F.struct("name", "value", "layer"), F.struct("layer", "ord")).alias("w"))
    j = won.join(cases.select("case_id", "drop_token"), "case_id")
    is_token = F.col("name_lc") == "postman-token"
    value = F.when(is_token & (F.col("w.value") == ""), F.lit(token)).otherwise(F.col("w.value"))
    name = F.when(is_token & (F.col("w.value") == ""), F.lit("Postman-Token")).otherwise(F.col("w.name"))
    return j.where(~(is_token & F.col("drop_token"))).select(
        "case_id", name.alias("name"), value.alias("value"), F.col("w.layer").alias("layer")).where(F.col("value") != "")


def header_problems(rows: DataFrame) -> DataFrame:
    """Problems per (owner, ord) row: missing or invalid name, invalid value, repeated name."""
    name, value = F.col("name"), F.coalesce("value", F.lit(""))
    key = F.lower(F.trim("name"))
    first = rows.where(F.trim("name") != "").groupBy("owner", key.alias("_k")).agg(F.min("ord").alias("_first"))
    j = rows.withColumn("_k", key).join(first, ["owner", "_k"], "left")

    def say(before: str, after: str) -> Column:
        return F.concat(F.lit(before), name, F.lit(after))

    probs = F.array_compact(F.array(
        F.when(F.trim("name") == "", SAY["no_name"])
        .when(~name.rlike(HEADER_NAME), say("'", SAY["bad_name"]))
        .when(F.lower(name).isin(*CLIENT_HEADERS), say("'", SAY["client_name"])),
        F.when(value.rlike(r"[\r\n]"), say(SAY["value_of"], SAY["line_end"]))
        .when(value.rlike(r"[^\x00-\xff]"), say(
            SAY["value_of"], SAY["odd_value"])),
        F.when((F.trim("name") != "") & (F.col("ord") > F.col("_first")), F.concat(
            F.lit("'"), name, F.lit(SAY["repeated_header"]))),
    ))
    return j.withColumn("problems", probs).drop("_k", "_first")


def is_prod_like(c: Column) -> Column:
    """Names the production environment, as written or percent-decoded."""
    return F.lower(c).rlike(PROD_LIKE) | F.lower(F.coalesce(F.try_url_decode(c), c)).rlike(PROD_LIKE)


def generator_problems(rows: DataFrame) -> DataFrame:
    """Problems per generator row (ord, name, url); a name repeated later is a duplicate."""
    name, url = F.trim("name"), F.col("url")
    key = F.lower(name)
    first = rows.where(name != "").groupBy(key.alias("_k")).agg(F.min("ord").alias("_first"))
    j = rows.withColumn("_k", key).join(first, "_k", "left")
    probs = F.array_compact(F.array(
        F.when(name == "", SAY["no_generator_name"]),
        F.when(is_prod_like(F.col("name")), SAY["prod_name"]),
        F.when(is_prod_like(url), SAY["prod_url"])
        .when(url.rlike(r"[^\x00-\x7f]"), SAY["ascii_url"])
        .when(~url.rlike(r"(?i)^https:"), SAY["https_url"])
        .when(~url.rlike(r"(?i)^https://[^/?#]+"), SAY["host_url"]),
        F.when((name != "") & (F.col("ord") > F.col("_first")), SAY["repeated_name"]),
    ))
    return j.withColumn("problems", probs).drop("_k", "_first")


# -------------------------------------------------------------------- cases ---

def type_mismatch(versions: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated documents whose type differs from the target's, else the AS-IS's."""
    v = versions.where(F.col("doc_type").isin("pdf", "html")).groupBy("case").agg(
        F.max(F.when(F.col("kind") == "target", F.col("doc_type"))).alias("t"),
        F.max(F.when(F.col("kind") == "asis", F.col("doc_type"))).alias("a"))
    j = generated.join(v, "case", "left")
    expected = F.when(F.col("kind") == "asis", F.col("t")).otherwise(F.coalesce("t", "a"))
    return j.withColumn("expected", expected).withColumn(
        "mismatch", F.coalesce(F.col("doc_type") != expected, F.lit(False))).drop("t", "a")


def plan_cases(items: DataFrame, cases: DataFrame) -> DataFrame:
    """added / replaced / unchanged / failed per chosen call.

    ``items`` (ord, replace, key, variant, fdi, payload_sha); ``cases`` (case_id, key, variant, source_fdi, payload_sha).
    An added (key, variant) already taken, or repeated by an earlier item, fails alone.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.lower(F.trim("key"))).withColumn("_v", F.lower(F.trim("variant")))

    # Items without a case to replace meet no case: they stay out of that join, where they would all be one key.
    c = cases.select(
        F.col("case_id").alias("replace"), F.col("source_fdi").alias("_fdi"), F.col("payload_sha").alias("_sha"), F.lit(True).alias("_has"))
    same = F.col("fdi").eqNullSafe(F.col("_fdi")) & (F.col("payload_sha") == F.col("_sha"))
    swapped = items.where(F.col("replace").isNotNull()).join(by_merge(c), "replace", "left").withColumn(
        "result", F.when(F.col("_has").isNull(), "failed").when(same, "unchanged").otherwise("replaced"))
    new = keyed(items.where(F.col("replace").isNull()))
    known = new.select("_k", "_v", F.col("ord").alias("_first"), F.lit(False).alias("_taken")).unionByName(
        keyed(cases).select("_k", "_v", F.lit(True).alias("_taken")), allowMissingColumns=True).groupBy("_k", "_v").agg(
        F.min("_first").alias("_first"), F.max("_taken").alias("_taken"))
    added = new.join(known, ["_k", "_v"], "left").withColumn(
        "result", F.when(F.col("_taken") | (F.col("ord") > F.col("_first")), "failed").otherwise("added"))
    return swapped.select(*items.columns, "result").unionByName(added.select(*items.columns, "result"))


def free_variants(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """A free variant per wanted row: as asked, else with the short FDI, else numbered.

    ``taken`` (case_key, variant). The numbers tried are one more than the taken variants of
    that base, so a free one is always among them.
    """
    tk = taken.select("case_key", F.lower("variant").alias("_v")).distinct()
    w = wanted.withColumn("variant", F.trim("variant"))
    short = F.coalesce(F.nullif(F.left(F.coalesce("fdi", F.lit("")), F.lit(8)), F.lit("")), F.lit("nuovo"))
    w = w.withColumn("base", F.when(F.col("variant") != "", F.concat_ws("-", "variant", short)).otherwise(short))
    direct = w.withColumn("_v", F.lower("variant")).join(tk.withColumn("_t", F.lit(True)), ["case_key", "_v"], "left")
    free = direct.where(F.col("_t").isNull()).select("ord", F.col("variant").alias("chosen"))
    busy = direct.where(F.col("_t").isNotNull()).select("ord", "case_key", "base")
    numbered = tk.withColumn("_base", F.regexp_replace("_v", r"-\d+$", ""))
    near = tk.withColumnRenamed("_v", "_b").withColumn("_n", F.lit(1).cast("bigint")).unionByName(
        numbered.where(F.col("_v").rlike(r"-([2-9]|[1-9]\d+)$")).select(
            "case_key", F.col("_base").alias("_b"), F.regexp_extract("_v", r"-(\d+)$", 1).try_cast("bigint").alias("_n")))
    used = near.where(F.col("_n").isNotNull()).distinct()
    wnd = Window.partitionBy("case_key", "_b").orderBy("_n")
    gaps = used.withColumn("_rn", F.row_number().over(wnd)).groupBy("case_key", "_b").agg(
        F.min(F.when(F.col("_n") != F.col("_rn"), F.col("_rn"))).alias("_gap"), F.count("*").alias("_k"))
    pick = busy.withColumn("_b", F.lower("base")).join(gaps, ["case_key", "_b"], "left")
    n = F.coalesce("_gap", F.col("_k") + 1, F.lit(1))
    named = pick.select("ord", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("chosen"))
    return free.unionByName(named)
