"""Numbers, sizes, URLs, masking and placeholders as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, one_of, py_strip, squeeze

# How numbers and instants are printed.
ITALIAN_NUMBER = r"^[-+]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$"
PLAIN_NUMBER = r"^[-+]?\d+(\.\d+)?$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})([T ].*)?$"
EPOCH_MILLIS = r"^\d{12,13}$"
# Query keys added by mailers and ad platforms.
TRACKING_EXACT = ("gclid", "fbclid", "msclkid", "mkt_tok", "mc_cid", "mc_eid", "_hsenc", "_hsmktg")
TRACKING_PREFIX = "utm_"
# What a URL and a signature look like inside text.
URL_IN_TEXT = r"""(?i)https?://[^\s"'<>]+"""
SIGNATURE = r"""(?i)sig(?:=|%3D|\\u003d|&#0*61;|&#x0*3d;|&equals;)[^&\s"'\\<>]+"""
URL_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//(?=[^/?#])([^/?#]*@)?([^/?#@]*)|//)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SIG_MASK = "sig=***"
SECRET_HEADERS = (
    "authorization", "proxy-authorization", "cookie", "x-api-key", "api-key", "apikey",
    "ocp-apim-subscription-key", "x-functions-key",
)
# The shapes of a value placeholder.
PLACEHOLDER = (
    r"(?i)^[(\[«\"']*(?:\[[^\]\s]{0,12}\]|X{3,}|X+(?:[.,/]X+)+|(?:gg|dd)[/.\-](?:mm)[/.\-](?:aa|aaaa|yyyy)"
    r"|[._…]{4,}|\{\{[^{}]*\}\})[)\]»\"'.,;:]*$"
)
BRACE_VALUE = r"^[A-Z0-9_/\s,.\-:€%]+$"
MASK_WORD = r"^(?i:gg|mm|aa|aaaa|mese|anno|giorno|xx|xxx|xxxx|[x,.]+)$"
NUMBER_TYPE = "decimal(38,18)"


def italian_number(text: Column | str) -> Column:
    """DECIMAL of a number printed the Italian way, else NULL."""
    t = py_strip(col(text))
    plain = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(t.rlike(ITALIAN_NUMBER), plain.try_cast(NUMBER_TYPE))


def printed_decimals(text: Column | str) -> Column:
    t = col(text)
    return F.when(t.contains(","), F.length(F.substring_index(t, ",", -1))).otherwise(0)


def epoch_days(millis: Column | str) -> Column:
    """ARRAY<STRING>: the dd/MM/yyyy an epoch-millis text may print as (UTC+0..2)."""
    m = col(millis).try_cast("bigint")
    days = [F.date_format(F.timestamp_millis(m + F.lit(h * 3_600_000)), "dd/MM/yyyy") for h in (0, 1, 2)]
    return F.when(m.isNotNull(), F.array_sort(F.array_distinct(F.array(*days))))


def _one_decimal(v: Column) -> Column:
    t = F.replace(F.format_string("%.1f", F.bround(v, 1)), F.lit("."), F.lit(","))
    return F.regexp_replace(t, ",0$", "")


def human_size(n: Column | str) -> Column:
    v = F.greatest(F.lit(0.0), col(n).cast("double"))
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(v < kb, F.concat(v.cast("bigint").cast("string"), F.lit(" B")))
        .when(v < mb, F.concat(_one_decimal(v / kb), F.lit(" KB")))
        .when(v < gb, F.concat(_one_decimal(v / mb), F.lit(" MB")))
        .otherwise(F.concat(_one_decimal(v / gb), F.lit(" GB")))
    )


def human_seconds(s: Column | str) -> Column:
    return F.concat(_one_decimal(F.greatest(F.lit(0.0), col(s).cast("double"))), F.lit(" s"))


def human_rate(bps: Column | str) -> Column:
    return F.when(col(bps).isNull(), F.lit("")).otherwise(F.concat(human_size(bps), F.lit("/s")))


def human_eta(seconds: Column | str) -> Column:
    s = col(seconds).cast("double")
    near = F.greatest(F.lit(5), (F.bround(s / 5) * 5).cast("int"))
    mins = F.greatest(F.lit(1), F.bround(s / 60).cast("int"))
    return (
        F.when(s.isNull() | (s < 0), F.lit(""))
        .when(s < 60, F.format_string("circa %d s rimanenti", near))
        .when(s < 3600, F.format_string("circa %d min rimanenti", mins))
        .otherwise(F.concat(F.lit("circa "), _one_decimal(s / 3600), F.lit(" h rimanenti")))
    )


def is_tracking_key(key: Column | str) -> Column:
    k = F.lower(col(key))
    return k.startswith(TRACKING_PREFIX) | one_of(k, TRACKING_EXACT)


def url_norm(url: Column | str, drop_tracking: bool = True, drop_keys: Sequence[str] = ()) -> Column:
    """Comparison form of a URL: scheme and host lower, query parts sorted, dropped keys removed.

    One pattern names the parts; each is read from the URL itself, so nothing is nested.
    """
    u = py_strip(col(url))
    scheme, net, user, host, path, query, frag = (F.regexp_extract(u, URL_PARTS, i) for i in range(1, 8))

    def keep(part: Column) -> Column:
        raw = F.substring_index(part, "=", 1)
        key = F.coalesce(F.try_url_decode(raw), raw)
        gone = is_tracking_key(key) if drop_tracking else F.lit(False)
        if drop_keys:
            gone = gone | F.lower(key).isin(*[k.lower() for k in drop_keys])
        return (part != "") & ~gone

    q = F.array_join(F.array_sort(F.filter(F.split(query, "&"), keep)), "&")
    full = F.concat(
        F.lower(scheme), F.regexp_replace(net, r"(?s)^(//).*$", "$1"), user, F.lower(host), path,
        F.regexp_replace(q, r"(?s)^(?=.)", "?"), F.regexp_replace(frag, r"(?s)^(?=.)", "#"))
    opaque = u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//)")
    return (
        F.when(u.rlike(r"^[^/?#]*//[^/?#]*[\[\]]") & ~u.rlike(r"^[^/?#]*//[^/?#\[\]]*\[[^/?#\[\]]*\][^/?#\[\]]*(?:[/?#]|$)"), u)
        .when(opaque, F.concat(F.lower(scheme), F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")))
        .otherwise(full)
    )


def mask_text(text: Column | str) -> Column:
    """URL queries in free text become ``sig=***``; a signature left anywhere is masked."""
    t = col(text)
    t = F.regexp_replace(
        t, r"""(?i)(https?://)(?:[^\s"'<>/?#@]*@)?([^\s"'<>/?#]*)([^\s"'<>?#]*)\?[^\s"'<>#]+(?:#[^\s"'<>]*)?""",
        "$1$2$3?" + SIG_MASK)
    t = F.regexp_replace(
        t, r"""(?i)(https?://)(?:[^\s"'<>/?#@]*@)?([^\s"'<>/?#]*)([^\s"'<>?#]*)\??#[^\s"'<>]*""", "$1$2$3")
    return F.regexp_replace(t, SIGNATURE, SIG_MASK)


def mask_text_for_log(text: Column | str) -> Column:
    """Every URL reduced to scheme and host."""
    t = F.regexp_replace(
        col(text), r"""(?i)(https?)://(?:[^\s"'<>/?#@]*@)?([^\s"'<>/?#:]+)[^\s"'<>]*""", "$1://$2/…")
    return F.regexp_replace(t, SIGNATURE, SIG_MASK)


def host_only(url: Column | str) -> Column:
    u = col(url)
    p = r"""^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"""
    host = F.lower(F.regexp_extract(u, p, 2))
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(u, p, 1)), F.lit("://"), host, F.lit("/…"))) \
        .otherwise(F.lit("<url>"))


def shown_headers(headers: Column) -> Column:
    """MAP with credentials as ``***`` and other values masked."""
    return F.transform_values(
        headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("***")).otherwise(mask_text(v)))


def is_placeholder(text: Column | str) -> Column:
    t = py_strip(col(text))
    core = F.regexp_replace(t, r"""^[(\[«"')\]».,;:]+|[(\[«"')\]».,;:]+$""", "")
    head = F.regexp_replace(t, r"""^[(«"']+""", "")
    x_mask = core.rlike("^[xX]") & head.rlike("^[xX]")
    return t.rlike(PLACEHOLDER) & (~x_mask | core.startswith("X"))


def is_conditional(inner: Column) -> Column:
    """Whether the inside of ``{{…}}`` is a conditional text rather than a value."""
    t = squeeze(inner)
    words = F.filter(F.split(t, r"[\s/.\-]+"), lambda w: w != "")
    masks = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(MASK_WORD))
    value = t.rlike(BRACE_VALUE) & t.rlike(r"[\p{L}\p{N}]")
    return (t != "") & ~value & ~masks
