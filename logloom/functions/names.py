"""Entry names, pasted text, typed tokens and file names as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ascii_lower, col, first_where, let, py_strip

# The shapes an entry name is made of.
UUID_SHAPE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CALL_ID_TAIL = r"_([0-9a-f]{16})$"
NO_FDI_PREFIX = "correlationId_vuoto_"
REPEATED_KEY = r"^(.*?[^_])(.+)_\2$"
UUID_TOKEN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}_"
# No FDI; a token ending with the key it repeats; token and key; key alone.
NAME_SHAPES = (
    r"(?s)^(?:correlationId_vuoto_(.*)|(?!" + UUID_TOKEN + r")(.*?[^_](.+))_\3|([^_]*)_(.*)|([^_]*))$"
)
WELL_FORMED = r"(?s)^" + UUID_TOKEN + r"(?:.*_)?[0-9a-f]{16}$"
HEADER_PREFIX = "### "
FDI_TOKEN = r"^[0-9a-f]{8}[0-9a-z-]*$"
NO_FDI = "nofdi"
# Names a file system refuses.
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL") + tuple(
    f"{port}{d}" for port in ("COM", "LPT") for d in "0123456789¹²³")
INVALID_IN_NAME = r'[<>:"/\\|?*\x00-\x1f]'
INVALID_IN_FOLDER = r'[\\/:*?"<>|]'
COMPONENT_CAP = 120


def repeated_key(rest: Column) -> Column:
    """Longest key ``K`` such that the text is ``<token>K_K``; NULL when there is none.

    The lazy head makes the key as long as it can be, which is the split at the first
    underscore that works. A UUID token is never split.
    """
    token = F.lower(F.substring_index(rest, "_", 1))
    return F.when(
        rest.contains("_") & ~token.rlike(UUID_SHAPE) & rest.rlike(REPEATED_KEY),
        F.regexp_extract(rest, REPEATED_KEY, 2),
    )


def entry_name(raw: Column | str) -> Column:
    """STRUCT<raw, fdi, template_key, call_id, well_formed> of an entry name. Total.

    One pattern holds the four shapes in their order of precedence; one replacement writes
    ``fdi \\u0001 key``, so each name is matched a fixed few times whatever its shape.
    """
    raw = col(raw)
    rest = F.regexp_replace(raw, CALL_ID_TAIL, "")
    parts = F.split(F.regexp_replace(rest, NAME_SHAPES, "$2$4\u0001$1$3$5$6"), "\u0001", 2)
    call_id = F.nullif(F.regexp_extract(raw, CALL_ID_TAIL, 1), F.lit(""))
    no_fdi = raw.startswith(NO_FDI_PREFIX) | ~rest.contains("_")
    return F.struct(
        raw.alias("raw"),
        F.when(~no_fdi, F.lower(parts[0])).alias("fdi"),
        parts[1].alias("template_key"),
        call_id.alias("call_id"),
        raw.rlike(WELL_FORMED).alias("well_formed"),
    )


def pasted_entry(text: Column | str) -> Column:
    """STRUCT<fdi, template_key> of a pasted header or entry name, else NULL."""
    lines = F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), "\n")
    line = py_strip(F.coalesce(first_where(lines, lambda s: s.rlike(r"\S")), F.lit("")))
    line = F.regexp_replace(py_strip(F.regexp_replace(line, "^### ", "")), r"(?i)\.json$", "")

    def read(line: Column) -> Column:
        def decide(n: Column) -> Column:
            odd = n["fdi"].isNotNull() & ~n["fdi"].rlike(FDI_TOKEN)
            ok = (line != "") & ~line.rlike(r"(?U)\s") & n["call_id"].isNotNull() & (n["template_key"] != "")
            return F.when(
                ok,
                F.struct(
                    F.when(~odd, n["fdi"]).alias("fdi"),
                    F.when(odd, F.left(line, F.length(line) - 17)).otherwise(n["template_key"]).alias("template_key"),
                ),
            )

        return let(entry_name(line), decide)

    return let(line, read)


def typed_token(text: Column | str, prefer_key: bool = False) -> Column:
    """STRUCT<kind, value>: ``fdi`` or ``key`` for one typed token, else NULL."""
    t = py_strip(col(text))
    looks = (
        t.contains("-") | (F.length(t) >= 8) | (t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    )
    is_fdi = F.lit(not prefer_key) & t.rlike(r"^[0-9a-fA-F-]+$") & looks
    return F.when(
        is_fdi, F.struct(F.lit("fdi").alias("kind"), F.lower(t).alias("value"))
    ).when(
        t.rlike(r"^[A-Za-z0-9_]+$"), F.struct(F.lit("key").alias("kind"), F.upper(t).alias("value"))
    )


def search_text(text: Column | str) -> Column:
    """STRUCT<fdi, template_key>: an entry name first, else one typed token."""
    tok = typed_token(text)
    from_token = F.when(
        tok.isNotNull(),
        F.struct(
            F.when(tok["kind"] == "fdi", tok["value"]).alias("fdi"),
            F.when(tok["kind"] == "key", tok["value"]).alias("template_key"),
        ),
    )
    return F.coalesce(pasted_entry(text), from_token)


def key_list(text: Column | str) -> Column:
    """ARRAY<STRING> of hand-typed keys: distinct ignoring case, first spelling and order kept."""
    parts = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)[\s,;]+"), lambda s: s != "")
    low = F.transform(parts, lambda s: F.lower(s))
    return F.filter(parts, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def output_name(day: Column | str, fdi: Column | str, key: Column | str, call_id: Column | None = None) -> Column:
    stem = F.concat_ws(
        "_", F.date_format(col(day), "yyyyMMdd"),
        F.coalesce(F.nullif(col(fdi), F.lit("")), F.lit(NO_FDI)), col(key),
        *([F.nullif(call_id, F.lit(""))] if call_id is not None else []),
    )
    return F.concat(stem, F.lit(".json"))


def _cut(c: Column) -> Column:
    """At most 120 characters, the extension (up to 16) kept; NULL when nothing usable is left."""
    raw_ext = F.regexp_extract(c, r"(?s)^(?:.*[^.])(\.[^.]*)$", 1)
    ext = F.when(F.length(raw_ext) <= 16, raw_ext).otherwise(F.lit(""))

    def join(e: Column) -> Column:
        root = F.left(c, F.length(c) - F.length(e))
        out = F.concat(F.regexp_replace(F.left(root, F.lit(COMPONENT_CAP) - F.length(e)), r"[ .]+$", ""), e)
        return let(out, lambda o: F.when(~o.rlike(r"^\.*$") & (o != e), o))

    return let(ext, join)


def _clean_name(name: Column, invalid: str, fallback: str) -> Column:
    c = F.regexp_replace(py_strip(F.regexp_replace(name, invalid, "_")), r"[ .]+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))


def _spare_device(c: Column, tail: str) -> Column:
    stem = F.rtrim(F.substring_index(c, ".", 1))
    return F.when(
        F.upper(stem).isin(*DEVICE_NAMES), F.concat(stem, F.lit(tail), F.substr(c, F.length(stem) + 1))).otherwise(c)


def safe_component(name: Column | str, fallback: str = "_") -> Column:
    """One path component every file system accepts, at most 120 characters, extension kept."""
    clean = let(_clean_name(col(name), INVALID_IN_NAME, fallback), lambda c: _spare_device(c, "_"))
    return let(clean, lambda c: F.when(F.length(c) > COMPONENT_CAP, F.coalesce(_cut(c), F.lit(fallback))).otherwise(c))


def slug(variant: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(variant)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_folder(name: Column | str, fallback: str = "iniziativa") -> Column:
    return let(_clean_name(col(name), INVALID_IN_FOLDER, fallback), lambda c: _spare_device(c, "_1"))


def key_ci(c: Column | str) -> Column:
    """The search form of a template key."""
    return ascii_lower(c)
