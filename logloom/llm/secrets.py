"""Secrets: credential parts are found by pattern and linked when complementary parts stand in one scope.

Strong parts are reported wherever they are: ``assign`` (a keyword with its value), ``access`` (an access identifier) and
``hex`` (a long hexadecimal run). Weak parts are only candidates: ``secret`` (a 40-character mixed key), ``login`` (a user or
client name) and ``endpoint`` (a URL or service host). A scope is ``reach`` code points around a part; the interval join
of parts in one text reports a weak part only where the parts that complete it overlap its scope:

* ``secret`` with an access identifier or a login,
* ``login`` with a secret, a hex run or an assignment,
* ``endpoint`` with an identifier (access or login) and a secret-like part (secret, hex, assignment).

Only built-in functions and no shuffle: the parts of one text are joined inside its row. Null or empty texts give no spans;
other columns pass through; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns_checked
from .spans import listing, located, matches, named

#: Kinds in the order of their ranks, and their patterns.
KINDS = ("assign", "access", "hex", "secret", "login", "endpoint")
BASE = KINDS[:3]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]++",
    "secret": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "login": r"""(?i:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,64}""",
    "endpoint": r"(?<![A-Za-z0-9])(?:https?|s3|ftp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24


def find(docs: DataFrame, text_col: str = "text", out: str = "secrets", reach: int = 200) -> DataFrame:
    """``docs`` with ``out``: an array of structs (s, k, e, kind), sorted by start, then kind."""
    with_columns_checked(docs, text_col)
    text = f"_{out}_text"
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    t = F.col(text)
    # A maximal run of hexadecimal digits shorter than MIN_HEX fails anyway: asking for MIN_HEX finds the same runs.
    used = PATTERNS | {"hex": r"(?<![0-9a-f])[0-9a-f]{%d,}+" % MIN_HEX}
    # The start of the pattern itself, so that a hint holds wherever its pattern matches.
    hints = {
        "assign": t.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), "access": F.contains(t, F.lit("AKIA")),
        "hex": t.rlike("[0-9a-f]{%d}" % MIN_HEX), "secret": t.rlike("[A-Za-z0-9+/]{40}"),
        "login": t.rlike(r"""(?i:user(?:name)?|login|client_id|account)["']?\x20*[:=]"""), "endpoint": F.contains(t, F.lit("://")),
    }
    df = df.withColumns({f"_{out}_m_{k}": matches(t, used[k], hints[k]) for k in KINDS})
    df = df.withColumns({f"_{out}_s_{k}": located(t, used[k], F.col(f"_{out}_m_{k}")) for k in KINDS}
                        | {f"_{out}_v": F.when(F.size(f"_{out}_m_assign") > 0, F.regexp_extract_all(
                            t, F.lit(PATTERNS["assign"]), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))})
    raw = lambda k: F.col(f"_{out}_s_{k}")
    values = F.col(f"_{out}_v")
    tests = {
        "assign": F.filter(raw("assign"), lambda x, i: F.length(F.get(values, i)) >= MIN_VALUE),
        "access": F.filter(raw("access"), lambda x: x["e"] - x["s"] >= MIN_ACCESS),
        "hex": F.filter(raw("hex"), lambda x: x["e"] - x["s"] >= MIN_HEX),
        # a key mixes cases and digits; a hexadecimal run of that length is no key
        "secret": F.filter(raw("secret"), lambda x: x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]") & x["m"].rlike("[0-9]")),
        "login": raw("login"), "endpoint": raw("endpoint"),
    }
    df = df.withColumns({f"_{out}_p_{k}": tests[k] for k in KINDS})
    part = lambda k: F.col(f"_{out}_p_{k}")

    def near(x: Column, *kinds: str) -> Column:
        """Whether a part of one of the kinds overlaps the scope of ``x``."""
        hit = F.lit(False)
        for k in kinds:
            hit = hit | F.exists(part(k), lambda y: (y["s"] < x["e"] + reach) & (y["e"] > x["s"] - reach) & (
                (y["s"] != x["s"]) | (y["e"] != x["e"])))
        return hit

    linked = {
        "secret": F.filter(part("secret"), lambda x: near(x, "access", "login")),
        "login": F.filter(part("login"), lambda x: near(x, "secret", "hex", "assign")),
        "endpoint": F.filter(part("endpoint"), lambda x: near(x, "access", "login") & near(x, "secret", "hex", "assign")),
    }
    df = df.withColumn(out, F.array_sort(F.concat(*(
        named(linked.get(k, part(k)), k, i) for i, k in enumerate(KINDS)))))
    return df.drop(text, f"_{out}_v", *(f"_{out}_{p}_{k}" for k in KINDS for p in "msp"))


def digest(found: DataFrame, id_col: str = "doc_id", spans: str = "secrets") -> DataFrame:
    """Counts per base kind, the hash of the base spans and the list of all spans."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(s, lambda x: x["k"] < len(BASE))
    return found.select(F.col(id_col), *(count(k) for k in BASE), F.sha2(listing(base), 256).alias("base_sha256"),
                        listing(s).alias("spans"))
