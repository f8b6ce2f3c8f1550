"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are reported whenever their own test holds (parts up to 255, Luhn, number
of digits). Two more kinds are proposed by looser patterns and reported only if their score reaches ``threshold``:
``iban`` (mod-97) and ``ssn`` / ``local_phone`` (no checksum: a context word must stand near). Only built-in functions; no
shuffle: a row is read and answered where it lies.

Null or empty texts give no spans. Any other column is passed through; repeated rows get equal results; an empty table
gives an empty result. Very long texts are scanned whole: quantifiers are possessive, so matching does not backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_columns_checked
from .spans import listing, located, masked, matches

#: The patterns of the base kinds and of the added ones, in the order of their ranks.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+] )(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: Score of a proposed span, of a confirmed checksum, and of a context word within ``reach`` code points before.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.2, "local_phone": 0.2}
CHECKED = 0.6
CONTEXT = 0.5
CONTEXT_WORDS = {
    "email": r"e-?mail|contact|mailto",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|master|credit|payment",
    "phone": r"phone|\btel|call|fax|mobile",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"\bssn\b|social security|tax id",
    "local_phone": r"phone|\btel\b|call me|fax|mobile",
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check (empty: no)."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(
            i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    return (F.length(number) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an international account number passes the mod-97 check: letters count as 10 to 35, first four moved last."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise(
        (acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(plain).between(15, 34) & (rest == 1)


def octets(address: Column) -> Column:
    """Whether all parts of a dotted number are at most 255 (leading zeros do not count)."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(address, r"\."), lambda p: (F.length(part(p)) <= 3) & (
        F.substring(part(p), 1, 3).cast("int") <= 255))


#: The test of each kind, on the matched string.
TESTS = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "local_phone": lambda m: F.lit(True),
}
HAS_CHECKSUM = ("ip", "card", "iban")
BASE = KINDS[:4]


def find(docs: DataFrame, text_col: str = "text", out: str = "pii", threshold: float = 0.65, reach: int = 40) -> DataFrame:
    """``docs`` with ``out``: an array of structs (s, k, e, kind, score), sorted by start, then kind.

    ``reach`` is how far before a span a context word is looked for, in code points.
    """
    with_columns_checked(docs, text_col)
    text = f"_{out}_text"
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    t = F.col(text)
    digit = t.rlike("[0-9]")
    hints = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "iban": t.rlike("[A-Z]{2}[0-9]{2}"),
             "ip": digit, "card": digit, "ssn": t.rlike("[0-9]-[0-9]"), "local_phone": t.rlike("[0-9]{3}\\)?[ .-][0-9]{3}")}
    df = df.withColumns({f"_{out}_m_{k}": matches(t, PATTERNS[k], hints[k]) for k in KINDS})
    df = df.withColumns({f"_{out}_s_{k}": located(t, PATTERNS[k], F.col(f"_{out}_m_{k}")) for k in KINDS})

    def scored(kind: str, rank: int) -> Column:
        def one(x: Column) -> Column:
            before = F.lower(F.substring(t, F.greatest(x["s"] - reach, F.lit(0)) + 1, F.least(x["s"], F.lit(reach))))
            score = F.lit(PRIOR[kind]) + F.lit(CHECKED if kind in HAS_CHECKSUM else 0.0) + F.when(
                before.rlike(CONTEXT_WORDS[kind]), F.lit(CONTEXT)).otherwise(F.lit(0.0))
            return F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"),
                            F.least(score, F.lit(1.0)).alias("score"))

        good = F.transform(F.filter(F.col(f"_{out}_s_{kind}"), lambda x: TESTS[kind](x["m"])), one)
        return good if kind in BASE else F.filter(good, lambda x: x["score"] >= threshold)

    df = df.withColumn(out, F.array_sort(F.concat(*(scored(k, i) for i, k in enumerate(KINDS)))))
    return df.drop(text, *(f"_{out}_{p}_{k}" for k in KINDS for p in "ms"))


def digest(found: DataFrame, id_col: str = "doc_id", spans: str = "pii") -> DataFrame:
    """Counts per base kind, the hash of the base spans and the list of all spans."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(s, lambda x: x["k"] < len(BASE))
    return found.select(F.col(id_col), *(count(k) for k in BASE), F.sha2(listing(base), 256).alias("base_sha256"),
                        listing(s).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; same columns. A null text stays null."""
    out = free_name(docs, "pii")
    found = find(docs, text_col, out=out)
    clean = masked(F.col(text_col), F.col(out), lambda x: F.concat(F.lit("<"), x["kind"], F.lit(">")))
    return found.withColumn(text_col, clean).select(*docs.columns)


