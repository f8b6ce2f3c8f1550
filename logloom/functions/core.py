"""Small column helpers used by every family."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII letters, for a case fold that leaves accented letters alone.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Case fold of A-Z only (an accented capital stays as it is)."""
    return F.translate(col(c), ASCII_UPPER, ASCII_LOWER)


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(t != "", t)


def group(c: Column | str, pattern: str, idx: int) -> Column:
    """A regex group, NULL (not '') when the pattern does not match."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, idx))


def one_of(c: Column, values: Iterable[str]) -> Column:
    return c.isin(*list(values))


def first_where(arr: Column, pred) -> Column:
    """First element of an array meeting ``pred``; NULL when none does."""
    return F.get(F.filter(arr, pred), F.lit(0))


def label(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None).cast("string")
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Position of a value in a short fixed order; past the end when unknown."""
    out = F.lit(len(order))
    for i in range(len(order) - 1, -1, -1):
        out = F.when(c == order[i], F.lit(i)).otherwise(out)
    return out


def squeeze(c: Column) -> Column:
    """Runs of whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, fn) -> Column:
    """Bind ``value`` once inside an expression.

    For cold, deeply nested expressions: the body is interpreted per row, but the value is not
    copied into every place that uses it, so generated code stays small.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))
