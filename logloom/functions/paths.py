"""Dates, environments and canonical locations read from paths."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, first_where

# How a day is written in a path element.
DATE_YMD = r"(?<!\d)(\d{4})([-_.])(\d{2})\2(\d{2})(?!\d)"
DATE_DMY = r"(?<!\d)(\d{2})([-_.])(\d{2})\2(\d{4})(?!\d)"
DATE_RUN = r"(?<!\d)(\d{8})(?!\d)"
FIRST_DAY = "2020-01-01"
NO_DATE = "nessuna data nel nome"
AMBIGUOUS = "data ambigua"
IGNORE_FOLDER = "ignora"


def day_from_name(name: Column | str) -> Column:
    name = col(name)
    return F.when(name.rlike(r"^\d{8}\.txt$"), F.try_to_date(F.left(name, F.lit(8)), "yyyyMMdd"))


def day_file_name(day: Column | str) -> Column:
    return F.concat(F.date_format(col(day), "yyyyMMdd"), F.lit(".txt"))


def relative_path(env: Column | str, day: Column | str) -> Column:
    d = col(day)
    return F.concat_ws("/", col(env), F.date_format(d, "yyyy"), F.date_format(d, "MM"), day_file_name(d))


def local_path(root: str, env: Column | str, day: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), relative_path(env, day))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")


def element_dates(text: Column, today: Column) -> Column:
    """ARRAY<DATE>: every real day a path element holds, all readings, no repeats."""
    s = F.substring
    ymd = F.transform(F.regexp_extract_all(text, F.lit(DATE_YMD), F.lit(0)),
                      lambda t: _iso(s(t, 1, 4), s(t, 6, 2), s(t, 9, 2)))
    dmy = F.transform(F.regexp_extract_all(text, F.lit(DATE_DMY), F.lit(0)),
                      lambda t: _iso(s(t, 7, 4), s(t, 4, 2), s(t, 1, 2)))
    runs = F.regexp_extract_all(text, F.lit(DATE_RUN), F.lit(0))
    run_ymd = F.transform(runs, lambda t: _iso(s(t, 1, 4), s(t, 5, 2), s(t, 7, 2)))
    run_dmy = F.transform(runs, lambda t: _iso(s(t, 5, 4), s(t, 3, 2), s(t, 1, 2)))
    every = F.array_distinct(F.concat(ymd, dmy, run_ymd, run_dmy))
    return F.filter(
        every, lambda d: d.isNotNull() & (d >= F.lit(FIRST_DAY).cast("date")) & (d <= F.date_add(today, 1)))


def strip_dates(text: Column) -> Column:
    for p in (DATE_YMD, DATE_DMY, DATE_RUN):
        text = F.regexp_replace(text, p, " ")
    return text


def path_day(parts: Column, today: Column) -> Column:
    """STRUCT<day, reason>; ``parts`` holds the path elements, nearest first."""
    dates = F.transform(parts, lambda p: element_dates(p, today))
    head = F.get(dates, F.lit(0))
    near = first_where(dates, lambda a: F.size(a) > 0)
    name, month, year = (F.get(parts, F.lit(i)) for i in range(3))
    d = F.regexp_extract(name, r"^(\d{1,2})(\.[^.]*)?$", 1)
    folder_day = F.when(
        (d != "") & month.rlike(r"^\d{1,2}$") & year.rlike(r"^\d{4}$"),
        _iso(year, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")),
    )
    folder_day = F.when(
        (folder_day >= F.lit(FIRST_DAY).cast("date")) & (folder_day <= F.date_add(today, 1)), folder_day)

    def out(day: Column, why: Column) -> Column:
        return F.struct(day.cast("date").alias("day"), why.cast("string").alias("reason"))

    none = F.lit(None)
    return (
        F.when(F.size(head) > 1, out(none, F.lit(AMBIGUOUS)))
        .when(F.size(head) == 1, out(F.get(head, F.lit(0)), none))
        .when(folder_day.isNotNull(), out(folder_day, none))
        .when(name.rlike(r"\d{6,}"), out(none, F.lit(AMBIGUOUS)))
        .when(near.isNull(), out(none, F.lit(NO_DATE)))
        .when(F.size(near) > 1, out(none, F.lit(AMBIGUOUS)))
        .otherwise(out(F.get(near, F.lit(0)), none))
    )


def path_env(parts: Column, env_names: Sequence[str]) -> Column:
    """The configured environment the nearest naming element holds; a tie is NULL."""
    def named(part: Column) -> Column:
        text = F.lower(strip_dates(part))
        found = F.array_compact(F.array(*[
            F.when(text.rlike(r"(?<![a-z0-9])" + re.escape(n.lower()) + r"(?![a-z])"), F.lit(n))
            for n in env_names
        ]))
        longest = F.array_max(F.transform(found, lambda n: F.length(n)))
        return F.filter(found, lambda n: F.length(n) == longest)

    if not env_names:
        return F.lit(None).cast("string")
    best = first_where(F.transform(parts, named), lambda a: F.size(a) > 0)
    return F.when(F.size(best) == 1, F.get(best, F.lit(0)))


def folder_choice(rel_path: Column, folder_envs: Mapping[str, str], env_names: Sequence[str],
                  root: str = "") -> Column:
    """The deepest assigned ancestor folder: a configured name, ``ignora`` or NULL.

    The map is user configuration (a handful of folders), so it travels as literals.
    """
    by_lower = {e.lower(): e for e in env_names}
    table: dict[str, str] = {}
    root = root.rstrip("/")
    for key, value in folder_envs.items():
        k = key.replace("\\", "/")
        if k.startswith("/"):
            if not (k.rstrip("/") == root or k.startswith(root + "/")):
                continue
            k = k[len(root):]
        k = k.strip("/")
        k = "" if k == "." else k.lower()
        chosen = IGNORE_FOLDER if value == IGNORE_FOLDER else by_lower.get(value.lower())
        if chosen is not None:
            table.setdefault(k, chosen)
    if not table:
        return F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    dirs = F.split(rel_path, "/")
    n = F.size(dirs) - 1
    ancestors = F.transform(
        F.sequence(n, F.lit(0), F.lit(-1)), lambda i: F.lower(F.array_join(F.slice(dirs, 1, i), "/")))
    return first_where(F.transform(ancestors, lambda a: F.try_element_at(lookup, a)), lambda v: v.isNotNull())
