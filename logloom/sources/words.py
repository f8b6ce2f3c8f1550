"""Positioned characters to words, reading order, lines and blocks, with the scan test."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intervals import marked

GAP, LINE_HALF = 0.25, 0.5
PARAGRAPH_GAP, PITCH_CAP, INDENT_CHARS, SIZE_CHANGE = 1.5, 1.25, 2.0, 0.15


def chars_to_words(chars: DataFrame) -> DataFrame:
    """words(doc, page, pos, text, box, size, bold) of chars(doc, page, i, c, x0, y0, x1, y1, size, bold).

    A new word on whitespace, another line, a jump back or a gap over a quarter of the height;
    a page is the window.
    """
    w = Window.partitionBy("doc", "page").orderBy("i")
    blank = F.col("c").rlike(r"^\s*$")
    h = F.greatest(F.lag(F.col("y1") - F.col("y0")).over(w), F.lit(0.1))
    far = (F.col("y0") >= F.lag("y1").over(w)) | (F.col("y1") <= F.lag("y0").over(w)) | (F.col("x1") < F.lag("x0").over(w)) | (
        F.col("x0") - F.lag("x1").over(w) > GAP * h)
    starts = F.coalesce(far | F.lag(blank).over(w), F.lit(True))
    d = chars.withColumn("_b", blank).withColumn("_w", F.sum(starts.cast("int")).over(w)).where(~F.col("_b"))
    s = F.array_sort(F.collect_list(F.struct("i", "c", "size", "bold")))
    out = d.groupBy("doc", "page", "_w").agg(
        F.min("i").alias("pos"), s.alias("s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.select("doc", "page", "pos", F.array_join(F.transform("s", lambda x: x["c"]), "").alias("text"), "x0", "y0", "x1", "y1",
                      F.get("s", F.lit(0))["size"].alias("size"), F.get("s", F.lit(0))["bold"].alias("bold"))


def reading_order(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Words on the page, clustered to lines by centre, top to bottom then left to right; ``pos`` renumbered per page."""
    size = sizes.select("doc", "page", F.struct("width", "height").alias("_size"))
    on = marked(words, size, ["doc", "page"], "_size").where((F.col("x1") > 0) & (F.col("y1") > 0) & (F.col("x0") < F.col("_size.width")) & (
        F.col("y0") < F.col("_size.height"))).drop("_size")
    c = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy("doc", "page").orderBy(c, F.col("x0"))
    new = F.coalesce(c - F.lag(c).over(w) > LINE_HALF * (F.col("y1") - F.col("y0")), F.lit(True))
    lined = on.withColumn("line", F.sum(new.cast("int")).over(w))
    return lined.withColumn("pos", F.row_number().over(Window.partitionBy("doc", "page").orderBy("line", "x0")))


def has_text(words: DataFrame, images: DataFrame, documents: DataFrame) -> DataFrame:
    """A document is a scan when every page has under five words and some page an image."""
    n = words.groupBy("doc", "page").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max("n").alias("most"))
    im = images.groupBy("doc").agg(F.count("*").alias("images"))
    scan = (F.coalesce("most", F.lit(0)) < 5) & (F.coalesce("images", F.lit(0)) > 0)
    return documents.select("doc").join(n, "doc", "left").join(im, "doc", "left").select("doc", (~scan).alias("has_text"))


def lines(words: DataFrame) -> DataFrame:
    """Adds ``line``: a word, by (y1, x0) on its page, joins the line of the word before where its bottom is within half a height of the
    bottom of the horizontally nearest word of that line.

    Where the bottoms alone decide, whichever word is the nearest, Spark tells; only stretches where they do not (columns on other
    baselines) are gone through word by word. A word without a bottom is a line of its own.
    """
    w = Window.partitionBy("doc", "page").orderBy("y1", "x0", "x1")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = F.col("y1") - F.col("y0")
    # Below all words before by more than half of the tallest of them: a new line for sure.
    apart = F.coalesce(F.col("y1") - F.lag("y1").over(w) > LINE_HALF * F.max(h).over(upto), F.lit(True))
    d = words.withColumn("_no", F.row_number().over(w)).withColumn("_apart", apart)
    # Within half of its own height of all since: no new line for sure.
    start = F.last(F.when(F.col("_apart"), F.col("y1")), ignorenulls=True).over(upto)
    d = d.withColumn("_doubt", ~F.col("_apart") & ~F.coalesce(F.col("y1") - start <= LINE_HALF * h, F.lit(False)))
    return d.withColumn("line", line_numbers("_no", "_apart", "_doubt", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])).drop("_no", "_apart", "_doubt")


class _Line:
    """The words of the line in hand, sorted by their left edges: (right, bottom, height)."""

    def __init__(self):
        self.xs: list[float] = []
        self.placed: list[tuple] = []

    def takes(self, left: float, top: float, right: float, bottom: float) -> bool:
        """Whether the bottom is within half a height of that of the nearest word; none is near a word without a bottom."""
        k = bisect.bisect_left(self.xs, left)
        near = self.placed[k - 1 if k else 0]
        if 0 < k < len(self.xs) and self.xs[k] - right < left - near[0]:
            near = self.placed[k]
        return bool(bottom - near[1] <= LINE_HALF * np.fmax(bottom - top, near[2]))

    def add(self, left: float, top: float, right: float, bottom: float) -> None:
        k = bisect.bisect_left(self.xs, left)
        self.xs.insert(k, left)
        self.placed.insert(k, (right, bottom, bottom - top))


def _numbered(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The line of each word in its page, of pages that follow each other, each by (y1, x0): word number, flags, box."""
    before = n = 0  # number and line of the last word
    hand: _Line | None = None  # the line in hand, where it is needed
    held: list[np.ndarray] = []  # its words so far, where it is not
    for no, apart, doubt, *box in batches:
        no, apart, doubt = (s.to_numpy() for s in (no, apart, doubt))
        if len(no) and ((no != np.r_[before + 1, no[:-1] + 1]) & (no != 1)).any():
            raise ValueError("the words of a page are not in order")
        x0, y0, x1, y1 = (s.to_numpy(dtype=float, na_value=np.nan) for s in box)
        x0 = np.where(np.isnan(x0), -np.inf, x0)
        boxes = np.column_stack([x0, y0, np.where(np.isnan(x1), x0, x1), y1])
        new = apart.astype(bool).copy()
        # stretches begin where a new line is sure; the first one may go on from the batch before
        starts = np.flatnonzero(new)
        for a, b in zip(np.r_[0, starts], np.r_[starts, len(no)]):
            if a < b and new[a]:
                hand, held = None, []
            if hand is None and not doubt[a:b].any():
                held.append(boxes[a:b])
                continue
            if hand is None:
                hand = _Line()
                for row in np.concatenate([*held, boxes[:0]]).tolist():
                    hand.add(*row)
                held = []
            for i, row in zip(range(a, b), boxes[a:b].tolist()):
                if hand.xs and not hand.takes(*row):
                    new[i], hand = True, _Line()
                hand.add(*row)
        line = np.cumsum(new)
        # counted from the first word of the page
        firsts = np.flatnonzero(no == 1)
        base = np.zeros(len(no), np.int64) - n
        for a, b in zip(firsts, np.r_[firsts[1:], len(no)]):
            base[a:b] = line[a] - 1
        line = line - base
        if len(no):
            before, n = int(no[-1]), int(line[-1])
        yield pd.Series(line)


#: It knows the words before, so a filter must not be moved to before it.
line_numbers = F.pandas_udf(_numbered, T.LongType()).asNondeterministic()


def line_table(words: DataFrame) -> DataFrame:
    """One row per line: text, box, size, indent."""
    s = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    return lines(words).groupBy("doc", "page", "line").agg(
        F.array_join(F.transform(s, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.percentile("size", F.lit(0.5)).alias("size"), F.count("*").alias("n_words"))


def is_form_row(text: Column) -> Column:
    return text.rlike(r"[._]{4,}|[☐☒]|\[ ?[xX]? ?\]")


def blocks(line_rows: DataFrame, char_width: DataFrame) -> DataFrame:
    """Adds ``block`` and ``kind``: paragraphs split on pitch, indent (from the second line) or size; form rows alone."""
    w = Window.partitionBy("doc", "page").orderBy("line")
    d = line_rows.withColumn("pitch", F.col("y1") - F.lag("y1").over(w)).withColumn("height", F.col("y1") - F.col("y0"))
    ref = d.groupBy("doc").agg(F.percentile("pitch", F.lit(0.5)).alias("p"), F.percentile("height", F.lit(0.5)).alias("h"))
    cap = PITCH_CAP * F.col("h")
    ref = ref.select("doc", F.when((F.col("h") > 0) & ((F.coalesce("p", F.lit(0.0)) <= 0) | (F.col("p") > cap)), cap).otherwise(F.col("p")).alias("ref"))
    d = d.join(ref, "doc").join(char_width, "doc").withColumn("form", is_form_row(F.col("text")))
    size, prev = F.col("size"), F.lag("size").over(w)
    hard = (
        F.lag("line").over(w).isNull() | F.col("form") | F.lag("form").over(w) | (F.col("pitch") > PARAGRAPH_GAP * F.col("ref"))
        | ((prev > 0) & (size > 0) & (F.abs(size - prev) > SIZE_CHANGE * F.greatest(size, prev))))
    d = d.withColumn("_h", F.coalesce(hard, F.lit(False)))
    # The indent counts from the paragraph's second line: its own line before must not start it.
    indent = ~F.col("_h") & ~F.lag("_h").over(w) & (F.abs(F.col("x0") - F.lag("x0").over(w)) > INDENT_CHARS * F.col("char"))
    d = d.withColumn("_n", F.col("_h") | F.coalesce(indent, F.lit(False)))
    return d.withColumn("block", F.sum(F.col("_n").cast("int")).over(w)).withColumn(
        "kind", F.when(F.col("form"), "riga_modulo").otherwise("paragrafo")).drop("_h", "_n", "form", "ref", "char", "pitch", "height")


def char_widths(words: DataFrame) -> DataFrame:
    ok = words.where((F.length("text") > 0) & (F.col("x1") > F.col("x0")))
    return ok.groupBy("doc").agg(F.percentile((F.col("x1") - F.col("x0")) / F.length("text"), F.lit(0.5)).alias("char"))
