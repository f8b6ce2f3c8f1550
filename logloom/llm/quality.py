"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows.

1. ``rule_statistics`` reads every whole text once and counts words, symbols, repeated lines and repeated windows.
2. ``fit_forest`` takes a bounded, hash-ordered sample of labelled documents (``sample_rows``) and grows isolation trees: each
   tree splits a sub-sample at random values of random statistics; documents that are isolated early have short paths.
3. ``calibrate`` scores all labelled rows and picks the score above which rejecting pays: the largest Youden index
   among the thresholds that reject at most ``max_good_loss`` of the rows labelled good.

Null or empty texts have no words: they are counted as zeros and fail the base rule. Repeated rows get equal results.
Other columns are untouched; an empty table gives an empty result and a forest that rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, utf8, with_columns_checked

#: Fixed values of the base rule: symbols counted, fewest words, largest share of repeated words in percent.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the forest splits on. Repeated lines and words are left to the base rule: good texts hold them too.
FEATURES = ("symbol_share", "upper_share", "mark_share", "log_mean_word")


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(ids) < 3:
        return 0
    k = int(ids.max()) + 1
    pairs = ids[:-1] * k + ids[1:]
    if k > 1_000_000:  # number the pairs, so that three words still fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * k + ids[2:]
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    if not hit.any():
        return 0
    inside = np.zeros(len(ids), bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    """Counts of one UTF-8 text, then the raw parts of the features."""
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    chars = points - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b"!?"))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            seen.add(line)
    return n, chars, symbols, dup, _repeat_words(ids), upper, marks


def feature_matrix(s: np.ndarray) -> np.ndarray:
    """(rows, 7) raw counts to (rows, features)."""
    n, chars, symbols, _, _, upper, marks = s.T.astype(np.float64)
    one = lambda x: np.maximum(x, 1)
    return np.stack([
        symbols / one(chars), upper / one(chars), marks / one(chars), np.log1p(chars / one(n)),
    ], 1)


def base_failed(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, ``base_failed`` and the features."""
    with_columns_checked(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, "
              + ", ".join(f"{c} double" for c in FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.array([text_statistics(t) for t in utf8(batch.column(1))], np.int64)
            x = feature_matrix(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s[:, i]) for i in range(5)), pa.array(base_failed(s[:, 0], s[:, 4])),
                 *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                names=[id_col, *COUNTS, "base_failed", *FEATURES])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list) -> int:
    """Append the nodes below to ``out`` as (feature, value, left, right, path length) and return the node's place."""
    at = len(out)
    out.append(None)
    n = len(x)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if n > 1 else np.empty(0, int)
    if depth >= limit or not len(spread):
        out[at] = (-1, 0.0, at, at, depth + average_path(n))
        return at
    f = int(rng.choice(spread))
    lo, hi = x[:, f].min(), x[:, f].max()
    cut = rng.uniform(lo, hi)
    left = x[:, f] <= cut
    a = _grow(x[left], rng, depth + 1, limit, out)
    b = _grow(x[~left], rng, depth + 1, limit, out)
    out[at] = (f, cut, a, b, 0.0)
    return at


def average_path(n: float) -> float:
    """Mean path of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y): one 0/1 label per id, the larger where rows disagree; null ids and labels are ignored."""
    return labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))


def fit_forest(stats: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", label_col: str = "quality",
               trees: int = 200, leaf_sample: int = 256, sample_rows: int = 4096, contamination: float = 0.05,
               seed: int = 7) -> dict:
    """Isolation forest from a bounded sample of documents that pass the base rule, first by hash of the id.

    With labels the sample is ``sample_rows`` good rows and ``contamination`` times as many bad ones, so that anomalies
    are as rare in the trees as they should be; without usable labels it is ``sample_rows`` of all rows. These bounds
    are parameters of the method, not of the data: only the forest comes from the sample, thresholds and verdicts do not.
    """
    pool = stats.where(~F.col("base_failed"))
    first = lambda df, n: df.select(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), *FEATURES).orderBy(
        "h", *FEATURES).limit(n).collect()
    rows = []
    if labels is not None:
        known = pool.join(_labels(labels, id_col, label_col), F.col(id_col) == F.col("_id"))
        rows = first(known.where("_y = 1"), sample_rows)
        rows += first(known.where("_y = 0"), int(contamination * len(rows)))
    if not rows:
        rows = first(pool, sample_rows)
    x = np.array([[r[c] for c in FEATURES] for r in rows], np.float64).reshape(-1, len(FEATURES))
    rng = np.random.default_rng(seed)
    forest = []
    size = min(leaf_sample, len(x))
    limit = max(1, int(np.ceil(np.log2(max(2, size)))))
    for _ in range(trees if size > 1 else 0):
        nodes: list = []
        _grow(x[rng.choice(len(x), size, replace=False)], rng, 0, limit, nodes)
        f, cut, a, b, path = zip(*nodes)
        forest.append((np.array(f), np.array(cut), np.array(a), np.array(b), np.array(path)))
    return {"trees": forest, "norm": max(average_path(size), 1e-9), "limit": limit}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / normal path): near 1 for isolated rows; 0 without a forest."""
    if not forest["trees"] or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for f, cut, a, b, path in forest["trees"]:
        at = np.zeros(len(x), np.int64)
        for _ in range(forest["limit"]):
            split = f[at]
            go = x[rows, np.maximum(split, 0)] <= cut[at]
            at = np.where(split < 0, at, np.where(go, a[at], b[at]))
        total += path[at]
    return 2.0 ** (-(total / len(forest["trees"])) / forest["norm"])


def with_anomaly(stats: DataFrame, forest: dict) -> DataFrame:
    """``stats`` with the column ``anomaly``."""
    names = list(stats.columns)
    target = free_name(stats, "anomaly")
    if target != "anomaly":
        raise ValueError("the statistics already have a column anomaly")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(forest, x))], names=[*names, "anomaly"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(run, fields + ", anomaly double")


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
              max_good_loss: float = 0.002, bins: int = 1000) -> float:
    """The anomaly score from which a document is rejected, from all labelled rows.

    The scores of rows that pass the base rule are counted in ``bins`` equal steps per label; the threshold is a bin edge.
    Without labelled rows of both kinds nothing is rejected (infinity). Null ids and labels are ignored.
    """
    marks = _labels(labels, id_col, label_col)
    counts = (scored.where(~F.col("base_failed")).join(marks, scored[id_col] == F.col("_id"))
              .groupBy(F.least(F.lit(bins - 1), F.floor(F.col("anomaly") * bins)).alias("bin"))
              .agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad")).collect())
    good, bad = np.zeros(bins), np.zeros(bins)
    for r in counts:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return float("inf")
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    value = np.where(lost <= max_good_loss, caught - lost, -1.0)
    best = int(value.argmax())
    return best / bins if value[best] > 0 else float("inf")


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> tuple[dict, float]:
    """Forest and threshold for a table of statistics (read several times: pass a written table)."""
    forest = fit_forest(stats, labels, id_col, **options)
    return forest, calibrate(with_anomaly(stats, forest), labels, id_col)


def verdicts(stats: DataFrame, forest: dict, threshold: float) -> DataFrame:
    """The statistics with ``anomaly`` and ``kept``."""
    return with_anomaly(stats, forest).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(float(threshold))))


def keep_good(docs: DataFrame, forest: dict, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are; one pass, no shuffle."""
    with_columns_checked(docs, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.array([text_statistics(t) for t in utf8(batch.column(place))], np.int64)
            keep = ~base_failed(s[:, 0], s[:, 4]) & (anomaly(forest, feature_matrix(s)) < threshold)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
