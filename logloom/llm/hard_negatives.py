"""Hard negatives by slot-decomposed selection: windows below each positive's score, answered from disjoint slots.

Rows carry an id, a label and an integer vector; some are anchors. An anchor's positives are its best rows of the same label.
Each positive opens a window of scores, from ``low`` to ``high`` hundredths of its own, and wants the best ``negatives`` rows of
other labels in it. The windows of an anchor overlap, so they are not searched one by one: the positives' upper limits cut
the scores into disjoint slots, and a row of another label falls into one slot. A combiner keeps the best ``negatives`` rows
of each slot, in the task and again behind the shuffle. Going down the slots, every slot's list is put in front of the list of all
lower slots (all its scores are higher), cut, and answers the windows that start there; lower limits cut the answers' ends.

The stated queries (anchors) meet all rows in blocks of at most ``block_rows``: with R blocks of rows and A of anchors the grid
has R x A cells, each a cogroup of one block of either side, whatever the labels; no label and no id is a key, so none can be
hot. A cell's matrix is scored in tiles. What leaves a cell is bounded: a few rows per anchor and slot. Positives are scored
only against the rows of their label, which stand together in a block.

Defined results. Rows with a null id, label, vector or component, or a non-finite component, take no part. A row never meets
rows of its own id; otherwise repeated rows count each, as positives and negatives, and repeated anchors are answered each.
Vectors are compared with vectors of equal length only; empty ones score 0. Components beyond a 64-bit integer are clipped to it,
and so are scores; products are exact before. Ties go to the smaller id. Extra columns are ignored. No anchors, no positives
or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_per_group
from .common import Scratch, with_columns_checked

TILE = 512
NONE = np.iinfo(np.int64).min
LONG = np.iinfo(np.int64)
BLOCK = "block int, base long, dim int, kind string, ids binary, labels binary, vectors binary"


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, anchor_col: str, scale: int) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part; v holds floor(scale * component)."""
    with_columns_checked(vectors, id_col, label_col, vector_col, anchor_col)
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & sound)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"),
                    F.coalesce(F.col(anchor_col), F.lit(False)).alias("anchor")))


def blocks(rows: DataFrame, count: int, block_rows: int) -> DataFrame:
    """The rows dealt into blocks of about ``block_rows``; a block's rows of equal vector length are one matrix, by (label, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, labels, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            values, size = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                held.setdefault(dim, []).append((ids[at], labels[at], values[begin[at][:, None] + np.arange(dim)]))
        base = 0
        for dim, parts in held.items():
            ids, labels, matrix = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, labels))
            most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            yield pa.RecordBatch.from_pylist([{
                "block": TaskContext.get().partitionId(), "base": base, "dim": dim, "kind": kind,
                "ids": ids[order].astype("<i8").tobytes(), "labels": labels[order].astype("<i8").tobytes(),
                "vectors": matrix[order].astype(kind).tobytes()}], SCHEMA)
            base += len(ids)

    return rows.select("id", "label", "v").repartition(max(1, -(-count // block_rows))).mapInArrow(run, BLOCK)


SCHEMA = pa.schema([("block", pa.int32()), ("base", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()),
                    ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and matrix of a block row."""
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["dim"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, clipped to 64 bits."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if most(a) * most(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LONG.min + 1, LONG.max).astype(np.int64)


def keyed(scores: np.ndarray, rank: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the columns in ascending order of (score, descending id rank), and how many are out of the running.

    Those come first. Score and rank share one 64-bit key where they fit, so that a plain sort does it.
    """
    n = scores.shape[1]
    if n and int(np.abs(scores).max(initial=0)) < (1 << 61) // n:
        key = np.where(out, NONE, scores * n + (n - 1 - rank))
        key.sort(axis=1)
        column = np.argsort(rank)
        return column[np.where(key == NONE, 0, n - 1 - key % n)], (key == NONE).sum(axis=1)
    order = np.empty(scores.shape, np.int64)
    for i in range(len(scores)):
        order[i] = np.lexsort((-rank, scores[i], ~out[i]))
    return order, out.sum(axis=1)


def best_of_label(anchors: dict, rows: dict, k: int) -> Iterator[tuple]:
    """(anchor numbers, anchor ids, scores, ids): the best ``k`` rows of each anchor's label in one block."""
    if anchors["dim"] != rows["dim"]:
        return
    a_ids, a_labels, a = opened(anchors)
    ids, labels, b = opened(rows)
    for label in np.intersect1d(a_labels, labels).tolist():
        lo, hi = np.searchsorted(a_labels, [label, label + 1]) if label < LONG.max else (np.searchsorted(a_labels, label), len(a_labels))
        x, y = np.searchsorted(labels, [label, label + 1]) if label < LONG.max else (np.searchsorted(labels, label), len(labels))
        for s in range(lo, hi, TILE):
            e = min(s + TILE, hi)
            scores = products(a[s:e], b[x:y])
            order, gone = keyed(scores, np.arange(y - x), a_ids[s:e, None] == ids[None, x:y])
            top = order[:, -k:][:, ::-1]
            place = np.arange(y - x)[::-1][:top.shape[1]]
            i, j = np.nonzero(place[None, :] >= gone[:, None])
            at = top[i, j]
            yield anchors["base"] + s + i, a_ids[s + i], scores[i, at], ids[x + at]


def best_of_slots(anchors: dict, rows: dict, k: int) -> Iterator[tuple]:
    """(anchor numbers, slots, scores, ids): the best ``k`` rows of other labels in each slot of each anchor in one block."""
    if anchors["dim"] != rows["dim"]:
        return
    a_ids, a_labels, a = opened(anchors)
    ids, labels, b = opened(rows)
    upper = np.frombuffer(anchors["upper"], "<i8").reshape(len(a_ids), -1)
    floor = np.frombuffer(anchors["floor"], "<i8")
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    for s in range(0, len(a_ids), TILE):
        t = slice(s, s + TILE)
        scores = products(a[t], b)
        out = ((scores > upper[t, :1]) | (scores < floor[t, None]) | (a_labels[t, None] == labels[None, :])
               | (a_ids[t, None] == ids[None, :]))
        order, gone = keyed(scores, rank, out)
        ranked = np.take_along_axis(scores, order, axis=1)
        running = np.arange(len(ids))[None, :] >= gone[:, None]
        end = np.full(len(ranked), len(ids))
        for slot in range(upper.shape[1]):
            lower = upper[t, slot + 1] if slot + 1 < upper.shape[1] else np.full(len(ranked), NONE)
            begin = gone + (running & (ranked <= lower[:, None])).sum(axis=1)
            place = end[:, None] - 1 - np.arange(min(k, len(ids)))[None, :]
            i, j = np.nonzero(place >= begin[:, None])
            at = order[i, place[i, j]]
            yield anchors["base"] + s + i, np.full(len(i), slot), scores[i, at], ids[at]
            end = begin


def windows(score: int, low: int, high: int) -> tuple[int, int]:
    """(lowest, highest) integer n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _grid(left: DataFrame, right: DataFrame, rows: int, anchors: int, work, k: int, second: str) -> DataFrame:
    """``work`` on every pair of a block of anchors and a block of rows; a cell's result is a table of numpy columns."""
    names = ["anchor", second, "score", "id"]

    def cell(_key: tuple, some: pa.Table, those: pa.Table) -> pa.Table:
        found = [part for a in some.to_pylist() for b in those.to_pylist()
                 for part in ((np.asarray(x, np.int64) for x in (p[0] + (a["block"] << 32), *p[1:])) for p in work(a, b, k))]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    some = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("j", F.col("block"))
    those = right.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(anchors - 1))))
    return some.groupBy("i", "j").cogroup(those.groupBy("i", "j")).applyInArrow(cell, ", ".join(f"{n} long" for n in names))


def _with_slots(anchors: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Anchor blocks with the upper limits of each anchor's slots (descending) and the lowest limit of its windows."""

    def attach(_key: tuple, some: pa.Table, scores: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for number, score in zip(scores["anchor"].to_pylist(), scores["score"].to_pylist()):
            lowest, highest = windows(score, low, high)
            if lowest <= highest:
                found.setdefault(number & 0xFFFFFFFF, []).append((highest, lowest))
        out = []
        for row in some.to_pylist():
            n = len(row["ids"]) // 8
            upper, floor = np.full((n, k), NONE, "<i8"), np.full(n, LONG.max, "<i8")
            for i in range(n):
                limits = found.get(row["base"] + i, [])
                cuts = sorted({u for u, _ in limits}, reverse=True)
                upper[i, :len(cuts)] = cuts
                floor[i] = min((x for _, x in limits), default=LONG.max)
            out.append(row | {"upper": upper.tobytes(), "floor": floor.tobytes()})
        return pa.Table.from_pylist(out, SCHEMA.append(pa.field("upper", pa.binary())).append(pa.field("floor", pa.binary())))

    keyed_positives = positives.select(F.shiftright("anchor", 32).cast("int").alias("block"), "anchor", "score")
    return anchors.groupBy("block").cogroup(keyed_positives.groupBy("block")).applyInArrow(attach, f"{BLOCK}, upper binary, floor binary")


def answered(slots: list[list[tuple[int, int]]], k: int) -> list[list[tuple[int, int]]]:
    """For each slot the best ``k`` of it and all lower ones; slots and their (score, id) lists descend."""
    out, below = [], []
    for own in reversed(slots):
        below = (own + below)[:k]
        out.append(below)
    return out[::-1]


def _answers(per_anchor: DataFrame, k: int, low: int, high: int) -> DataFrame:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, positives, candidates in zip(*(c.to_pylist() for c in batch.columns)):
                limits = [(p["id"], p["score"], *windows(p["score"], low, high)) for p in positives]
                cuts = sorted({u for *_, x, u in limits if x <= u}, reverse=True)
                slots: list[list] = [[] for _ in cuts]
                for c in candidates:
                    slots[c["slot"]].append((-c["score"], c["id"]))
                merged = dict(zip(cuts, answered([sorted(s) for s in slots], k)))
                for ident, score, lowest, highest in limits:
                    inside = [(-s, i) for s, i in merged.get(highest, []) if -s >= lowest] if lowest <= highest else []
                    rows.extend((anchor, ident, r + 1, i, score, s) for r, (s, i) in enumerate(inside))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return per_anchor.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         anchor_col: str = "anchor", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         block_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows marked in ``anchor_col``."""
    rows = scratch.write(quantised(vectors, id_col, label_col, vector_col, anchor_col, scale), "rows")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    right = scratch.write(blocks(rows, n, block_rows), "blocks")
    left = scratch.write(blocks(rows.where("anchor"), n_anchors, block_rows), "anchors")
    grid = (max(1, -(-n // block_rows)), max(1, -(-n_anchors // block_rows)))
    descending = [F.desc("score"), F.asc("id")]
    near = scratch.write(top_per_group(_grid(left, right, *grid, best_of_label, positives, "anchor_id"), ["anchor"], descending, positives),
                         "positives")
    slotted = _with_slots(left, near, positives, low, high)
    kept = top_per_group(_grid(slotted, right, *grid, best_of_slots, negatives, "slot"), ["anchor", "slot"], descending, negatives)
    candidates = kept.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("candidates"))
    asked = near.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    return _answers(asked.join(candidates, "anchor").select("anchor_id", "positives", "candidates"), negatives, low, high)
