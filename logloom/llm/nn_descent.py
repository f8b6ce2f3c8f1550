"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours.

Only vectors of equal, non-null labels and of equal length are compared; equal vectors of a label are one node with a weight, so
copies cost nothing. Vectors that are null, zero or hold null or non-finite components are no nodes and link with nothing.

1. **Start.** ``trees`` random orders: a vector's key is the string of its signs on random planes, and vectors that are close in
   the sorted order of a tree (windows of ``window`` rows) are compared. A sort has no hot bucket.
2. **Descent.** Each round joins every node's neighbours, forward and reverse, with one another, and each node keeps the best
   it has seen. Lists hold ``k`` neighbours; a list whose last neighbour still reaches the threshold is saturated and
   grows to twice its length, so no link is cut off. Rounds end when no link is new and, after ``least_rounds``, whatever else
   still changes; however many it takes, links that still change bring another round.
3. **Audit.** Nodes whose id is divisible by ``audit_every`` are compared with all nodes of their label, in blocks; recall is
   the share of their links that the graph holds. Below ``min_recall`` the descent goes on with more trees; if that has not
   helped by the fourth audit, all nodes are compared in blocks and the links are exact.

Cosines are computed in double precision from the stored components. Links are the graph's edges that reach the threshold, in
either direction. Repeated ids are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, with_columns_checked

EDGE = "a long, b long, sim double"


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(matrix in double, norms) of vectors of one length."""
    x = np.array(vectors, np.float64)
    return x, np.sqrt((x * x).sum(1))


def node_table(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, node, vec): ``node`` is null where the row links with nothing; vec is float64 little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            nodes, vecs = [], []
            for label, v in zip(labels.to_pylist(), vectors.to_pylist()):
                x = None if label is None or not v or None in v else np.array(v, np.float64) + 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    vecs.append(None)
                    continue
                raw = x.tobytes()
                nodes.append(xxhash.xxh3_64_intdigest(f"{label}:".encode() + raw) - (1 << 63))
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([ids, labels.cast(pa.string()), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())],
                                             names=["id", "label", "node", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(
        run, "id long, label string, node long, vec binary")


def best(sim: np.ndarray, k: np.ndarray, floor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best ``k`` entries above its floor, and of all that reach the threshold."""
    n = sim.shape[1]
    top = min(int(k.max(initial=0)), n)
    if not top:
        return np.empty(0, int), np.empty(0, int)
    part = np.argpartition(-sim, top - 1, 1)[:, :top]
    values = np.take_along_axis(sim, part, 1)
    order = np.argsort(-values, 1, kind="stable")
    part, values = np.take_along_axis(part, order, 1), np.take_along_axis(values, order, 1)
    take = (np.arange(top)[None, :] < k[:, None]) & (values > floor[:, None]) & np.isfinite(values)
    r, c = np.nonzero(take)
    rows, cols = r, part[r, c]
    a, b = np.nonzero(sim >= threshold)
    pairs = np.unique(np.r_[rows * n + cols, a * n + b])
    return pairs // n, pairs % n


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first column together, from sorted batches."""
    now, held = object(), []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now:
                if held:
                    yield held
                now, held = row[0], []
            held.append(row)
    if held:
        yield held


def edges_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "sim"])


def ordered_start(nodes: DataFrame, trees: int, window: int, k: int, threshold: float, seed: int) -> DataFrame:
    """Candidate edges from the random orders ``seed`` to ``seed`` + ``trees`` - 1."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(batch.column(2).to_pylist()):
                groups.setdefault(len(v) // 8, []).append(i)
            for dims, rows in groups.items():
                part = batch.take(pa.array(rows))
                x = np.stack([np.frombuffer(v, np.float64) for v in part.column(2).to_pylist()])
                for t in range(trees):
                    if (t, dims) not in planes:
                        planes[t, dims] = np.random.default_rng(seed + t).standard_normal((dims, 48))
                    bits = (x @ planes[t, dims] > 0).astype(np.int64)
                    key = (bits << np.arange(47, -1, -1)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), part.column(1), pa.array(key), *[part.column(i) for i in (0, 2)]],
                                                     names=["t", "label", "key", "node", "vec"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare() -> pa.RecordBatch:
            ids = np.array([r[3] for r in held], np.int64)
            x, norm = unit_rows([np.frombuffer(r[4], np.float64) for r in held])
            sim = x @ x.T / norm[:, None] / norm[None, :]
            np.fill_diagonal(sim, -np.inf)
            r, c = best(sim, np.full(len(ids), k), np.full(len(ids), -np.inf), threshold)
            return edges_batch([(ids[r], ids[c], sim[r, c])])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[:2] != held[-1][:2] or len(held) == window):
                    if len(held) > 1:
                        yield compare()
                    held = [] if row[:2] != held[-1][:2] else held[window // 2:]
                held.append(row)
        if len(held) > 1:
            yield compare()

    return (nodes.select("node", "label", "vec").mapInArrow(keys, "t int, label string, key long, node long, vec binary")
            .repartitionByRange("t", "label", "key", "node").sortWithinPartitions("t", "label", "key", "node").mapInArrow(windows, EDGE))


def keep_best(edges: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The graph: of each node's edges the best ``k`` and all that reach the threshold."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.join(lists, F.col("a") == F.col("node")).where((F.col("rank") <= F.col("k")) | (F.col("sim") >= threshold)).select(
        "a", "b", "sim", "rank", "k")


def descent_round(graph: DataFrame, nodes: DataFrame, lists: DataFrame, threshold: float, fan: int) -> DataFrame:
    """Candidate edges between the neighbours of each node, forward and reverse, the nearest ``fan`` of each kind.

    A link (an edge that reaches the threshold) joins in whatever its rank, up to ``fan`` per part: longer lists are cut into
    parts of ``fan`` by a hash, each with the node itself, so that one node never gathers an unbounded list.
    """
    reverse = graph.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a")))
    near = graph.where(F.col("rank") <= fan).select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
        reverse.where(F.col("r") <= fan).select(F.col("b").alias("v"), F.col("a").alias("u")))
    more = graph.where((F.col("rank") > fan) & (F.col("sim") >= threshold)).select(
        F.xxhash64("a", F.floor((F.col("rank") - 1) / fan)).alias("v"), F.col("b").alias("u"))
    more = more.unionByName(graph.where((F.col("rank") > fan) & (F.col("sim") >= threshold)).select(
        F.xxhash64("a", F.floor((F.col("rank") - 1) / fan)).alias("v"), F.col("a").alias("u")))
    members = near.unionByName(more).unionByName(nodes.select(F.col("node").alias("v"), F.col("node").alias("u"))).distinct()
    floor = graph.groupBy("a").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("sim"))).alias("last"))
    facts = nodes.select("node", "vec").join(floor, F.col("node") == F.col("a"), "left").join(
        lists.withColumnRenamed("k", "want").withColumnRenamed("node", "l"), F.col("node") == F.col("l")).select(
        "node", "vec", "want", F.when(F.col("n") >= F.col("want"), F.col("last")).alias("last"))
    rows = members.join(facts, F.col("u") == F.col("node")).select("v", "u", "vec", "want", "last")

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for held in by_key(batches):
            if len(held) < 2:
                continue
            ids = np.array([r[1] for r in held], np.int64)
            x, norm = unit_rows([np.frombuffer(r[2], np.float64) for r in held])
            sim = x @ x.T / norm[:, None] / norm[None, :]
            np.fill_diagonal(sim, -np.inf)
            floor = np.array([-np.inf if r[4] is None else r[4] for r in held])
            r, c = best(sim, np.array([q[3] for q in held]), floor, threshold)
            out.append((ids[r], ids[c], sim[r, c]))
            if len(out) == 256:
                yield edges_batch(out)
                out = []
        yield edges_batch(out)

    return rows.repartition("v").sortWithinPartitions("v").mapInArrow(local_join, EDGE)


def in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes packed as (label, ids, vecs) with at most ``size`` of them, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for label, node, vec in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(label, []).append((node, vec))
            rows = [(label, np.array([n for n, _ in g[i:i + size]], np.int64).tobytes(), b"".join(v for _, v in g[i:i + size]))
                    for label, g in groups.items() for i in range(0, len(g), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows) if rows else [()] * 3, (pa.string(), pa.binary(), pa.binary()))], names=["label", "ids", "vecs"])

    return nodes.select("label", "node", "vec").mapInArrow(run, "label string, ids binary, vecs binary")


def true_links(nodes: DataFrame, threshold: float, audit_every: int, block: int = 1024) -> DataFrame:
    """(a, b): the links of the audited nodes against all nodes of their label, block by block."""
    asked = in_blocks(nodes.where(F.pmod("first", F.lit(audit_every)) == 0), block).select(
        "label", F.col("ids").alias("asked"), F.col("vecs").alias("asked_vecs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, asked_ids, asked_vecs, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                qa, nb = np.frombuffer(asked_ids, np.int64), np.frombuffer(ids, np.int64)
                a, an = unit_rows(np.frombuffer(asked_vecs, np.float64).reshape(len(qa), -1))
                b, bn = unit_rows(np.frombuffer(vecs, np.float64).reshape(len(nb), -1))
                sim = a @ b.T / an[:, None] / bn[None, :]
                r, c = np.nonzero((sim >= threshold) & (qa[:, None] != nb[None, :]))
                yield edges_batch([(qa[r], nb[c], sim[r, c])])

    return asked.join(in_blocks(nodes, block), "label").mapInArrow(run, EDGE)


def near_duplicates(rows: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, k: int = 8, trees: int = 8, window: int = 96, rounds: int = 8, least_rounds: int = 2, settled: float = 0.02,
                    audit_every: int = 50, min_recall: float = 0.95, seed: int = 5) -> tuple[DataFrame, list[dict]]:
    """(one row per row: id, n_links, component_id, kept) and the audits."""
    with_columns_checked(rows, id_col, vector_col, label_col)
    table = scratch.write(node_table(rows, id_col, vector_col, label_col), "rows")
    # Vectors of different lengths do not compare: the length is part of the label.
    table = table.withColumn("label", F.concat(F.octet_length("vec").cast("string"), F.lit(":"), F.col("label")))
    nodes = scratch.write(table.where("node is not null").groupBy("node").agg(
        F.min("id").alias("first"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec")), "nodes")
    audits: list[dict] = []
    total = nodes.count()
    if not total:
        links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    else:
        lists = scratch.write(nodes.select("node", F.lit(k).alias("k")), "lists")
        found = ordered_start(nodes, trees, window, k, threshold, seed)
        graph = scratch.write(keep_best(found, lists, threshold), "graph")
        truth = scratch.write(true_links(nodes, threshold, audit_every), "truth")
        truths = truth.count()
        left = rounds
        while True:
            new = descent_round(graph, nodes, lists, threshold, fan=2 * k)
            full = graph.groupBy("a").agg(F.max("k").alias("k"), F.sum((F.col("sim") >= threshold).cast("int")).alias("near"))
            lists = scratch.write(full.select(F.col("a").alias("node"), F.when(F.col("near") >= F.col("k"), 2 * F.col("near")).otherwise(
                F.col("k")).cast("int").alias("k")).unionByName(
                nodes.join(full, F.col("node") == F.col("a"), "left_anti").select("node", F.lit(k).alias("k"))), "lists")
            nxt = scratch.write(keep_best(graph.select("a", "b", "sim").unionByName(new), lists, threshold), "graph")
            changed = nxt.join(graph.select("a", "b"), ["a", "b"], "left_anti").agg(
                F.count("*").alias("n"), F.sum((F.col("sim") >= threshold).cast("int")).alias("links")).first()
            graph = nxt
            left -= 1
            if changed["links"] or left > 0 and changed["n"] > settled * k * total and rounds - left < least_rounds:
                continue
            held = graph.where(F.col("sim") >= threshold).select("a", "b")
            both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
            hit = truth.join(both, ["a", "b"], "left_semi").count()
            audits.append({"links": truths, "found": hit, "recall": hit / truths if truths else 1.0})
            if audits[-1]["recall"] >= min_recall:
                break
            if len(audits) == 4:  # not found by descent: compare all
                both = true_links(nodes, threshold, 1).select("a", "b")
                audits.append({"links": truths, "found": truths, "recall": 1.0})
                break
            seed += trees
            more = ordered_start(nodes, trees, window, k, threshold, seed)
            graph = scratch.write(keep_best(graph.select("a", "b", "sim").unionByName(more), lists, threshold), "graph")
            left = 1
        links = scratch.write(both, "links")
    weights = nodes.select(F.col("node").alias("n"), "weight", "first")
    counted = links.join(weights, F.col("b") == F.col("n")).groupBy(F.col("a").alias("la")).agg(F.sum("weight").alias("others"))
    comp = components(links, scratch)
    of_node = weights.join(comp, F.col("n") == F.col("id"), "left").join(counted, F.col("n") == F.col("la"), "left").select(
        F.col("n").alias("node_"), "first", F.coalesce("component", "n").alias("component"),
        (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("links_"))
    least = of_node.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
    of_node = scratch.write(of_node.join(least, F.col("component") == F.col("c")).select("node_", "links_", "least"), "result")
    out = table.join(of_node, F.col("node") == F.col("node_"), "left").select(
        F.col("id").alias(id_col), F.coalesce("links_", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), audits
