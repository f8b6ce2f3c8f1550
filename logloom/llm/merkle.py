"""A Merkle manifest of a dataset, in a van Emde Boas layout: roots, proofs of every row, and the check of a changed row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 bytes' count, a colon and the value. The rows of a
group, in order, are the leaves of a tree of ``FAN`` children a node; the groups' roots, in order, are the leaves of one more.

Storage. A tree is cut into aligned subtrees of ``LEVELS`` levels. A block row holds one of them as a single binary: the
nodes in van Emde Boas order, in which a tree of L levels is its upper L // 2 levels followed by the subtrees below them, each
laid out the same way. ``address`` computes a node's place from its level and index alone; building a block and fetching the
siblings of a leaf are reads and writes at such places, and near ones for near nodes whatever the size of a page. The blocks' roots
are the leaves of the next tier, until every group has one block; so a tier has 1 / 512 of the rows of the one below it.

At scale. Only (group, order, digest, changed digest) is shuffled. Rows are dealt by ranges of (group, order, digest, row
number), so a group that holds nearly all rows, or a row repeated a million times, is spread; places follow from counts per range.
A block, at most 512 leaves, is the largest group a task gathers. Proofs go downwards tier by tier by joins on (group, block).

Defined results. Null groups come first, groups and strings in the order of their bytes; null orders come first in a group, ties
by leaf. Repeated rows have neighbouring leaves each. A lone leaf is its group's root, and a lone group's root the root. Columns
other than those named are ignored, whatever they are called. An empty table has no tiers' rows, no proofs and no root.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import two_level_rank
from .common import Scratch, shuffle_partitions, with_columns_checked

FAN = 8
LEVELS = 4
SPAN = FAN ** (LEVELS - 1)
BLOCK = "grp string, block long, width int, nodes binary, root binary"


def size(levels: int) -> int:
    """Nodes of a whole tree."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth in a whole tree of ``levels`` levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, under = levels - upper, FAN ** (depth - upper)
    return size(upper) + index // under * size(lower) + address(lower, depth - upper, index % under)


@functools.lru_cache(16)
def places(levels: int, depth: int) -> np.ndarray:
    """Places of all nodes of a depth."""
    return address(levels, depth, np.arange(FAN ** depth))


def widths(leaves: int, levels: int) -> list[int]:
    """Nodes that exist at each depth, from the root down."""
    out = [leaves]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def height(block: int, leaves: int) -> int:
    """Levels of a block: whole ones where more blocks follow or went before, else as few as hold its leaves."""
    if block > 0 or leaves == SPAN:
        return LEVELS
    levels = 1
    while FAN ** (levels - 1) < leaves:
        levels += 1
    return levels


def laid_out(digests: list[bytes], levels: int) -> bytes:
    """The nodes above and with the leaves, in van Emde Boas order; places of absent nodes are zero."""
    nodes = np.zeros((size(levels), 32), np.uint8)
    wide = widths(len(digests), levels)
    nodes[places(levels, levels - 1)[:len(digests)]] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    for depth in range(levels - 2, -1, -1):
        text = nodes[places(levels, depth + 1)[:wide[depth + 1]]].tobytes().hex().encode()
        nodes[places(levels, depth)[:wide[depth]]] = np.frombuffer(b"".join(
            hashlib.sha256(text[i:i + 64 * FAN]).digest() for i in range(0, len(text), 64 * FAN)), np.uint8).reshape(-1, 32)
    return nodes.tobytes()


def opened(nodes: bytes, leaves: int, levels: int) -> list[str]:
    """Per depth, from the root down, the digests of its nodes as one hex text."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return [table[places(levels, d)[:w]].tobytes().hex() for d, w in enumerate(widths(leaves, levels))]


def siblings(levels: list[str], leaf: int) -> tuple[list[str], list[str]]:
    """The other nodes of the runs on the way from a leaf to the root of a block: left and right of it, per level upwards."""
    left, right = [], []
    for text in levels[:0:-1]:
        run = leaf // FAN * FAN * 64
        left.append(text[run:64 * leaf])
        right.append(text[64 * leaf + 64:run + 64 * FAN])
        leaf //= FAN
    return left, right


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hex digest of a row's fields."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda x, s: F.sha2(F.concat(s["l"], x, s["r"]), 256))


def in_order(nodes: DataFrame, scratch: Scratch, order: str) -> DataFrame:
    """``nodes`` (grp, ``order``, digest, …) with ``number``, from 0 in each group."""
    n = shuffle_partitions(nodes.sparkSession)
    spread = scratch.write(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    dealt = scratch.write(spread.repartitionByRange(n, "grp", order, "digest", "row").withColumn("part", F.spark_partition_id()), "ranges")
    ranked = two_level_rank(dealt, ["grp"], "part", [F.col(order).asc_nulls_first(), F.col("digest"), F.col("row")], "number")
    return ranked.withColumn("number", F.col("number") - 1).drop("part", "row")


def _built(payload: Sequence[str]):
    """The function that makes the block row of a group's leaves."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        digests, (grp, block) = table["digest"].to_pylist(), (k.as_py() for k in key)
        nodes = laid_out(digests, height(block, len(digests)))
        whole = pa.array([0, len(digests)], pa.int32())
        return pa.table([pa.array([grp], pa.string()), pa.array([block], pa.int64()), pa.array([len(digests)], pa.int32()),
                         pa.array([nodes], pa.binary()), pa.array([nodes[:32]], pa.binary()),
                         *(pa.ListArray.from_arrays(whole, table[c].combine_chunks()) for c in payload)],
                        names=["grp", "block", "width", "nodes", "root", *payload])

    return build


def tiers(nodes: DataFrame, scratch: Scratch, payload: Sequence[str] = ()) -> list[DataFrame]:
    """The block tables of numbered nodes (grp, number, digest), from the leaves up; the first keeps ``payload`` as arrays."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in payload}
    out: list[DataFrame] = []
    while True:
        extra = [] if out else list(payload)
        held = nodes.select("grp", F.floor(F.col("number") / SPAN).alias("block"), "number", "digest", *extra)
        schema = ", ".join([BLOCK, *(f"{c} array<{kinds[c]}>" for c in extra)])
        out.append(scratch.write(held.groupBy("grp", "block").applyInArrow(_built(extra), schema), f"tier{len(out)}"))
        if not (out[-1].agg(F.max("block")).first()[0] or 0):
            return out
        nodes = out[-1].select("grp", F.col("block").alias("number"), F.col("root").alias("digest"))


def descend(blocks: DataFrame, above: DataFrame, carried: Sequence[str] = (), payload: Sequence[str] = ()) -> DataFrame:
    """The proofs of the leaves of blocks: (grp, number, digest, lefts, rights, carried…, payload…).

    ``above`` (grp, block, lefts, rights, carried…) proves the blocks' roots; a leaf's proof is its own siblings, then those.
    """
    row = blocks.drop("root").join(above, ["grp", "block"])
    kinds = ["grp string", "number long", "digest string", "lefts array<string>", "rights array<string>",
             *(f"{c} {above.schema[c].dataType.simpleString()}" for c in carried),
             *(f"{c} {blocks.schema[c].dataType.elementType.simpleString()}" for c in payload)]
    names = [k.split(" ")[0] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("grp", "block", "width", "nodes", "lefts", "rights", *carried)}
                n = r["width"]
                levels = opened(r["nodes"], n, height(r["block"], n))
                lefts, rights = [], []
                for leaf in range(n):
                    left, right = siblings(levels, leaf)
                    lefts += left + r["lefts"]
                    rights += right + r["rights"]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (len(lefts) // n))
                same = lambda v, t: pa.array([v] * n, t)
                yield pa.RecordBatch.from_arrays(
                    [same(r["grp"], pa.string()), pa.array(np.arange(n, dtype=np.int64) + r["block"] * SPAN),
                     pa.array([levels[-1][64 * k:64 * k + 64] for k in range(n)], pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(lefts, pa.string())), pa.ListArray.from_arrays(ends, pa.array(rights, pa.string())),
                     *(same(r[c], pa.string()) for c in carried),
                     *(batch.column(c)[i].values for c in payload)], names=names)

    return row.mapInArrow(run, ", ".join(kinds))


def proofs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Proofs of ``rows`` (grp string, order, digest binary, changed binary).

    Per row: grp, order, number, digest, changed, lefts, rights (siblings per level, from the leaf to the root), subroot, root; digests
    are hex. The tiers stay in the scratch folder as the manifest.
    """
    payload = ["order", "changed"]
    leaves = tiers(in_order(rows, scratch, "order"), scratch, payload)
    subroots = leaves[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"))
    groups = tiers(in_order(subroots, scratch, "name"), scratch, ["name"])
    none = F.array().cast("array<string>")
    way = groups[-1].select("grp", "block", none.alias("lefts"), none.alias("rights"), F.lower(F.hex("root")).alias("top"))
    for blocks in groups[:0:-1]:
        way = descend(blocks, way, ["top"]).withColumnRenamed("number", "block").drop("digest")
    named = scratch.write(descend(groups[0], way, ["top"], ["name"]), "groups")
    way = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "lefts", "rights",
                       F.col("top"), F.col("digest").alias("subroot"))
    for blocks in leaves[:0:-1]:
        way = scratch.write(descend(blocks, way, ["top", "subroot"]).withColumnRenamed("number", "block").drop("digest"), "way")
    return descend(leaves[0], way, ["top", "subroot"], payload).withColumnRenamed("top", "root")


def manifest(table: DataFrame, scratch: Scratch, fields: Sequence[str], changed: Sequence[Column], tampered: Column,
             group_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """Leaves, roots and checks of every row of ``table``, where ``tampered`` holds with the fields ``changed`` instead.

    Per row: the order column, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (from the changed leaf where there
    is one, and the original siblings), verified (whether that is the root).
    """
    with_columns_checked(table, *fields, group_col, order_col)
    # a null group sorts before all names
    rows = table.select(
        F.coalesce(F.concat(F.lit(":"), F.col(group_col).cast("string")), F.lit("")).alias("grp"), F.col(order_col).alias("order"),
        F.unhex(leaf_of([F.col(f) for f in fields])).alias("digest"),
        F.when(tampered, F.unhex(leaf_of(changed))).alias("changed"))
    found = proofs(rows, scratch)
    now = F.coalesce(F.lower(F.hex("changed")), F.col("digest"))
    whole = F.concat_ws("", F.flatten(F.transform(F.arrays_zip("lefts", "rights"), lambda s: F.array(s["lefts"], s["rights"]))))
    return found.select(
        F.col("order").alias(order_col), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(whole, 256).alias("proof_sha256"),
        fold(now, F.col("lefts"), F.col("rights")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
