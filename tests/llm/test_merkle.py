"""Merkle manifest against brute force: nulls, repeated rows, groups of many sizes, many groups, layout of the blocks."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle
from logloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, number int, nodes string, root int, order int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def way(levels, at):
    """(left, right) siblings per level."""
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        at //= 8
    return out


def by_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, ordered = {}, {}
    for g in names:
        ordered[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in ordered[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, r in enumerate(ordered[g]):
            path = way(trees[g], at) + way(top, place)
            now = leaf(r, low=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                now = digest(left + now + right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


def checked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3, "y", 4, 5) for r in rows], SCHEMA).repartition(3)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(df, Scratch(spark, "test"), FIELDS, [F.col(f) for f in FIELDS[:4]] + [low],
                            F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_groups_of_many_sizes(spark):
    rows = []
    for g, n in [("en", 1100), (None, 9), ("de", 512), ("é", 513), ("fr", 1), ("", 64), ("z", 65)]:
        rows += [(i * 7 % 5003, f"Text {i} of É {g}" if i % 11 else None, g, None if i % 4 else f"s{i}", i if i % 5 else None) for i in range(n)]
    rows += [rows[3]] * 40 + [(None, "A", "en", None, 1), (None, "b", "en", None, 1), (5, "Same id", "en", None, 2), (5, "", "en", None, 2)]
    assert checked(spark, rows) == by_force(rows)


def test_many_groups(spark):
    rows = [(i, f"T {i}", f"g{i % 530}", "s", i) for i in range(700)]
    assert checked(spark, rows) == by_force(rows)


@pytest.mark.parametrize("rows", [[], [(1, "Only", "en", None, 4)], [(3, None, None, None, None)] * 3])
def test_small_tables(spark, rows):
    assert checked(spark, rows) == by_force(rows) if rows else checked(spark, rows) == []


def test_every_tampered_text_is_noticed(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", "en", "s", 1) for i in range(90)]
    for r in checked(spark, rows):
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 3 != 0 or r[0] % 2 == 0)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_layout_places_every_node_once(levels):
    all_places = np.concatenate([merkle.address(levels, d, np.arange(8 ** d)) for d in range(levels)])
    assert sorted(all_places.tolist()) == list(range(merkle.size(levels)))
    assert merkle.address(levels, 0, np.array([0]))[0] == 0


def test_layout_keeps_subtrees_together():
    # below the upper half of the levels every subtree is one run of places, itself laid out like a tree of its height
    for levels in (4, 5, 6):
        upper = levels // 2
        lower = levels - upper
        for t in (0, 3, 8 ** upper - 1):
            start = merkle.size(upper) + t * merkle.size(lower)
            for d in range(lower):
                index = t * 8 ** d + np.arange(8 ** d)
                assert (merkle.address(levels, upper + d, index) == start + merkle.address(lower, d, np.arange(8 ** d))).all()


def test_blocks_hold_their_trees():
    for n in (1, 2, 8, 9, 64, 65, 511, 512):
        leaves = [digest(str(i)) for i in range(n)]
        levels = merkle.height(0, n)
        nodes = merkle.laid_out([bytes.fromhex(x) for x in leaves], levels)
        assert merkle.opened(nodes, n, levels) == ["".join(x) for x in tree(leaves)[::-1]]
        last = merkle.siblings(merkle.opened(nodes, n, levels), n - 1)
        assert list(zip(*last)) == way(tree(leaves), n - 1)
