"""Hard negatives against brute force: ties, repeated rows, odd vectors, several blocks, large components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import hard_negatives
from logloom.llm.common import Scratch

SCHEMA = "vec_id long, label int, embedding array<double>, anchor boolean, id string, v int, score int, block int"


def by_force(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    clip = lambda x: max(-2**63, min(2**63 - 1, x))
    ok = [(i, lab, [clip(math.floor(scale * x)) for x in e], a) for i, lab, e, a in rows
          if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, lab, e, a in ok:
        if not a:
            continue
        scored = sorted((-max(-2**63 + 1, clip(sum(x * y for x, y in zip(e, f)))), j, m) for j, m, f, _ in ok if j != i and len(f) == len(e))
        for s, j, m in [x for x in scored if x[2] == lab][:positives]:
            window = [(n, t) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (n, t) in enumerate(window)]
    return sorted(out)


def random_rows(rng, n, dims=(6,), labels=3, spread=lambda r: r.choice([-0.5, 0.0, 0.25, 0.5, 1.0])):
    rows = []
    for _ in range(n):
        dim = rng.choice(dims)
        rows.append((rng.randrange(n), rng.choice([None, *range(labels)] if rng.random() < .2 else range(labels)),
                     rng.choice([None, [], [math.nan] * dim, [None] + [0.1] * dim]) if rng.random() < .08 else [spread(rng) for _ in range(dim)],
                     rng.choice([True, False, None])))
    return rows + rows[:n // 6]


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 7, 7, 7) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, Scratch(spark, "test"), **settings).collect())


@pytest.mark.parametrize("seed,settings,shape", [
    (1, {"block_rows": 16}, {}),
    (2, {"block_rows": 1000, "negatives": 3}, {"dims": (2, 3, 4), "labels": 4}),
    (3, {"block_rows": 50, "positives": 2, "low": -50, "high": 110}, {"labels": 40}),
    (4, {"block_rows": 30}, {"spread": lambda r: r.choice([1e6, 4e5, 2e6, -3e5, 0.3] * 20 + [1e300])}),
])
def test_against_brute_force(spark, seed, settings, shape):
    rows = random_rows(random.Random(seed), 90, **shape)
    scale = {k: v for k, v in settings.items() if k != "block_rows"}
    want = by_force(rows, **scale)
    assert mined(spark, rows, **settings) == want
    assert want


def test_both_orders_agree():
    rng = np.random.default_rng(4)
    scores, rank, out = rng.integers(-9, 9, (20, 30)), rng.permutation(30), rng.random((20, 30)) < .3
    a, n = hard_negatives.keyed(scores, rank, out)
    b, m = hard_negatives.keyed(scores * (1 << 58), rank, out)
    assert (n == m).all() and all((a[i, n[i]:] == b[i, n[i]:]).all() for i in range(20))


def test_windows_are_exact_at_their_ends():
    for score in [*range(-50, 400), 2**62, -2**62]:
        lowest, highest = hard_negatives.windows(score, 30, 90)
        inside = lambda n: 30 * score <= 100 * n <= 90 * score
        for n in (lowest, highest):
            assert lowest > highest or inside(n)
        assert not inside(lowest - 1) and not inside(highest + 1)


def test_suffixes_answer_every_window():
    slots = [[(-9, 1), (-8, 4)], [], [(-5, 2), (-5, 3), (-4, 1)]]
    assert hard_negatives.answered(slots, 3) == [[(-9, 1), (-8, 4), (-5, 2)], [(-5, 2), (-5, 3), (-4, 1)], [(-5, 2), (-5, 3), (-4, 1)]]


def test_no_rows_no_anchors_no_positives(spark):
    rows = [(1, 1, [1.0], False), (2, 2, [1.0], False)]
    assert mined(spark, rows) == mined(spark, rows[:0]) == mined(spark, [(1, 1, [1.0], True), (2, 2, [1.0], True)]) == []
    empty = spark.createDataFrame([], SCHEMA).select("vec_id", "label", "embedding", F.lit(True).alias("anchor"))
    assert hard_negatives.mine(empty, Scratch(spark, "test")).collect() == []


def test_one_label_holds_nearly_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, 0 if i % 40 else 1, [rng.random() for _ in range(4)], i % 25 == 0) for i in range(300)]
    assert mined(spark, rows, block_rows=64) == by_force(rows)
