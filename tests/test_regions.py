"""Regions of changes: cuts at unmatched blocks, second comparison, far pieces paired again; interval joins by force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import regions as R
from logloom.operators.intervals import within

CHANGE = "pair_id long, op string, i1 long, i2 long, j1 long, j2 long, left_keys array<string>, right_keys array<string>"


def change(p, i, j, left, right):
    left, right = left.split(), right.split()
    op = "mancante" if not right else "in_piu" if not left else "cambiato"
    return p, op, i, i + len(left), j, j + len(right), left, right


def shown(df):
    return sorted((r["pair_id"], r["op"], r["i1"], r["i2"], r["j1"], r["j2"], " ".join(r["left_keys"]), " ".join(r["right_keys"])) for r in df.collect())


@pytest.mark.parametrize("width", [1, 7, 64])
def test_ranges_meet_once(spark, width):
    rng = random.Random(width)
    outer = [(rng.randrange(3), k, (s := rng.randrange(90)), s + rng.randrange(60)) for k in range(60)]
    inner = [(rng.randrange(3), k, (s := rng.randrange(120)), s + rng.randrange(9)) for k in range(90)]
    o = spark.createDataFrame(outer, "g int, o int, lo int, hi int")
    i = spark.createDataFrame(inner, "g int, n int, start int, end int")
    got = sorted((r["o"], r["n"]) for r in within(o, i, ["g"], ("lo", "hi"), ("start", "end"), width).collect())
    assert got == sorted((a[1], b[1]) for a, b in itertools.product(outer, inner) if a[0] == b[0] and a[2] <= b[2] and b[3] <= a[3] and b[3] > b[2])
    got = sorted((r["o"], r["n"]) for r in within(o, i, ["g"], ("lo", "hi"), "start", width).collect())
    assert got == sorted((a[1], b[1]) for a, b in itertools.product(outer, inner) if a[0] == b[0] and a[2] <= b[2] < a[3])


def test_changes_are_cut_at_unmatched_blocks(spark):
    rows = [
        change(1, 10, 20, "H i l m n", "Y i l m n a b c d"),  # the last four words are a block of the generated side
        change(2, 0, 0, "p q one two three four r s", "p x r y"),  # a block in the middle, one piece shared between two
        change(3, 5, 5, "a b", "c d"),
        change(4, 0, 7, "k l m n", ""),
    ]
    ranges = spark.createDataFrame([(1, "R", 25, 29), (2, "L", 2, 6), (3, "L", 4, 9), (4, "L", 0, 4), (9, "L", 0, 9)], "pair_id long, side string, start long, end long")
    got = shown(R.split_at_bounds(spark.createDataFrame(rows, CHANGE), ranges))
    assert got == [
        (1, "cambiato", 10, 11, 20, 21, "H", "Y"), (1, "in_piu", 15, 15, 25, 29, "", "a b c d"),
        (2, "cambiato", 7, 8, 3, 4, "s", "y"), (2, "in_piu", 6, 6, 1, 2, "", "x"),
        (2, "mancante", 1, 2, 1, 1, "q", ""), (2, "mancante", 2, 6, 4, 4, "one two three four", ""),
        (3, "cambiato", 5, 7, 5, 7, "a b", "c d"), (4, "mancante", 0, 4, 7, 7, "k l m n", ""),
    ]
    kept = shown(R.split_at_bounds(spark.createDataFrame(rows[:1], CHANGE), ranges, as_is=F.lit(True)))
    assert kept[0] == (1, "cambiato", 10, 15, 20, 25, "H i l m n", "Y i l m n")


def test_every_key_stays_in_one_part():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 14))] for _ in "lr")

        def some(n):
            cuts = sorted(rng.sample(range(n + 1), min(n + 1, 2 * rng.randrange(3))))
            return [(s, e) for s, e in zip(cuts[::2], cuts[1::2]) if e > s]

        left, right = some(len(a)), some(len(b))
        parts = R.regions(a, b, left, right)
        assert sorted(k for i1, i2, _j1, _j2 in parts for k in range(i1, i2)) == list(range(len(a)))
        assert sorted(k for _i1, _i2, j1, j2 in parts for k in range(j1, j2)) == list(range(len(b)))
        assert all((s, e) in {p[:2] for p in parts} for s, e in left) and all((s, e) in {p[2:] for p in parts} for s, e in right)
        for p in parts:
            x, y = a[p[0]:p[1]], b[p[2]:p[3]]
            again = R.refined(a, b, p)
            if x and y:  # outside the refined ranges both sides are equal
                rest = lambda keys, lo, hi, k: [keys[n] for n in range(lo, hi) if not any(r[k] <= n < r[k + 1] for r in again)]
                assert rest(a, p[0], p[1], 0) == rest(b, p[2], p[3], 2)


def total(left, right, pairs):
    import difflib
    return sum(R.BONUS + difflib.SequenceMatcher(None, left[x][0], right[y][0], autojunk=False).ratio() for x, y in pairs if x is not None and y is not None)


def test_pieces_pair_with_the_largest_similarity():
    rng = random.Random(3)
    for _ in range(150):
        left, right = ([("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))), rng.choice("zz" + "y")) for _ in range(rng.randrange(5))] for _ in "lr")
        got = R.pieces_in_order(left, right)
        assert [x for x, _ in got if x is not None] == list(range(len(left))) and [y for _, y in got if y is not None] == list(range(len(right)))
        assert all(x is None or y is None or left[x][1] == right[y][1] for x, y in got)
        best = 0.0
        for n in range(min(len(left), len(right)) + 1):
            for xs in itertools.combinations(range(len(left)), n):
                for ys in itertools.combinations(range(len(right)), n):
                    if all(left[x][1] == right[y][1] for x, y in zip(xs, ys)):
                        best = max(best, total(left, right, zip(xs, ys)))
        assert abs(total(left, right, got) - best) < 1e-9


def test_far_pieces_find_their_text(spark):
    rows = [change(1, 0, 0, "alpha beta gamma delta", "new words alpha betas gamma delta"), change(2, 3, 3, "one two", "one three"), change(3, 0, 0, "head", "tail")]
    place = lambda p, s, k, page, zone="corpo": (p, s, k, page, 10.0 * k, 50.0, 10.0 * k + 8, 60.0, zone)
    words = [place(1, "L", 0, 0), place(1, "L", 1, 0), place(1, "L", 2, 1), place(1, "L", 3, 1),
             place(1, "R", 0, 0), place(1, "R", 1, 0), place(1, "R", 2, 1), place(1, "R", 3, 1), place(1, "R", 4, 2), place(1, "R", 5, 2),
             *(place(2, s, k, 0) for s in "LR" for k in (3, 4)), place(3, "L", 0, 0, "header"), place(3, "R", 0, 0)]
    w = spark.createDataFrame(words, "pair_id long, side string, pos long, page int, x0 double, y0 double, x1 double, y1 double, zone string")
    got = shown(R.spread_changes(spark.createDataFrame(rows, CHANGE), w))
    assert got[:3] == [(1, "cambiato", 1, 2, 3, 4, "beta", "betas"), (1, "in_piu", 0, 0, 0, 2, "", "new words"), (2, "cambiato", 3, 5, 3, 5, "one two", "one three")]
    # pieces of different zones never pair
    assert sorted(g[1] for g in got[3:]) == ["in_piu", "mancante"]


def test_runs_of_unmatched_blocks(spark):
    aligned = spark.createDataFrame([(1, 0, 0), (1, 1, None), (1, 2, None), (1, None, 1), (1, 4, None)], "pair_id long, l long, r long")
    spans = spark.createDataFrame([(1, "L", b, 10 * b, 10 * b + 10, 1) for b in range(5)] + [(1, "R", 1, 5, 9, 2)],
                                  "pair_id long, side string, block long, start long, end long, lines int")
    got = sorted(tuple(r) for r in R.unmatched_ranges(aligned, spans).collect())
    assert got == [(1, "L", 10, 30), (1, "R", 5, 9)]
