"""Lines of positioned words: the nearest word of a line decides, on random pages against a plain restatement."""

import random

from logloom.sources import words as Wd

SCHEMA = "doc long, page int, pos long, text string, x0 double, y0 double, x1 double, y1 double, size double"


def lines_by_force(words):
    """pos -> number of the line, of words (pos, x0, y0, x1, y1) of one page."""
    out, line, n = {}, [], 0
    for w in sorted(words, key=lambda w: (w[4], w[1], w[3])):
        left = [v for v in line if v[1] < w[1]]
        right = [v for v in line if v[1] >= w[1]]
        near = max(left, key=lambda v: v[1]) if left else None
        after = min(reversed(right), key=lambda v: v[1]) if right else None
        if near is None or (after is not None and after[1] - w[3] < w[1] - near[3]):
            near = after
        if near is None or w[4] - near[4] > .5 * max(w[4] - w[2], near[4] - near[2]):
            line, n = [], n + 1
        line.append(w)
        out[w[0]] = n
    return out


def numbered(spark, rows):
    return {(r["doc"], r["page"], r["pos"]): r["line"] for r in Wd.lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def row(doc, page, pos, x0, y0, x1, y1, text="w"):
    return (doc, page, pos, text, x0, y0, x1, y1, 10.0)


def test_columns_on_other_baselines_keep_their_lines(spark):  # F7, F8
    # bottoms 20 (left), 24 (right), 28 (left): each is near the one before, but the nearest on its left is 8 above, over half of 10
    got = numbered(spark, [row(1, 0, 1, 0.0, 10.0, 20.0, 20.0), row(1, 0, 2, 200.0, 14.0, 220.0, 24.0), row(1, 0, 3, 5.0, 18.0, 25.0, 28.0)])
    assert got == {(1, 0, 1): 1, (1, 0, 2): 1, (1, 0, 3): 2}
    # and the word before is too far up, but not the nearest one: a tall word takes the next in
    got = numbered(spark, [row(1, 0, 1, 0.0, -20.0, 20.0, 20.0), row(1, 0, 2, 200.0, 12.0, 220.0, 22.0), row(1, 0, 3, 22.0, 24.0, 40.0, 34.0)])
    assert got == {(1, 0, 1): 1, (1, 0, 2): 1, (1, 0, 3): 1}


def test_lines_by_force(spark):  # F7, F8
    rng, rows = random.Random(7), []
    for page in range(40):
        step, height, places = rng.choice([1.0, 2.0, 4.0, 18.0]), rng.choice([8.0, 10.0, 12.0]), set()
        for pos in range(rng.randrange(1, 60)):
            x0, y1 = float(rng.randrange(500)), 20.0 + step * rng.randrange(12)
            if (x0, y1) not in places:
                places.add((x0, y1))
                tall = rng.choice([height, height, height, 2 * height])
                rows.append(row(page // 4, page % 4, pos, x0, y1 - tall, x0 + rng.randrange(5, 60), y1))
    want = {}
    for key in {r[:2] for r in rows}:
        want |= {(*key, pos): n for pos, n in lines_by_force([(r[2], *r[4:8]) for r in rows if r[:2] == key]).items()}
    assert numbered(spark, rows) == want
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # pages and lines that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert numbered(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_words_taken_away_afterwards_count_for_the_lines(spark):
    rows = [row(1, 0, 1, 0.0, 10.0, 20.0, 20.0), row(1, 0, 2, 200.0, 14.0, 220.0, 24.0), row(1, 0, 3, 195.0, 18.0, 199.0, 28.0)]
    kept = Wd.lines(spark.createDataFrame(rows, SCHEMA)).where("pos <> 2")
    assert {r["pos"]: r["line"] for r in kept.select("pos", "line").collect()} == {1: 1, 3: 1}


def test_odd_boxes(spark):
    rows = [row(1, 0, 1, 0.0, 10.0, 20.0, None), row(1, 0, 2, 5.0, 10.0, 20.0, 20.0), row(1, 0, 3, 30.0, None, 40.0, 24.0), row(1, 0, 4, 60.0, None, 70.0, 90.0),
            row(None, None, 1, 0.0, 10.0, 20.0, 20.0), row(None, None, 2, None, 11.0, None, 21.0)]
    got = numbered(spark, rows)
    assert got == {(1, 0, 1): 1, (1, 0, 2): 2, (1, 0, 3): 2, (1, 0, 4): 3, (None, None, 1): 1, (None, None, 2): 1}
    assert not Wd.lines(spark.createDataFrame([], SCHEMA)).collect()


def test_blocks_of_columns_on_other_baselines(spark):  # F8
    rows = [row(1, 0, 1, 0.0, 10.0, 20.0, 20.0, "left"), row(1, 0, 2, 200.0, 14.0, 220.0, 24.0, "right"), row(1, 0, 3, 5.0, 18.0, 25.0, 28.0, "below")]
    texts = {r["line"]: r["text"] for r in Wd.line_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts == {1: "left right", 2: "below"}
