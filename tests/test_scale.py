"""What lets the comparison grow: rows dealt once, no broadcast of derived rows, no bins by a range's length, no frame that runs to the end."""

import random

from pyspark.sql import functions as F

from logloom.operators import control as Co
from logloom.operators import diff as D
from logloom.operators import layout as L
from logloom.operators import noise_keys as K
from logloom.operators.intervals import marked, within
from logloom.plans import q_docs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange ")


def written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path):
    text = "\n".join(f"line {n} of the text with some words and a number {n * 7}" for n in range(12))
    return written(spark, path, "documents", [(d, text.replace("some", f"some{d}"), "en", "s", len(text)) for d in range(4)] + [(9, None, None, None, None)], DOCS)


def test_documents_are_dealt_once_for_candidates_and_anchors(spark, tmp_path):  # F4, F8, F12, F20, F22
    sf = documents(spark, tmp_path)
    blocks = q_docs._blocks(spark, sf)
    rest = D.unmatched(D.block_facts(blocks), D.exact_matches(blocks))
    _, cont = D.contents(rest)
    for df in (D.candidate_pairs(cont), D.unique_anchors(q_docs._words(blocks))):
        assert "Broadcast" not in plan(df)
        assert shuffles(df) == plan(df).count("REPARTITION_BY_NUM")


def test_word_changes_shuffle_few_rows(spark, tmp_path):  # F1, F3, F9, F10, F11
    sf = documents(spark, tmp_path)
    blocks = q_docs._blocks(spark, sf)
    fixed = D.monotone(D.exact_matches(blocks)).where("kept").select("pair_id", "l", "r")
    changes = D.word_changes(q_docs._placed(blocks), fixed)
    assert shuffles(changes) - plan(changes).count("REPARTITION_BY_NUM") == 1
    assert "Broadcast" not in plan(q_docs.document_differences(spark, sf))
    words = D.word_changes(q_docs._words(blocks), fixed)
    assert sorted(map(tuple, changes.select("pair_id", "i1", "i2", "j1", "j2").collect())) == sorted(map(tuple, words.select("pair_id", "i1", "i2", "j1", "j2").collect()))


def test_contexts_by_force(spark):
    rng = random.Random(2)
    rows, changes, want = [], [], {}
    for p in range(20):
        keys = [rng.choice(["a", "b1", "....", "c....", "-", "d"]) for _ in range(rng.randrange(0, 30))]
        rows += [(p, "L", i, k) for i, k in enumerate(keys)] + [(p, "R", 0, "x")]
        for _ in range(6):
            i1 = rng.randrange(len(keys) + 1)
            i2 = rng.randrange(i1, len(keys) + 1)
            n = 1 if i1 == i2 else 3
            plain = [(i, k.replace("....", "")) for i, k in enumerate(keys) if k.replace("....", "").isalnum()]
            changes.append((p, i1, i2, len(changes)))
            want[len(changes) - 1] = " ".join([k for i, k in plain if i < i1][-n:] + [k for i, k in plain if i >= i2][:n])
    got = D.with_context(spark.createDataFrame(changes, "pair_id long, i1 long, i2 long, c long"), spark.createDataFrame(rows, "pair_id long, side string, pos long, key string"))
    assert {r["c"]: r["context"] for r in got.collect()} == want


def test_moves_meet_as_numbers(spark):  # F10, F24
    keys = [f"w{n}" for n in range(40)]
    rows = [(1, "mancante", 10, 0, keys, []), (1, "mancante", 90, 0, ["w1", "x", "y"], []), (1, "in_piu", 0, 300, [], keys[:-1]), (1, "in_piu", 0, 400, [], ["w1", "p", "q"])]
    moves = D.text_moves(spark.createDataFrame(rows, "pair_id long, op string, i1 long, j1 long, left_keys array<string>, right_keys array<string>"))
    assert "Broadcast" not in plan(moves)
    assert [tuple(r) for r in moves.collect()] == [(1, 10, 300)]


def test_values_are_not_broadcast(spark):  # F7
    d = spark.createDataFrame([(1, 1, "cambiato", "testo", ["a", "P1"], ["a", "Q1"])], "pair_id long, id long, op string, klass string, left_keys array<string>, right_keys array<string>")
    c = spark.createDataFrame([(1, 1, "P1", "Q1")], "pair_id long, value_id long, original string, perturbed string")
    found = Co.same_place_words(d, c)
    assert "Broadcast" not in plan(found)
    assert [(r["start"], r["n"]) for r in found.collect()] == [(1, 1)]


def test_alignment_is_not_broadcast(spark):  # F2, F6, F13
    rows = [(1, s, n, f"row {n} {s if n % 3 == 1 else ''} and the rest of it to the end".split(), 1, 10.0, "paragrafo") for s in "LR" for n in range(9)]
    b = spark.createDataFrame(rows, "pair_id long, side string, block long, keys array<string>, lines int, size double, kind string")
    rest = D.unmatched(D.block_facts(b), D.exact_matches(b))
    assert "Broadcast" not in plan(D.scored_candidates(rest))
    assert "Broadcast" not in plan(D.in_target_order(b, D.exact_matches(b)))
    assert sorted((r["l"], r["r"]) for r in D.align(b).collect()) == [(n, n) for n in range(9)]


def test_long_ranges_stand_in_few_bins(spark):  # F5
    c = spark.createDataFrame([(1, 0, 10**14), (2, 5, 7), (3, 0, 1000)], "pair_id long, i1 long, i2 long")
    r = spark.createDataFrame([(1, 10**13, 10**13 + 2, 2), (2, 5, 8, 2), (3, 990, 1000, 2)], "pair_id long, start long, end long, lines int")
    got = sorted((x["pair_id"], x["s"], x["e"], x["section"]) for x in L.hard_bounds(c, r).collect())
    assert got == sorted([(1, 0, 10**13, False), (1, 10**13, 10**13 + 2, True), (1, 10**13 + 2, 10**14, False), (2, 5, 7, False), (3, 0, 990, False), (3, 990, 1000, True)])


def test_wide_ranges_by_force(spark):
    rng = random.Random(4)
    outer = [(g, i, lo, lo + int(8 ** rng.uniform(0, 6))) for i in range(80) for g, lo in ((rng.randrange(3), rng.randrange(3000)),)]
    inner = [(rng.randrange(3), j, rng.randrange(6000)) for j in range(200)]
    got = within(spark.createDataFrame(outer, "g long, i long, lo long, hi long"), spark.createDataFrame(inner, "g long, j long, at long"), ["g"], ("lo", "hi"), "at", wide=True)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for g, i, lo, hi in outer for h, j, at in inner if g == h and lo <= at < hi)


def test_no_frame_runs_to_the_end(spark):  # F14
    keys = spark.createDataFrame([(1, n, f"w{n}" if n % 3 else str(n), n == 29) for n in range(30)], "doc long, pos long, key string, ends_line boolean")
    final = K.noise_over_keys(keys, [("NUM", r"\d+ w")])
    assert "unboundedfollowing" not in plan(final).lower()


def test_marks_of_null_keys_meet_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k long, v string")
    marks = spark.createDataFrame([(1, 5), (None, 6)], "k long, m long")
    got = sorted((r["v"], r["m"]) for r in marked(rows, marks, ["k"], "m").where(F.col("m").isNotNull()).collect())
    assert got == [("a", 5), ("a", 5)]


def test_unmatched_blocks_are_made_once(spark, tmp_path):  # F3, F6
    sf = documents(spark, tmp_path)
    blocks = q_docs._blocks(spark, sf)
    scored = D.scored_candidates(D.unmatched(D.block_facts(blocks), D.exact_matches(blocks)))
    assert "documents.parquet" not in plan(scored)
    assert {(r["pair_id"], r["l"]) for r in scored.collect()} >= {(d, n) for d in range(4) for n in (1, 6, 11)}
