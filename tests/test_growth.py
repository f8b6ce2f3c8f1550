"""What lets single queries grow: few rows in Python at once, no key that most rows share, rows dealt once."""

import random
import re

from pyspark.sql import functions as F

from logloom.operators import batch as B
from logloom.operators import review as V
from logloom.plans import q_review as Q
from logloom.sources import html as H


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(data, charset, errors="strict"):
    try:
        return data.decode(charset, errors)
    except (LookupError, UnicodeDecodeError):
        return None


def stated(c):
    """The rule of ``decoded`` in plain words."""
    if c is None:
        return None
    if c[:3] == b"\xef\xbb\xbf":
        return c[3:].decode("utf-8", "replace")
    if c[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return c.decode("utf-16", "replace")
    m = re.search(H.META_CHARSET, c[:4096].decode("latin-1"))
    every = [read(c, n) for n in ([m[1]] if m else []) + ["utf-8", "cp1252", "latin-1"]]
    return next(t for t in every if t is not None)


def test_documents_are_decoded_a_few_at_a_time(spark):  # F21
    rng = random.Random(1)
    odd = [0x41, 0x80, 0x81, 0x9D, 0xBF, 0xC2, 0xC3, 0xA9, 0xE0, 0xED, 0x9F, 0xEF, 0xBB, 0xF0, 0x90, 0x8F, 0x20, 0]
    marks = [b"", b"", b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"]
    names = "utf-8 UTF8 utf_8 ISO-8859-1 latin1 iso_8859-1 windows-1252 cp1252 shift_jis koi8-r no-such utf-16".split()
    heads = [b"", b"", *(f'<meta charset="{n}">'.encode() for n in names)]
    rows = [(i, rng.choice(marks) + rng.choice(heads) + bytes(rng.choices(odd, k=rng.randrange(6)))) for i in range(3000)] + [(3000, None), (3001, b"")]
    got = spark.createDataFrame(rows, "i long, c binary").select("i", H.decoded(F.col("c")).alias("t"))
    assert "ArrowEvalPython" not in plan(got)
    assert {r["i"]: r["t"] for r in got.collect()} == {i: stated(c) for i, c in rows}


ITEMS = "ord long, replace long, key string, variant string, fdi string, payload_sha string"
CASES = "case_id long, key string, variant string, source_fdi string, payload_sha string"


def test_items_without_a_case_stay_out_of_the_join_by_case(spark):  # F27
    items = [(1, None, "K", "v", "f", "s"), (2, None, " k ", "V", "f", "s"), (3, None, "T", "v", "f", "s"), (4, None, None, "v", "f", "s"), (5, None, "n", None, "f", "s"),
             (6, 1, "K", "v", "f", "s"), (7, 2, "K", "v", "f", "s"), (8, 9, "K", "v", "f", "s"), (9, 3, "K", "v", None, "s"), (None, None, "K", "v", "f", "s")]
    cases = [(1, "t", "V", "f", "s"), (2, "x", "y", "f", "other"), (3, None, "y", None, "s"), (None, "z", "z", "f", "s")]
    got = B.plan_cases(spark.createDataFrame(items, ITEMS), spark.createDataFrame(cases, CASES))
    first = plan(got)
    assert {r["ord"]: r["result"] for r in got.collect()} == {
        1: "added", 2: "failed", 3: "failed", 4: "added", 5: "added", 6: "unchanged", 7: "replaced", 8: "failed", 9: "unchanged", None: "added"}
    assert "Filter isnotnull(replace" in first
    assert [ln for ln in first.splitlines() if "Join" in ln and "replace" in ln and "SortMergeJoin" not in ln] == []


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


def review_lines(spark, path):
    rng = random.Random(3)
    rows = [(c, n, rng.randrange(200), rng.randrange(100), float(rng.randrange(1, 51))) for c in range(60) for n in range(1, 5)]
    spark.createDataFrame(rows + [(None, 1, 1, 1, 1.0), (5, 1, None, None, None)], LINES).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_review_shuffles_its_lines_only(spark, tmp_path):  # F25, F29, F31, F33
    sf = review_lines(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (Q.tab_counts, Q.difference_lines, Q.difference_snippets, Q.inactive_review_entries):
            p = plan(q(spark, sf))
            assert p.count("Exchange ") == p.count("REPARTITION_BY_NUM") > 0
            assert "ObjectHashAggregate" not in p.split("Union")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inactive_entries_judge_once(spark):  # F25
    judged = [(c, a, g, m) for c, a, g, m in [(1, "a", "x", True), (1, "b", "x", False), (2, "a", None, None), (2, "c", "y", True), (1, None, "x", True)]]
    tol = [(1, "a", "x"), (1, "a", "z"), (1, "a", "z"), (2, "a", None), (3, "a", "x"), (1, None, "x"), (None, "a", "x")]
    nv = [(1, "b"), (1, "q"), (1, "q"), (2, None)]
    marks = [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (4, "c")]
    j = spark.createDataFrame(judged, "case long, anchor_id string, generated string, marked boolean").repartition(7)
    got = V.inactive(j, spark.createDataFrame(tol, "case long, anchor_id string, generated string"), spark.createDataFrame(nv, "case long, anchor_id string"),
                     spark.createDataFrame(marks, "case long, anchor_id string"))
    assert plan(got).count("REPARTITION_BY_NUM") == 1
    want = {}
    for i, (entries, there) in enumerate(((tol, {x[:3] for x in judged}), (nv, {x[:2] for x in judged}), (marks, {x[:2] for x in judged if x[3]}))):
        for e in entries:
            if None in e or e not in there:
                want.setdefault(e[0], [0, 0, 0])[i] += 1
    assert {r["case"]: [r["tolerances"], r["not_variables"], r["marks"]] for r in got.collect()} == want
    assert all(r["inactive"] == sum(want[r["case"]]) for r in got.collect())


def test_rows_of_a_tab_are_judged_once(spark, tmp_path):  # F26
    sf = review_lines(spark, tmp_path)
    p = plan(Q.tab_rows(spark, sf))
    assert p.index("rangepartitioning") < p.index("REPARTITION_BY_COL") < p.index("Join")
    state = {(r["case"], r["pos"]): r["state"] for r in Q.display_states(spark, sf).collect()}
    got = [(r["case"], r["pos"], r["state"]) for r in Q.tab_rows(spark, sf).collect()]
    assert sorted(got) == sorted((*k, s) for k, s in state.items() if s in ("non_risolta", "regressione", "da_fare", "in_corso", "da_verificare"))
    assert [c for c, _, _ in got] == sorted(c for c, _, _ in got)
