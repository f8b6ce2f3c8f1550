"""What lets the Jaccard join grow: nothing goes through the driver, and sets that share a little make no cluster."""

import random

from pyspark.sql import functions as F

from logloom.llm import jaccard_join
from logloom.llm.common import Scratch, components

from .test_operators import docs_table, joined_by_force, shingles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_broadcast(spark):  # F2
    scratch = Scratch(spark, "t")
    df = docs_table(spark, [" ".join(f"{w}{i // 2}" for w in "some words of a text that is long enough".split()) for i in range(20)], extra=False)
    found = jaccard_join.join(df, scratch)
    kept = jaccard_join.one_per_group(df, found, scratch)
    tied = components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), scratch)
    for d in (found, kept, tied):
        d.collect()
        assert "Broadcast" not in plan(d)
    assert kept.count() == 10


def passages(n, rng):
    """Texts in which each one begins with the end of the one before: a chain of neighbours, none of them alike."""
    body = [[f"w{rng.randrange(10 ** 9)}" for _ in range(150)] for _ in range(n)]
    return [" ".join([*(body[i - 1][-40:] if i else []), *body[i]]) for i in range(n)]


def groups(rng, sizes):
    """Groups of texts alike, each text with a few words of its own, some a little longer."""
    out = []
    for g, n in enumerate(sizes):
        base = [f"g{g}x{i}" for i in range(rng.randrange(8, 140))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"y{rng.random()}"
            out.append(" ".join([*w, *[f"z{rng.random()}" for _ in range(rng.randrange(0, 6))]]))
    return out


def edges_of(spark, texts):
    scratch = Scratch(spark, "t")
    df = docs_table(spark, texts, extra=False)
    cls = scratch.write(jaccard_join.classes(df, "doc_id", "text").where("cls is not null").groupBy("cls").agg(F.min("id").alias("id")))
    full = scratch.write(jaccard_join.sets_of(df, cls, "doc_id", "text"))
    ids = {r["cls"]: r["id"] for r in cls.collect()}
    return {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in jaccard_join.clusters(full, 7, scratch).collect()}


def test_sets_that_share_a_little_make_no_cluster(spark):  # F1
    assert not edges_of(spark, passages(60, random.Random(3)))


def test_alike_sets_are_tied(spark):  # F1
    rng = random.Random(4)
    texts = groups(rng, [2, 2, 3, 8, 9, 10, 30, 40]) + passages(30, rng)
    sets = [shingles(t) for t in texts]
    want = joined_by_force(list(range(len(texts))), sets)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs_table(spark, texts, extra=False), Scratch(spark, "t")).collect()}
    assert got == want and len(set(want.values())) < len(texts) - 40
    # each link is inside a cluster, whatever the filter before
    low = list(range(len(texts)))
    edges = edges_of(spark, texts)
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    first = [sets.index(s) for s in sets]  # equal sets are one
    assert all(low[first[a]] == low[first[b]] for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))


def test_runs_of_equal_members_are_one():  # F1
    import numpy as np

    run, ident = np.array([0, 0, 0, 1, 1, 2, 2, 2]), np.array([2, 4, 6, 2, 4, 2, 4, 6])
    got = {(tuple(sorted(i)), k) for i, k in (([2, 4, 6], 2), ([2, 4], 1))}
    r, i, n = jaccard_join.distinct_runs(run, ident)
    assert {(tuple(i[r == x].tolist()), int(n[r == x][0])) for x in set(r.tolist())} == got
    a, b, n = jaccard_join.pairs_of_runs(run, ident)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == {(2, 4): 3, (2, 6): 2, (4, 6): 2}
    assert not len(jaccard_join.pairs_of_runs(run[:0], ident[:0])[0])
