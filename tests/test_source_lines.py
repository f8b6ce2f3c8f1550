"""The ordered search with a moving cursor against a plain loop."""

import random
import re

from logloom.operators import source_lines as S

DIFF = "doc int, side string, id int, text string, before string, after string"
LINE = "doc int, side string, line int, text string"


def by_force(diffs, lines):
    stream, starts = "", []
    for n, t in sorted(lines):
        if t.split():
            if stream:
                stream += " "
            starts.append((len(stream), n))
            stream += " ".join(t.split())
    line_of = lambda at: [n for s, n in starts if s <= at][-1]
    cursor, out = 0, {}
    for ident, text, before, after in sorted(diffs):
        w, b, a = (x or "" for x in (text, before, after))
        w, b, a = w.split(), b.split(), a.split()
        tries = [(" ".join(w), 0)] + ([(" ".join(w[:3]), 0)] if len(w) > 3 else [])
        if len(w) > 1 and len(re.findall(rf"(?<!\S){re.escape(max(w, key=len))}(?!\S)", stream)) == 1:
            tries.append((max(w, key=len), 0))
        tries += [(" ".join(b[-3:]), 1), (" ".join(a[:3]), 0)]
        out[ident] = None
        for needle, end in tries:
            at = stream.find(needle, cursor) if needle else -1
            at = stream.find(needle) if needle and at < 0 else at
            if at >= 0:
                cursor = at + len(needle)
                out[ident] = line_of(cursor - 1 if end else at)
                break
    return out


def test_random_documents(spark):
    rng = random.Random(21)
    words = ["a", "bb", "ccc", "dd", "(e", "f.", "ab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    diffs, lines, want = [], [], {}
    for d in range(60):
        for side in "LR":
            own = [(n * 2, rng.choice(["", "  "]) + text(6).replace(" ", rng.choice([" ", "  "]))) for n in range(rng.randrange(9))]
            todo = [(i, rng.choice([text(6), None, "x y", "zz ccc a"]), rng.choice([None, text(5)]), rng.choice(["", text(5)])) for i in range(rng.randrange(1, 9))]
            lines += [(d, side, *x) for x in own]
            diffs += [(d, side, *x) for x in todo]
            want |= {(d, side, i): n for i, n in by_force(todo, own).items()}
    got = {(r["doc"], r["side"], r["id"]): r["line"] for r in S.located(spark.createDataFrame(diffs, DIFF), spark.createDataFrame(lines, LINE)).collect()}
    assert got == want
    assert None in want.values() and len(set(want.values())) > 5


def test_repeated_texts_map_to_successive_places(spark):
    lines = [(1, s, n, t) for s in "LR" for n, t in enumerate(["Totale 10", "Voce", "Totale 10", "", "Totale 10"])]
    diffs = spark.createDataFrame([(1, i, "Totale 10", "Totale 10" if i != 2 else "manca", "Voce", "") for i in range(4)], "doc int, id int, left_text string, right_text string, before string, after string")
    got = {r["id"]: (r["left_line"], r["right_line"]) for r in S.both_sides(diffs, spark.createDataFrame(lines, LINE)).collect()}
    assert got == {0: (0, 0), 1: (2, 2), 2: (4, 1), 3: (0, 2)}
