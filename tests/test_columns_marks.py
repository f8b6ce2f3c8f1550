"""Corridors and watermarks on random pages against plain restatements."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from logloom.operators import columns as C
from logloom.operators import marks as M

CHAR = 5.0
WIDTH = C.CORRIDOR_CHARS * CHAR


def random_page(rng):
    """Lines of word boxes: two or three columns of ragged or full lines, some across, some pages without columns."""
    kind, lines = rng.choice(["two", "three", "none", "table"]), {}
    for n in range(rng.randrange(2, 24)):
        words, x = [], 40.0
        stops = {"two": [250, 470], "three": [170, 320, 470], "none": [470], "table": [120, 250, 470]}[kind]
        if rng.random() < .1:
            stops = [stops[-1]]
        for s in stops:
            full = s - (rng.randrange(8) if kind != "table" else rng.randrange(60))
            while x < full - 12:
                end = min(x + rng.randrange(10, 60), full)
                words.append((x, float(end)))
                x = end + rng.choice([2.0, 3.0, 4.0, 20.0 if kind == "none" else 3.0])
            x = s + rng.choice([18.0, 25.0, 25.0, 25.0, 30.0])
        if words:
            lines[n] = words
    return lines


def runs_of(line):
    out = []
    for a, b in sorted(line):
        if out and a - out[-1][1] < WIDTH:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def corridors_by_force(lines):
    lines = [sorted(line) for line in lines.values()]
    if len(lines) < 6:
        return []
    left, right = min(a for x in lines for a, _ in x), max(b for x in lines for _, b in x)
    runs, size = [runs_of(x) for x in lines], int(right - left) + 1
    cover = [sum(any(int(a - left) <= k < min(size, int(b - left) + 1) for a, b in r) for r in runs) for k in range(size)]
    low = [c <= .2 * len(lines) for c in cover]
    spots, k = [], 0
    while k < size:
        e = k
        while e < size and low[e]:
            e += 1
        if e > k:
            least = [i for i in range(k, e) if cover[i] == min(cover[k:e])]
            if k > 0 and e < size:
                spots.append(least[len(least) // 2])
        k = e + 1
    found = []
    for k in sorted(spots, key=lambda k: (cover[k], abs(k - size / 2), k)):
        x = left + k + .5
        clear = [i for i, r in enumerate(runs) if not any(a <= x <= b for a, b in r)]
        ends = sorted(m for i in clear if (m := max((b for _, b in runs[i] if b < x), default=None)) is not None)
        starts = sorted(m for i in clear if (m := min((a for a, _ in runs[i] if a > x), default=None)) is not None)
        lo = ends[int(.9 * (len(ends) - 1))] if ends else left
        hi = starts[int((1 - .9) * (len(starts) - 1))] if starts else right
        if not (hi > lo and hi - lo >= WIDTH and left < lo and hi < right):
            continue
        least = max(3, int(.3 * len(clear)))
        if sum(any(b <= lo for _, b in lines[i]) for i in clear) < least or sum(any(a >= hi for a, _ in lines[i]) for i in clear) < least:
            continue
        begin = sorted(a[0] for i in clear if (a := [a for a, _ in lines[i] if a >= hi]))
        if max((sum(x <= y <= x + 5 for y in begin) for x in begin), default=0) < 3:
            continue
        stop = [max(b) for i in clear if (b := [b for _, b in lines[i] if b <= lo])]
        if sum(b >= lo - .15 * (lo - left) for b in stop) < .5 * len(stop):
            continue
        found.append((x, lo, hi))
    out = []
    for x, lo, hi in found:
        if len(out) < 2 and not any(a - WIDTH <= x <= b + WIDTH or lo < b and hi > a for a, b in out):
            out.append((lo, hi))
    return sorted(out)


def parts(spark, pages):
    rows = [(d, p, n, a, b) for (d, p), lines in pages.items() for n, words in lines.items() for a, b in words]
    w = spark.createDataFrame(rows, "doc int, page int, line int, x0 double, x1 double")
    return C.line_parts(w, w.select("doc").distinct().withColumn("char", F.lit(CHAR)))


def found_on(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc"], r["page"]].append((r["x0"], r["x1"]))
    return {k: sorted(v) for k, v in out.items()}


def test_corridors(spark):
    rng = random.Random(11)
    pages = {(d, p): random_page(rng) for d in range(12) for p in range(25)}
    want = {k: c for k, lines in pages.items() if (c := corridors_by_force(lines))}
    got = found_on(C.corridors(parts(spark, pages)))
    assert got == want
    assert len(want) > 40 and any(len(c) == 2 for c in want.values())


def fits_by_force(lines, given):
    lines = [sorted(x) for x in lines.values()]
    across = sum(any(a <= g0 and b >= g1 for a, b in runs_of(x) for g0, g1 in given) for x in lines)
    return across <= .2 * len(lines) and all(any(b <= g0 for x in lines for _, b in x) and any(a >= g1 for x in lines for a, _ in x) for g0, g1 in given)


def test_borrowed_corridors(spark):
    rng = random.Random(12)
    sides = [{}, {}]
    for d in range(160):
        page = random_page(rng)
        sides[0][d, 0] = page
        sides[1][d, 0] = random_page(rng) if rng.random() < .3 else {n: x for n, x in page.items() if rng.random() < .8} or page
    sides[1][500, 0] = random_page(rng)
    own = [{k: corridors_by_force(x) for k, x in s.items()} for s in sides]
    want = {(k, "LR"[i]): c for i in (0, 1) for k, c in own[i].items()}
    lent = 0
    for k in sides[0]:
        order = [(0, 1), (1, 0)] if len(sides[0][k]) >= len(sides[1][k]) else [(1, 0), (0, 1)]
        give, take = next(((g, t) for g, t in order if own[g][k]), (None, None))
        if give is not None and fits_by_force(sides[take][k], own[give][k]):
            lent += own[take][k] != own[give][k]
            want[k, "L"] = want[k, "R"] = own[give][k]
    left, right = (parts(spark, s).cache() for s in sides)
    got = {((r["doc"], r["page"]), r["side"]): [tuple(c) for c in r["corridors"]]
           for r in C.borrowed(left, right, C.corridors(left), C.corridors(right)).collect()}
    assert got == want and lent > 3


WORD = "doc int, page int, pos int, text string, size double, angle int, light boolean, on_background boolean, x0 double, y0 double, x1 double, y1 double"


def marks_by_force(words, pages):
    by = defaultdict(list)
    for w in words:
        by[w[0], w[1]].append(w)
    found = []
    for (d, p), ws in by.items():
        group = {w[2]: w[2] for w in ws}
        for _ in ws:
            for a in ws:
                for b in ws:
                    r = max(a[4], b[4])
                    if a[8] - r <= b[10] and b[8] - r <= a[10] and a[9] - r <= b[11] and b[9] - r <= a[11]:
                        group[a[2]] = group[b[2]] = min(group[a[2]], group[b[2]])
        for g in set(group.values()):
            m = sorted((w for w in ws if group[w[2]] == g), key=lambda w: (w[9], w[8], w[2]))
            sizes = sorted(w[4] for w in m)
            mid = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
            x0, y0, x1, y1 = min(w[8] for w in m), min(w[9] for w in m), max(w[10] for w in m), max(w[11] for w in m)
            found.append((d, p, g, " ".join(w[3].lower() for w in m), mid, (x0 + x1) / 2, (y0 + y1) / 2, all(w[6] and not w[7] for w in m), all(w[5] % 90 for w in m)))
    out = {}
    for d, p, g, t, s, x, y, pale, diagonal in found:
        width, height = pages[d, p]
        again = any(e[0] == d and e[1] != p and e[3] == t and abs(e[4] - s) <= .1 * max(s, e[4]) and abs(e[5] - x) <= .1 * width and abs(e[6] - y) <= .1 * height for e in found)
        out[d, p, g] = (t, pale, diagonal, again, pale or diagonal and again)
    return out


def test_watermarks(spark):
    rng = random.Random(13)
    pages = {(d, p): (rng.choice([600.0, 600.0, 900.0]), 800.0) for d in range(40) for p in range(rng.randrange(1, 5))}
    words = []
    for (d, p), _size in pages.items():
        for k in range(rng.randrange(1, 7)):
            x, y, s = rng.choice([100, 130, 180, 400]) + rng.randrange(12), rng.choice([100, 160, 500]) + rng.randrange(12), rng.choice([30.0, 31.0, 33.0, 45.0])
            words.append((d, p, k, rng.choice(["Bozza", "bozza", "COPIA"]), s, rng.choice([0, 45, 45]), rng.random() < .4, rng.random() < .3, float(x), float(y), x + 60.0, y + s))
    w = spark.createDataFrame(words, WORD)
    pg = spark.createDataFrame([(*k, *v) for k, v in pages.items()], "doc int, page int, width double, height double")
    large = M.watermark_candidates(w, w.select("doc").distinct().withColumn("body", F.lit(10.0)))
    assert large.count() == len(words)
    clustered = M.clusters(large).cache()
    got = {(r["doc"], r["page"], r["cluster"]): (r["text"], r["pale"], r["diagonal"], r["repeated"], r["accepted"]) for r in M.marks(clustered, pg).collect()}
    want = marks_by_force(words, pages)
    assert got == want
    assert {v[3] for v in want.values()} == {True, False} and any(v[4] for v in want.values())


def test_other_text_in_a_slot_is_content(spark):
    pg = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0)], "doc int, page int, width double, height double")
    word = lambda p, k, t, x, light: (1, p, k, t, 40.0, 0, light, False, x, 100.0, x + 80, 140.0)
    sides = [[word(0, 1, "Bozza", 100.0, True), word(1, 1, "Bozza", 100.0, True)], [word(0, 1, "299", 100.0, False), word(1, 1, "Bozza", 100.0, True), word(1, 2, "altro", 400.0, True)]]
    clustered = [M.clusters(spark.createDataFrame(s, WORD)) for s in sides]
    left, right = M.agreed(*(M.marks(c, pg) for c in clustered))
    assert sorted((r["page"], r["text"], r["accepted"]) for r in left.collect()) == [(0, "bozza", False), (1, "bozza", True)]
    assert sorted((r["page"], r["text"], r["accepted"]) for r in right.collect()) == [(0, "299", False), (1, "altro", True), (1, "bozza", True)]
    assert [(r["page"], r["pos"], r["zone"]) for r in M.marked_words(clustered[0], left).collect()] == [(1, 1, "filigrana")]
