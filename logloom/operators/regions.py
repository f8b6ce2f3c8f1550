"""Changes cut into regions: at unmatched blocks, at far gaps; the pieces paired again and compared once more on their own.

A change is one row with the keys of both sides. What cuts it is brought to it by interval joins or windows; the choice among its
pieces then looks at this row alone, so a row's size, not a document's, bounds a task.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .diff import OPCODES, _opcodes, split_far
from ..session import by_merge
from .intervals import within

# A piece up to this long is shared between two partners; what a pair of pieces with nothing in common is worth;
# the length of two texts together beyond which only their characters are counted.
SHARE_MAX, BONUS, LONG = 60, 0.05, 1200


def ratio(a, b) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def complement(size: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What disjoint sorted ranges leave of ``[0, size)``."""
    edges = [0, *(x for r in taken for x in r), size]
    return [(s, e) for s, e in zip(edges[::2], edges[1::2]) if e > s]


def facing(a: list[str], b: list[str], left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple]:
    """Which free pieces of the two sides go together.

    Equal numbers or many on both sides: in order. One against many: with the most similar; one short piece against two is
    itself cut where both parts are most similar to the two (nearest to the proportional place if that is a tie).
    """
    if not left or not right:
        return []
    if len(left) > 1 and len(right) > 1 or len(left) == len(right):
        return list(zip(left, right))
    turned = len(right) == 1
    own, other, (one,), many = (b, a, right, left) if turned else (a, b, left, right)
    keys = own[slice(*one)]
    parts = [other[slice(*m)] for m in many]
    if len(many) == 2 and len(keys) <= SHARE_MAX:
        middle = len(keys) * len(parts[0]) / (len(parts[0]) + len(parts[1]))
        cut = max(range(len(keys) + 1), key=lambda k: (ratio(keys[:k], parts[0]) + ratio(keys[k:], parts[1]), -abs(k - middle)))
        found = [((one[0], one[0] + cut), many[0]), ((one[0] + cut, one[1]), many[1])]
        found = [p for p in found if p[0][1] > p[0][0]]
    else:
        alike = lambda m: ratio(m[1], keys) if turned else ratio(keys, m[1])
        found = [(one, max(zip(many, parts), key=alike)[0])]
    return [(m, o) for o, m in found] if turned else found


def regions(a: list[str], b: list[str], left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The parts of a change whose sides hold the whole ranges ``left`` and ``right``: each range alone, the rest in pairs."""
    free_l, free_r = complement(len(a), left), complement(len(b), right)
    pairs = facing(a, b, free_l, free_r)
    covered_l, covered_r = {p[0] for p in pairs}, {p[1] for p in pairs}
    first_l = min((p[0][0] for p in pairs), default=len(a))
    first_r = min((p[1][0] for p in pairs), default=len(b))
    # a piece that was shared is used up by its parts
    whole = lambda piece, covered: any(piece[0] <= s and e <= piece[1] for s, e in covered)
    out = [(*x, *y) for x, y in pairs]
    out += [(s, e, *([0, 0] if s < first_l else [len(b)] * 2)) for s, e in [*left, *(p for p in free_l if not whole(p, covered_l))]]
    out += [(*([0, 0] if s < first_r else [len(a)] * 2), s, e) for s, e in [*right, *(p for p in free_r if not whole(p, covered_r))]]
    return sorted(out, key=lambda r: (r[0], r[2], r[1], r[3]))


def refined(a: list[str], b: list[str], part: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """A two-sided part compared again on its own: the ranges in which it really differs."""
    i1, i2, j1, j2 = part
    if i1 == i2 or j1 == j2:
        return [part]
    return [(i1 + o["i1"], i1 + o["i2"], j1 + o["j1"], j1 + o["j2"]) for o in _opcodes(a[i1:i2], b[j1:j2])]


def _rows(parts: list[tuple[int, int, int, int]]) -> list[dict]:
    return [dict(zip(("i1", "i2", "j1", "j2"), p)) for p in parts]


@F.pandas_udf(OPCODES)
def cut_at_ranges(left: pd.Series, right: pd.Series, left_ranges: pd.Series, right_ranges: pd.Series, as_is: pd.Series) -> pd.Series:
    """Regions of changes at the ranges they hold, two-sided ones compared again unless ``as_is``."""
    def one(a, b, lr, rr, keep):
        a, b = list(a), list(b)
        parts = regions(a, b, sorted((r["s"], r["e"]) for r in lr), sorted((r["s"], r["e"]) for r in rr))
        return _rows(parts if keep else [r for p in parts for r in refined(a, b, p)])

    return pd.Series([one(*x) for x in zip(left, right, left_ranges, right_ranges, as_is)])


def _finish(rows: DataFrame) -> DataFrame:
    """Parts ``c`` of changes as changes of their own, in global positions, with their keys and op."""
    cut = lambda side, s, e: F.slice(side, F.col(f"c.{s}") + 1, F.col(f"c.{e}") - F.col(f"c.{s}"))
    out = rows.withColumn("_l", cut("left_keys", "i1", "i2")).withColumn("_r", cut("right_keys", "j1", "j2"))
    i, j = F.col("i1"), F.col("j1")
    out = out.withColumn("i2", i + F.col("c.i2")).withColumn("j2", j + F.col("c.j2")).withColumn("i1", i + F.col("c.i1")).withColumn(
        "j1", j + F.col("c.j1")).withColumn("left_keys", F.col("_l")).withColumn("right_keys", F.col("_r")).drop("c", "_l", "_r")
    op = F.when(F.size("right_keys") == 0, "mancante").when(F.size("left_keys") == 0, "in_piu").otherwise("cambiato")
    return out.withColumn("op", op)


def unmatched_ranges(aligned: DataFrame, spans: DataFrame, least: int = 2) -> DataFrame:
    """(pair_id, side, start, end): runs of unpaired blocks, side by side, of at least ``least`` lines together.

    ``aligned`` (pair_id, l, r) with a null side for unpaired blocks; ``spans`` (pair_id, side, block, start, end, lines).
    """
    alone = aligned.where(F.col("l").isNull() | F.col("r").isNull()).select(
        "pair_id", F.when(F.col("r").isNull(), "L").otherwise("R").alias("side"), F.coalesce("l", "r").alias("block"))
    s = alone.join(by_merge(spans), ["pair_id", "side", "block"]).where("end > start")
    w = Window.partitionBy("pair_id", "side").orderBy("start")
    run = s.withColumn("_g", F.sum(F.coalesce(F.col("start") != F.lag("end").over(w), F.lit(True)).cast("int")).over(w))
    return run.groupBy("pair_id", "side", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("lines").alias("n")).where(
        F.col("n") >= least).select("pair_id", "side", "start", "end")


def split_at_bounds(changes: DataFrame, ranges: DataFrame, as_is: Column | None = None) -> DataFrame:
    """``changes`` cut at the whole unmatched ranges in them; the two-sided parts of a cut change keep only what differs.

    ``changes`` (pair_id, op, i1, i2, j1, j2, left_keys, right_keys); ``ranges`` (pair_id, side, start, end). Parts of changes marked by
    ``as_is`` (one that holds a slot) are not compared again.
    """
    c = changes.withColumn("_id", F.struct("i1", "i2", "j1", "j2")).withColumn("_as", F.coalesce(as_is, F.lit(False)) if as_is is not None else F.lit(False))

    def held(side: str, lo: str, hi: str, name: str) -> DataFrame:
        r = ranges.where(F.col("side") == side).select("pair_id", "start", "end")
        inside = within(c.where(F.col(hi) > F.col(lo)).select("pair_id", "_id", F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), r, ["pair_id"], ("_lo", "_hi"), ("start", "end"))
        return inside.groupBy("pair_id", "_id").agg(F.array_sort(F.collect_list(F.struct(
            (F.col("start") - F.col("_lo")).cast("int").alias("s"), (F.col("end") - F.col("_lo")).cast("int").alias("e")))).alias(name))

    j = c.join(by_merge(held("L", "i1", "i2", "_lr")), ["pair_id", "_id"], "left").join(by_merge(held("R", "j1", "j2", "_rr")), ["pair_id", "_id"], "left")
    cut = F.col("_lr").isNotNull() | F.col("_rr").isNotNull()
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    parts = j.where(cut).withColumn("c", F.explode(cut_at_ranges(
        "left_keys", "right_keys", F.coalesce("_lr", none), F.coalesce("_rr", none), "_as")))
    keep = changes.columns
    return j.where(~cut).select(*keep).unionByName(_finish(parts).select(*keep))


# ------------------------------------------------------------- far pieces ---

def pieces_in_order(left: list[tuple[str, str]], right: list[tuple[str, str]]) -> list[tuple[int | None, int | None]]:
    """(text, zone) pieces of the two sides paired in order, with the largest similarity in all; other zones never meet.

    ``best[x][y]`` is what the pieces from x and y on can reach. Of equal ways the one that pairs goes first, then the one that
    leaves the left piece alone.
    """
    def worth(a: tuple[str, str], b: tuple[str, str]) -> float | None:
        if a[1] != b[1]:
            return None
        m = difflib.SequenceMatcher(None, a[0], b[0], autojunk=False)
        return BONUS + (m.quick_ratio() if len(a[0]) + len(b[0]) > LONG else m.ratio())

    gain = [[worth(a, b) for b in right] for a in left]
    best = [[0.0] * (len(right) + 1) for _ in range(len(left) + 1)]
    step: dict[tuple[int, int], int] = {}
    for x in reversed(range(len(left))):
        for y in reversed(range(len(right))):
            ways = [(best[x][y + 1], 0), (best[x + 1][y], 1)]
            if gain[x][y] is not None:
                ways.append((gain[x][y] + best[x + 1][y + 1], 2))
            top = max(w for w, _ in ways)
            best[x][y] = top
            step[x, y] = max(k for w, k in ways if top - w < 1e-9)
    out, x, y = [], 0, 0
    while x < len(left) or y < len(right):
        k = step.get((x, y), 1 if y == len(right) else 0)
        out.append((x if k else None, y if k != 1 else None))
        x, y = x + (k > 0), y + (k != 1)
    return out


@F.pandas_udf(OPCODES)
def pair_pieces(left: pd.Series, right: pd.Series, left_pieces: pd.Series, right_pieces: pd.Series) -> pd.Series:
    """The parts of changes after their far pieces were paired again, two-sided ones compared again."""
    def one(a, b, lp, rp):
        a, b = list(a), list(b)
        lp, rp = ([(p["s"], p["e"], p["zone"]) for p in sorted(x, key=lambda p: p["s"])] for x in (lp, rp))
        text = lambda keys, p: (" ".join(keys[p[0]:p[1]]), p[2])
        out, i, j = [], 0, 0
        for x, y in pieces_in_order([text(a, p) for p in lp], [text(b, p) for p in rp]):
            if x is None:
                out.append((i, i, rp[y][0], rp[y][1]))
                j = rp[y][1]
            elif y is None:
                out.append((lp[x][0], lp[x][1], j, j))
                i = lp[x][1]
            else:
                out += refined(a, b, (lp[x][0], lp[x][1], rp[y][0], rp[y][1]))
                i, j = lp[x][1], rp[y][1]
        return _rows(out)

    return pd.Series([one(*x) for x in zip(left, right, left_pieces, right_pieces)])


def spread_changes(changes: DataFrame, words: DataFrame) -> DataFrame:
    """``changes`` cut where their words lie far apart or change zone, the pieces of both sides paired again in order.

    ``changes`` (pair_id, op, i1, i2, j1, j2, left_keys, right_keys); ``words`` (pair_id, side, pos, page, x0, y0, x1, y1, zone).
    """
    c = changes.withColumn("_id", F.struct("i1", "i2", "j1", "j2"))
    sides = [c.where(F.col(hi) > F.col(lo)).select("pair_id", "_id", F.lit(s).alias("side"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
             for s, lo, hi in (("L", "i1", "i2"), ("R", "j1", "j2"))]
    placed = within(sides[0].unionByName(sides[1]), words.select("pair_id", "side", "pos", "page", "x0", "y0", "x1", "y1", "zone"),
                    ["pair_id", "side"], ("_lo", "_hi"), "pos").withColumn("change", F.col("_id"))
    p = split_far(placed).groupBy("pair_id", "_id", "side", "piece", "_lo", "_hi").agg(
        F.min("pos").alias("s"), F.min_by("zone", "pos").alias("zone"))
    w = Window.partitionBy("pair_id", "_id", "side").orderBy("s")
    # words without a place belong to the piece before them
    p = p.withColumn("e", F.coalesce(F.lead("s").over(w), "_hi")).withColumn("s", F.when(F.lag("s").over(w).isNull(), F.col("_lo")).otherwise(F.col("s")))
    row = F.struct((F.col("s") - F.col("_lo")).cast("int").alias("s"), (F.col("e") - F.col("_lo")).cast("int").alias("e"), "zone")
    g = p.groupBy("pair_id", "_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, row))).alias(n) for s, n in (("L", "_lp"), ("R", "_rp"))])
    j = c.join(by_merge(g), ["pair_id", "_id"], "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int,zone:string>>)")
    j = j.withColumn("_lp", F.coalesce("_lp", none)).withColumn("_rp", F.coalesce("_rp", none))
    apart = (F.size("_lp") > 1) | (F.size("_rp") > 1) | (
        (F.size("_lp") == 1) & (F.size("_rp") == 1) & (F.get("_lp", F.lit(0))["zone"] != F.get("_rp", F.lit(0))["zone"]))
    known = ((F.size("_lp") > 0) | (F.size("left_keys") == 0)) & ((F.size("_rp") > 0) | (F.size("right_keys") == 0))
    cut = apart & known
    parts = j.where(cut).withColumn("c", F.explode(pair_pieces("left_keys", "right_keys", "_lp", "_rp")))
    keep = changes.columns
    return j.where(~cut).select(*keep).unionByName(_finish(parts).select(*keep))
