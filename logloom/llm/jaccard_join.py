"""N-gram Jaccard join by partitions of the token universe: exact components of documents with similar shingle sets.

A document's set holds its distinct 5-word shingles (64-bit hashes; A-Z lower-cased). Documents link when the Jaccard
similarity of their sets is at least ``PERCENT`` / 100.

* **Size bands.** Band k holds sizes a(k) to a(k+1)-1 with a(k+1) = floor(a(k) / 0.8) + 1, so partners stand in the same or
  in adjacent bands. A set takes part in the group of its own band and in the one below.
* **Segments.** In group k the universe is hashed into m(k) segments, more than the largest symmetric difference H a linked
  pair of the group can have. So a linked pair has at least m(k) - H identical segments. The signature of a segment is a
  hash of the group, the segment and its tokens.
* **Budgets by cost.** An empty segment has budget 0 (its signature would be shared by everybody), another one 1: one
  signature. Spare segments pay for the empty ones. A set whose budgets still fall short of H + 1 raises its segments of two
  and more tokens to 2: their one-deletion neighbourhoods are indexed too. What is short even then meets in one list.
* **Filter.** A set with more than H segments that nobody else has links with nothing. Most documents go here, after one
  shuffle of signatures packed per task and bucket (16 bytes each) and counted in numpy.
* **Verify.** Among the remaining sets, pairs that share as many signatures as a link needs form clusters; each cluster is verified
  exactly, in blocks of ``block`` sets, and a block pair returns a spanning forest of its links, never all pairs.

Equal sets are collapsed to a class before anything is joined, so copies cost nothing. Null, empty and wordless texts have the
empty set and link with nothing; with fewer than five words the whole sequence is one shingle. A null id has a count but
no component (null) and links nothing. Repeated rows are rows of their own. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_merge
from .common import Scratch, components, free_name, mix64, shuffle_partitions, utf8, with_columns_checked

#: Words of a shingle, similarity in percent.
WORDS = 5
PERCENT = 80
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are ``most`` of them."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], hashes: WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for t in texts:
        w = t.lower().split()
        n = len(w)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(hashes.__getitem__, w), np.uint64, n)
        k = min(words, n)
        s = h[:n - k + 1].copy()
        for i in range(1, k):
            s *= _STEP
            s += h[i:n - k + 1 + i]
        if n < words:
            s += np.uint64(n)
        out.append(np.unique(mix64(s)))
    return out


def slices(texts: list[bytes], rows: int = 1024, size: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts and about ``size`` bytes: what a task has in hand at once."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (i - start == rows or held + len(t) > size):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def class_of(s: np.ndarray) -> int:
    """A 63-bit id of a set (the lowest bit is free), as a signed long."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())) & _EVEN)) if len(s) else 0


def band_starts(largest: int) -> np.ndarray:
    a = [1]
    while a[-1] <= largest:
        a.append(a[-1] * 100 // PERCENT + 1)
    return np.array([*a, a[-1] * 100 // PERCENT + 1], np.int64)


def most_apart(size: np.ndarray, below: bool) -> np.ndarray:
    """H: the largest symmetric difference of a link of a set, in its own group or in the one below (as the larger set)."""
    return 2 * size * (100 - PERCENT) // (100 + PERCENT) if below else size * (100 - PERCENT) // PERCENT


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Signatures of all sets in both groups, without one-deletion ones.

    Gives per signature (signature, set, below, segment's first place), and per (set, below) the number of non-empty segments.
    """
    size = np.array([len(s) for s in sets], np.int64)
    starts = band_starts(int(size.max(initial=1)))
    band = np.searchsorted(starts, size, "right") - 1
    tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    value = mix64(tokens + _STEP)
    owner = np.repeat(np.arange(len(sets)), size)
    parts = []
    for below in (0, 1):
        group = band - below
        top = starts[np.maximum(group, 0) + 1] - 1
        h = top * (100 - PERCENT) // PERCENT
        m = np.where(group >= 0, h + 1 + -(-(h + 1) // 10) + 2, 0)
        first = np.cumsum(m) - m
        mine = m[owner]
        use = mine > 0
        at = first[owner[use]] + (tokens[use] % mine[use].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, at, value[use])
        count = np.bincount(at, minlength=total)
        full = np.flatnonzero(count)
        whose = np.repeat(np.arange(len(sets)), m)[full]
        segment = full - first[whose]
        key = mix64(sums[full] + mix64(segment.astype(np.uint64) * _STEP + group[whose].astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        parts.append((key, whose, np.full(len(full), below), np.bincount(whose, minlength=len(sets)), m, at, use, count[full], full, sums))
    return size, band, tokens, value, owner, parts


def deletions(sets: list[np.ndarray], size, band, value, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, below) of the one-deletion neighbourhoods of the sets whose budgets of 1 fall short of H + 1."""
    keys, whose, flags = [], [], []
    owner = np.repeat(np.arange(len(sets)), size)
    for below, (_, seg_of, _, full_n, m, at, use, count, full, sums) in enumerate(parts):
        h = most_apart(size, bool(below))
        short = (m > 0) & (full_n <= h)
        if not short.any():
            continue
        tags = lambda seg, who: mix64(seg.astype(np.uint64) * _STEP + (band[who] - below).astype(np.uint64) * np.uint64(2))
        first = np.cumsum(m) - m
        # the segment itself, and the segment without each of its tokens where it has two or more
        own = short[seg_of]
        keys.append(mix64(sums[full[own]] + tags(full[own] - first[seg_of[own]], seg_of[own])))
        whose.append(seg_of[own])
        who = owner[use]
        dense = np.zeros(len(sums), np.int64)
        dense[full] = count
        del_ = short[who] & (dense[at] > 1)
        keys.append(mix64(sums[at[del_]] - value[use][del_] + tags(at[del_] - first[who[del_]], who[del_])))
        whose.append(who[del_])
        # budgets with the raised segments; what is still short meets in one list of its group
        raised = full_n + np.bincount(seg_of[own], weights=(count[own] > 1), minlength=len(sets))
        left = np.flatnonzero(short & (raised <= h))
        keys.append(mix64((band[left] - below).astype(np.uint64) + np.uint64(0x5EED)))
        whose.append(left)
        flags += [below] * (len(keys[-1]) + len(keys[-2]) + len(keys[-3]))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(whose), np.array(flags)


PACKED = "bucket int, sigs binary, sets binary, sizes binary"


def packed(sig: np.ndarray, ident: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Signatures and their sets as one row per bucket, 16 bytes a signature whatever the number of buckets."""
    order = np.argsort(sig)
    sig, ident = sig[order], ident[order]
    bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(sig) else []
    for a, b in zip(cuts, [*cuts[1:], len(sig)]):
        yield int(bucket[a]), sig[a:b].tobytes(), ident[a:b].tobytes(), b""


def unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(r[0] for r in rows), np.uint64), np.frombuffer(b"".join(r[1] for r in rows), np.int64)


def batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The packed rows of one bucket after the other, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(row)
    if held:
        yield now, held


def shared_runs(sig: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, set) of the signatures that at least two sets have; a set stands once in a run."""
    order = np.lexsort((ident, sig))
    sig, ident = sig[order], ident[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])] if len(sig) else np.empty(0, bool)
    sig, ident = sig[keep], ident[keep]
    run = np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1 if len(sig) else np.empty(0, np.int64)
    many = np.bincount(run)[run] > 1 if len(run) else np.empty(0, bool)
    return run[many], ident[many]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index each of n items reaches over the edges a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, cls) per row; ``cls`` is null for the empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], names=["id", "n_shingles", "cls"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, cls long")


#: Sets below this size link with equal sets only.
LEAST = PERCENT // (100 - PERCENT)


def candidates(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Classes (cls) that may link with another class, by the counting filter."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(texts):
                sets = {class_of(s): s for s in shingle_sets(texts[a:b], hashes) if len(s) >= LEAST}
                if not sets:
                    continue
                ids = np.fromiter(sets, np.int64, len(sets))
                size, *_, parts = signatures(list(sets.values()))
                rows = []
                for below, (key, whose, _, full_n, m, *_) in enumerate(parts):
                    rows += packed(key, ids[whose] | below, buckets)
                    some = m > 0
                    rows.append((-1 - int(ids[0] % buckets), (ids[some] | below).tobytes(), size[some].tobytes(), full_n[some].tobytes()))
                yield batch_of(rows, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "sigs", "sets", "sizes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ident", "shared", "full_n", "size"]
        for bucket, rows in by_bucket(batches):
            if bucket < 0:
                ident, size, full_n = (np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(3))
                shared = np.zeros(len(ident), np.int64)
            else:
                ident, shared = np.unique(shared_runs(*unpacked(rows))[1], return_counts=True)
                size = full_n = np.zeros(len(ident), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident, shared, full_n, size)], names=names)

    sums = (docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(pack, PACKED)
            .repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(count, "ident long, shared long, full_n long, size long")
            .groupBy("ident").agg(F.sum("shared").alias("shared"), F.max("full_n").alias("full_n"), F.max("size").alias("size")))
    below = F.col("ident").bitwiseAND(1) == 1
    apart = F.when(below, F.floor(2 * F.col("size") * (100 - PERCENT) / (100 + PERCENT))).otherwise(
        F.floor(F.col("size") * (100 - PERCENT) / PERCENT))
    return sums.where(F.col("shared") >= F.col("full_n") - apart).select(
        F.col("ident").bitwiseAND(F.lit(-2)).alias("cls")).distinct()


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of hashed ids in a Bloom filter: (hashes, 5)."""
    one = mix64(h.astype(np.int64).view(np.uint64))
    two = mix64(one + _STEP) | np.uint64(1)
    return ((one[:, None] + two[:, None] * np.arange(5, dtype=np.uint64)[None, :]) % np.uint64(bits)).astype(np.int64)


def bloom(hashed: DataFrame, count: int, most_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter over the long column of ``hashed``: 16 bits a key, but at most ``most_bits`` (8 MB by default).

    Tasks set bits of their own rows; the parts of the filter are merged on the executors.
    """
    bits = min(most_bits, max(1 << 16, 16 * count))
    bits += -bits % (1 << 16)
    part = 1 << 13

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[places(batch.column(0).to_numpy(), bits).ravel()] = True
        packed_bits = np.packbits(flags)
        yield batch_of([(i // part, packed_bits[i:i + part].tobytes()) for i in range(0, len(packed_bits), part) if packed_bits[i:i + part].any()],
                       [pa.int32(), pa.binary()], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, rows in by_bucket(batches):
            all_ = np.bitwise_or.reduce([np.frombuffer(r[0], np.uint8) for r in rows])
            yield batch_of([(no, all_.tobytes())], [pa.int32(), pa.binary()], ["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in hashed.mapInArrow(mark, "part int, bits binary").repartition("part").sortWithinPartitions("part").mapInArrow(
            merge, "part int, bits binary").collect():
        out[r["part"] * part:(r["part"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the wanted classes; ``wanted`` has (id, cls) with one id per class.

    Texts are not shuffled: a Bloom filter of bounded size tells most other documents apart where they are read. The few
    it lets through are sets like any other: they join clusters and are verified.
    """
    sc = docs.sparkSession.sparkContext
    filter_ = sc.broadcast(bloom(wanted.select(F.xxhash64("id").alias("h")), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flags, seen = WordHashes(), filter_.value, set()
        bits = 8 * len(flags)
        for batch in batches:
            at = places(batch.column(0).to_numpy(), bits)
            hit = ((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
            texts = utf8(batch.filter(pa.array(hit)).column(1))
            for a, b in slices(texts):
                rows = []
                for s in shingle_sets(texts[a:b], hashes):
                    c = class_of(s)
                    if len(s) >= LEAST and c not in seen:
                        seen.add(c)
                        rows.append((c, s.tobytes()))
                yield batch_of(rows, [pa.int64(), pa.binary()], ["cls", "shingles"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "cls long, shingles binary").dropDuplicates(["cls"])


#: Signatures of more sets than this tie their sets to one of them; those of fewer are counted pair by pair.
FEW = 8
#: What ``clusters`` takes from the buckets: demands, counted pairs, members of large runs, ties.
NEED, PAIR, MEMBER, TIE = range(4)


def pairs_of_runs(run: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, runs that hold both) of sorted runs of at most ``FEW``; two sets of the group above theirs are left to their own group."""
    who, at = np.unique(ident, return_inverse=True)
    keys = []
    for d in range(1, FEW):
        i = np.flatnonzero(run[:-d] == run[d:]) if len(run) > d else np.empty(0, np.int64)
        i = i[(ident[i] & ident[i + d] & 1) == 0]
        keys.append(at[i] * len(who) + at[i + d])
    pair, n = np.unique(np.concatenate(keys), return_counts=True)
    return who[pair // max(1, len(who))], who[pair % max(1, len(who))], n


def distinct_runs(run: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, set, runs with the same sets) of sorted runs: what copies share counts once, so many times."""
    if not len(run):
        return run, ident, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    _, one, of, n = np.unique(np.column_stack([np.add.reduceat(mix64(ident.view(np.uint64)), first), size.astype(np.uint64)]),
                              axis=0, return_index=True, return_inverse=True, return_counts=True)
    keep = np.zeros(len(first), bool)
    keep[one] = True
    return run[np.repeat(keep, size)], ident[np.repeat(keep, size)], np.repeat(n[of.ravel()], size)[np.repeat(keep, size)]


def clusters(sets: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between classes that share as many signatures as linked ones of their sizes must.

    A linked pair shares at least full - H of the signatures of either set, in the group of the smaller one. Signatures of at most
    ``FEW`` sets are counted for each pair, so a pair must have full - H less the signatures that each has in larger runs; a pair that has
    none of them may only be one of two sets with full - H signatures in larger runs, which are tied to one of the run. Without
    that count, sets that share any signature make one cluster of a growing part of all sets, and its verification is quadratic.
    Sets without a demand meet by one-deletion signatures.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(raw):
                ids, own = every[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                size, band, _, value, _, parts = signatures(own)
                rows = []
                for below, (key, whose, _, full_n, m, *_) in enumerate(parts):
                    rows += packed(key, ids[whose] | below, buckets)
                    some = m > 0
                    rows.append((-1 - int(ids[0] % buckets), (ids[some] | below).tobytes(), (full_n - most_apart(size, bool(below)))[some].tobytes(), b""))
                more, of, _ = deletions(own, size, band, value, parts)
                rows += [(*r[:3], b"deletions") for r in packed(more, ids[of], buckets)]
                yield batch_of(rows, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "sigs", "sets", "sizes"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])

        for bucket, rows in by_bucket(batches):
            if bucket < 0:
                ident, need = (np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(2))
                yield out(NEED, ident, ident, need)
                continue
            run, ident = shared_runs(*unpacked([r for r in rows if r[2]]))
            who, at = np.unique(ident, return_inverse=True)
            head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.empty(0, int)
            low = forest(at, at[np.repeat(head, np.diff(np.r_[head, len(run)]))], len(who))
            moved = low != np.arange(len(who))
            yield out(TIE, who[moved], who[low[moved]], np.ones(int(moved.sum()), np.int64))
            run, ident = shared_runs(*unpacked([r for r in rows if not r[2]]))
            few = np.bincount(run)[run] <= FEW if len(run) else np.empty(0, bool)
            yield out(PAIR, *pairs_of_runs(run[few], ident[few]))
            run, ident, n = distinct_runs(run[~few], ident[~few])
            yield out(MEMBER, ident, run + (bucket << 40), n)

    found = scratch.write(sets.mapInArrow(pack, PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
                          .mapInArrow(tie, "kind int, a long, b long, n long"), "signatures")
    of = lambda kind: found.where(F.col("kind") == kind)
    large = of(MEMBER).groupBy("a").agg(F.sum("n").alias("large"))
    need = scratch.write(of(NEED).select("a", F.col("n").alias("all")).join(by_merge(large), "a", "left").select(
        "a", "all", (F.col("all") - F.coalesce("large", F.lit(0))).alias("need")), "needs")
    other = need.select(F.col("a").alias("b"), F.col("all").alias("all_b"), F.col("need").alias("need_b"))
    pairs = of(PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")).join(by_merge(need), "a").where("n >= need").join(by_merge(other), "b").where(
        (F.col("n") >= F.col("need_b")) & (F.greatest("all", "all_b") > 0))
    members = of(MEMBER).join(by_merge(need.where("need <= 0").select("a")), "a").select("a", "b")
    stars = members.join(by_merge(members.groupBy("b").agg(F.min("a").alias("head"))), "b").where("a <> head").select("a", F.col("head").alias("b"))
    whole = lambda c: F.col(c).bitwiseAND(F.lit(-2)).alias(c)
    return pairs.select("a", "b").unionByName(stars).unionByName(of(TIE).select("a", "b")).select(whole("a"), whole("b")).distinct()


def linked(own: list[np.ndarray]) -> np.ndarray:
    """The smallest index each set reaches over links of this list."""
    n = len(own)
    size = np.array([len(s) for s in own], np.int64)
    token, column, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = df[column] > 1
    place = np.cumsum(df > 1) - 1
    column, owner = place[column[common]], owner[common]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide = max(1, (16 << 20) // max(1, n))
    for start in range(0, int(column.max(initial=-1)) + 1, wide):
        a, b = np.searchsorted(column, [start, start + wide])
        x = np.zeros((n, min(wide, int(column[b - 1]) - start + 1)), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    hit = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    a, b = np.nonzero(np.triu(hit, 1))
    return forest(a, b, n)


def verified(sets: DataFrame, cluster_of: DataFrame, block: int = 512) -> DataFrame:
    """Edges (a, b) between linked classes: a spanning forest per block pair of a cluster; ``cluster_of`` has (id, component)."""
    from pyspark.sql import Window

    numbered = cluster_of.select(F.col("id").alias("cls"), "component").withColumn(
        "no", F.row_number().over(Window.partitionBy("component").orderBy("cls")) - 1)
    sizes = cluster_of.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.floor(F.col("no") / block).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)))
    placed = numbered.join(by_merge(sizes), "component").select("cls", "component", mine.alias("mine"), other.alias("other")).select(
        "cls", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    keyed = placed.join(by_merge(sets), "cls").select(F.xxhash64("component", "i", "j").alias("k"), "component", "i", "j", "cls", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own = None, [], []
        rows: list[tuple] = []

        def settle() -> None:
            if len(own) == 2:
                both = len(np.intersect1d(*own, assume_unique=True))
                if 100 * both >= PERCENT * (len(own[0]) + len(own[1]) - both):
                    rows.append((ids[0], ids[1]))
            elif len(own) > 2:
                low = linked(own)
                rows.extend((ids[x], ids[y]) for x, y in enumerate(low) if x != y)

        for batch in batches:
            for _, c, i, j, cls, s in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, i, j) != now:
                    settle()
                    now, ids, own = (c, i, j), [], []
                ids.append(cls)
                own.append(np.frombuffer(s, np.uint64))
            if len(rows) > 4096:
                yield batch_of(rows, [pa.int64(), pa.int64()], ["a", "b"])
                rows = []
        settle()
        yield batch_of(rows, [pa.int64(), pa.int64()], ["a", "b"])

    return keyed.repartition("k").sortWithinPartitions("k", "component", "i", "j").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", sigs_per_bucket: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    with_columns_checked(docs, id_col, text_col)
    spark = docs.sparkSession
    table = scratch.write(classes(docs, id_col, text_col), "classes")
    named = table.where(F.col("id").isNotNull() & F.col("cls").isNotNull())
    firsts = scratch.write(named.groupBy("cls").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-int(total * 0.6) // sigs_per_bucket))
    wanted = scratch.write(candidates(docs, id_col, text_col, buckets).join(by_merge(firsts), "cls").select("id", "cls"), "wanted")
    sets = scratch.write(sets_of(docs, wanted, id_col, text_col), "sets")
    cluster_of = scratch.write(components(clusters(sets, buckets, scratch), scratch), "clusters")
    links = scratch.write(components(verified(sets, cluster_of), scratch), "links")
    of_class = firsts.join(by_merge(links.select(F.col("id").alias("cls"), "component")), "cls", "left").select(
        "cls", "id", F.coalesce("component", "cls").alias("component"))
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    final = scratch.write(of_class.join(by_merge(least), "component").select(F.col("cls").alias("_cls"), "component_id"), "final")
    return table.join(by_merge(final), F.col("cls") == F.col("_cls"), "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("cls").isNull(), F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_per_group(docs: DataFrame, joined: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id, and with one of the rows equal in id and text.

    Only rows that the Bloom filter of removed and repeated ids takes for such are joined; the others pass where they lie.
    Rows with a null id stay.
    """
    from pyspark.sql import Window

    found = scratch.write(joined.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min("component_id").alias("least"), F.count("*").alias("n")).where((F.col("least") != F.col(id_col)) | (F.col("n") > 1)), "suspects")
    sc = docs.sparkSession.sparkContext
    filter_ = sc.broadcast(bloom(found.select(F.xxhash64(id_col).alias("h")), found.count()))
    keyed = docs.withColumn(free_name(docs, "h"), F.xxhash64(id_col))
    at_h = len(docs.columns)
    gone, no = free_name(docs, "gone"), free_name(docs, "no")

    def split(hits: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = filter_.value
            for batch in batches:
                at = places(batch.column(at_h).to_numpy(), 8 * len(flags))
                hit = ((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
                yield batch.filter(pa.array(hit == hits)).select(list(range(at_h)))

        return keyed.mapInArrow(run, docs.schema)

    removed = found.where(F.col("least") != F.col(id_col)).select(F.col(id_col).alias(gone))
    maybe = split(True).join(by_merge(removed), F.col(id_col) == F.col(gone), "left_anti")
    first = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*docs.columns))
    repeated = maybe.where(F.col(id_col).isNotNull()).withColumn(no, F.row_number().over(first)).where(F.col(no) == 1).select(*docs.columns)
    return split(False).unionByName(repeated).unionByName(maybe.where(F.col(id_col).isNull()))
