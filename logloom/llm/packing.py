"""Lexical retrieval packing: a sharded BM25 index gives each seed document unused neighbours, which fill its window.

1. ``tokenised``: documents become ids where they are read (those of the ``tokenizers`` library, by ``MergeTokenizer``), and every
   task counts in how many of its documents a term stands. ``statistics`` adds the counts up: idf and mean length are those of the
   whole corpus.
2. Documents are dealt to shards by their rarest terms: ordered by the ranks of the eight rarest terms that another document
   holds too, so documents that share rare terms come together from anywhere in the table. The order is a range partitioning, and
   equal keys are ordered by a hash, so a group of copies of any size is cut like everything else.
3. A shard is ``shard_docs`` documents (or ``shard_tokens`` ids) in a row of that order. Its inverted index holds postings by term;
   a seed reads those of its own terms only.

A window of ``window`` ids starts with a seed: the rest of the document that overflowed the window before, or else the first unused
document. The unused documents that score best against the seed follow until the window is full; the last one is
cut and goes on in the next window. A window left open at the end of a shard goes on in the next shard; the one left at
the end of a task is cut into sequences of a power of two, which need no padding. Neighbours are sought in the seed's shard.

Ids are shuffled once. Memory is one shard, and the counts of the vocabulary, which go to all tasks. Sequence ids hold the
task's number.

Null and empty texts are documents of one id (the end). Ids are passed through, null and repeated ones too; extra columns are
ignored. Very long texts are cut over many windows. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_columns_checked

END_ID = 0
K1, B = 1.2, 0.75
#: The rank of a term that leads nowhere.
LAST = 0xFFFFFFFF
#: White space other than the space and the line end: texts with it are cut with more care.
_RARE = re.compile(r"[^\S \n]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: What a byte-level BPE cuts texts at, and the same for texts in which no two white spaces stand side by side.
_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_PLAIN_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_NOT_PLAIN = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")]
#: Runs of white space that are too long for a look-ahead.
_LONG_RUN = re.compile(r"\s{10000}")


class Remembered:
    """Ids by text, bounded in bytes: two generations of half the bound each, the older one dropped when the younger is full."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half, self.held = most // 2, 0

    def look(self, wanted: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known of ``wanted``, and what is not."""
        known, again, new = {}, {}, []
        for w in wanted:
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    new.append(w)
                    continue
                again[w] = ids
            known[w] = ids
        self.add(again)
        return known, new

    def add(self, some: dict[str, bytes]) -> None:
        for text, ids in some.items():
            self.held += 200 + 2 * len(text) + len(ids)
            if self.held > self.half:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[text] = ids


class ChunkTokenizer:
    """Token ids of whole texts by a byte-level BPE, with a memory of space-delimited chunks.

    A byte-level BPE never merges across a space before a word, so `` word`` has the same ids in every text. Where
    white space stands next to a space the text is cut only at single spaces between words. A batch's chunks are told apart by
    Arrow; new ones are encoded many in one text, in which only a chunk's first piece begins with a space.
    Chunks are remembered in ``cache_bytes``; when half of that is full, what has not been asked for since is let go.
    """

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        vocabulary = self.inner.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.chunks = Remembered(cache_bytes)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, bodies: list[str], at_once: int = 2000) -> dict[str, bytes]:
        """The ids of `` `` + body for each body."""
        plain, alone = [], []
        for b in bodies:
            (alone if not b or " " in b or b[0].isspace() or b[-1].isspace() else plain).append(b)
        out = {}
        runs = [plain[i:i + at_once] for i in range(0, len(plain), at_once)]
        for run, ids in zip(runs, self._ids([" " + " ".join(r) for r in runs])):
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(run) or at[0]:
                alone += run
                continue
            raw, ends = ids.tobytes(), (4 * at).tolist() + [4 * len(ids)]
            out.update((b, raw[ends[i]:ends[i + 1]]) for i, b in enumerate(run))
        out.update((b, ids.tobytes()) for b, ids in zip(alone, self._ids([" " + b for b in alone])))
        return out

    def _joined(self, parts: pa.ListArray) -> list[np.ndarray]:
        """Ids of texts given as their parts: a head, then chunks that follow a space."""
        bounds = parts.offsets.to_numpy().astype(np.int64)
        heads = bounds[:-1]
        coded = parts.values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        is_body = np.ones(len(code), bool)
        is_body[heads] = False
        wanted = np.unique(code[is_body])
        known, new = self.chunks.look({names[i] for i in wanted})
        if new:
            learnt = self._learn(new)
            self.chunks.add(learnt)
            known |= learnt
        first = self._ids([names[i] for i in code[heads]])
        pieces = [known[names[i]] for i in wanted] + [h.tobytes() for h in first]
        place = np.zeros(len(names), np.int64)
        place[wanted] = np.arange(len(wanted))
        code = place[code]
        code[heads] = np.arange(len(heads)) + len(wanted)
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        size = np.array([len(x) >> 2 for x in pieces], np.int64)
        begin, n = (np.cumsum(size) - size)[code], size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])]
        return np.split(ids, ends[bounds[1:-1] - 1])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if "  " in t or " \n" in t or "\n " in t or _RARE.search(t)]
        out: list = [None] * len(texts)
        rest = sorted(set(range(len(texts))).difference(odd))
        for at, parts in ((odd, lambda: pa.array([_SINGLE.split(texts[i]) for i in odd], pa.list_(pa.string()))),
                          (rest, lambda: pc.split_pattern(pa.array([texts[i] for i in rest], pa.string()), " "))):
            if at:
                for i, ids in zip(at, self._joined(parts())):
                    out[i] = ids
        return out


def merge_ranks(path: str, tokenizer) -> dict[bytes, int] | None:
    """Ids by bytes, where the lowest id that two neighbours make is the merge ``tokenizer`` does next; else None.

    That holds for a byte-level BPE and nothing else beside it, if merges make ids in rising order and every piece, encoded alone,
    is itself: a merge of two neighbours that is not in the file would then never come up.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, cuts = whole["model"], whole.get("pre_tokenizer") or {}
    if (whole.get("normalizer") or cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True)
            or model.get("type") != "BPE" or not all(t["special"] for t in whole.get("added_tokens") or [])
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
    vocabulary = model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if not all(p in vocabulary for p in [*byte, *made]):
        return None
    ids = [vocabulary[p] for p in made]
    if any(a >= b for a, b in zip(ids, ids[1:])) or any([t.id for t in tokenizer.model.tokenize(p)] != [i] for p, i in zip(made, ids)):
        return None
    return {bytes(byte[c] for c in p): vocabulary[p] for p in [*byte, *made]}


class MergeTokenizer(ChunkTokenizer):
    """Token ids of whole texts, the same as the ``tokenizers`` library's, by tiktoken over the merges of its file.

    Where the file is not one that ``merge_ranks`` can state, or tiktoken is not installed, ids come as in ``ChunkTokenizer``.
    """

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        super().__init__(path, cache_bytes)
        try:
            import tiktoken
        except ModuleNotFoundError:
            ranks = None
        else:
            ranks = merge_ranks(path, self.inner)
        self.cut = ranks and tiktoken.Encoding("merges", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})
        self.plain = ranks and tiktoken.Encoding("plain merges", pat_str=_PLAIN_CUTS, mergeable_ranks=ranks, special_tokens={})
        self.code = "H" if self.size <= 1 << 16 else "I"

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is None:
            return super().encode_batch(texts)
        out = []
        for t in texts:
            if not any(c in t for c in _NOT_PLAIN):
                ids = self.plain.encode_ordinary(t)
            elif len(t) < 100_000 or not _LONG_RUN.search(t):
                ids = self.cut.encode_ordinary(t)
            else:
                ids = self.inner.encode(t, add_special_tokens=False).ids
            out.append(np.frombuffer(array(self.code, ids), self.code))
        return out


@functools.lru_cache(2)
def shared_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, for all tasks there."""
    return MergeTokenizer(path)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Weight of terms that stand in ``df`` of ``n`` documents."""
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


class ShardIndex:
    """Postings of one shard's documents: by term, the documents that hold it and what it adds to their scores.

    Terms are token ids; ``weights`` are their idf over the whole corpus and ``mean`` is the corpus's mean length.
    """

    def __init__(self, docs: list[np.ndarray], weights: np.ndarray, mean: float):
        self.n = len(docs)
        length = np.array([len(d) for d in docs], np.int64)
        row = np.repeat(np.arange(self.n), length)
        # equal keys are one posting; their number is the term's frequency in the document
        key, tf = np.unique(np.concatenate([np.empty(0, np.int64), *docs]).astype(np.int64) << 32 | row, return_counts=True)
        term, self.doc = key >> 32, key & 0xFFFFFFFF
        self.part = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(mean, 1e-9)))
        self.start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        terms = term[self.start]
        self.stop = np.r_[self.start[1:], len(term)]
        self.place = np.zeros(int(terms[-1]) + 1 if len(terms) else 0, np.int64)
        self.place[terms] = np.arange(len(terms))
        self.last = np.zeros(len(self.place), np.int64)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every document for ``query``, whose terms count once each; only their postings are read."""
        query, order = query.astype(np.int64), np.arange(len(query))
        self.last[query] = order
        at = np.sort(self.place[query[self.last[query] == order]])
        lo, n = self.start[at], self.stop[at] - self.start[at]
        ends = np.cumsum(n)
        if not len(n):
            return np.zeros(self.n)
        read = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
        return np.bincount(self.doc.take(read), self.part.take(read), self.n)


class Packer:
    """Pieces of one task: (document, start, length, crc, tokens of the document, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.fill = 0
        self.open: list[list] = []

    def place(self, doc, ids: np.ndarray, out: list) -> bool:
        """Put a document into the stream; whether it overflowed into a new window."""
        at, over = 0, False
        while at < len(ids):
            n = min(len(ids) - at, self.window - self.fill)
            self.open.append([doc, at, ids[at:at + n], len(ids), self.sequence, self.fill])
            self.fill += n
            at += n
            if self.fill == self.window:
                self.flush(out)
                over = at < len(ids)
        return over

    def flush(self, out: list) -> None:
        for doc, at, ids, total, seq, offset in self.open:
            out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset))
        self.open, self.fill = [], 0
        self.sequence += 1

    def close(self, out: list) -> None:
        """Cut what is left into powers of two."""
        left, self.open, rest = self.open, [], self.fill
        self.fill = 0
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            while room:
                doc, at, ids, total, _, _ = left[0]
                n = min(room, len(ids))
                self.open.append([doc, at, ids[:n], total, self.sequence, self.fill])
                self.fill += n
                room -= n
                if n == len(ids):
                    left.pop(0)
                else:
                    left[0] = [doc, at + n, ids[n:], total, 0, 0]
            self.flush(out)


def pack_shard(docs: list[tuple], packer: Packer, out: list, weights: np.ndarray, mean: float) -> None:
    """Greedy order of one shard's documents (id, ids) into the packer's stream."""
    index = ShardIndex([d for _, d in docs], weights, mean)
    unused = np.ones(len(docs), bool)
    first, seed, score = 0, None, None
    for _ in range(len(docs)):
        if seed is None or packer.fill == 0:
            while not unused[first]:
                first += 1
            seed, nxt, score = first, first, None
        else:
            if score is None:
                score = np.where(unused, index.scores(docs[seed][1]), -1)
            nxt = int(score.argmax())
        unused[nxt] = False
        if score is not None:
            score[nxt] = -1
        if packer.place(*docs[nxt], out):
            seed, score = nxt, None


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, ids) of documents and, one per task, rows (terms, counts): how many of its documents hold a term.

    ``ids`` are unsigned numbers of 2 bytes where the vocabulary allows it, else of 4. Term -1 counts documents, -2 their ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(tokenizer_path)
        df, n, total, id_type = np.zeros(tokenizer.size, np.int64), 0, 0, None
        kind = width(tokenizer.size)
        end, last = np.array([END_ID], kind), np.zeros(tokenizer.size, np.int64)

        def rows(ids: pa.Array, tokens: list, terms: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.binary()), pa.array(terms, pa.list_(pa.int32())),
                                               pa.array(counts, pa.list_(pa.int64()))], names=["id", "ids", "terms", "counts"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [np.concatenate([ids, end]).astype(kind, copy=False)
                         for ids in tokenizer.encode_batch([t or "" for t in part.column(1).to_pylist()])]
                for x in found:  # a term counts where it stands last
                    term, at = x.astype(np.int64), np.arange(len(x))
                    last[term] = at
                    df[term[last[term] == at]] += 1
                n, total = n + len(found), total + sum(map(len, found))
                none = [None] * len(found)
                yield rows(part.column(0), [x.tobytes() for x in found], none, none)
        if n:
            there = np.flatnonzero(df)
            yield rows(pa.nulls(1, id_type), [None], [np.r_[there, -1, -2]], [np.r_[df[there], n, total]])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids binary, terms array<int>, counts array<long>")


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in a row, and how many each document has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) for x in raw], np.int64) // np.dtype(kind).itemsize


def statistics(table: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by term, number of documents and mean length; what comes to the driver is one row per vocabulary entry at most."""
    counted = (table.where("terms IS NOT NULL").select(F.inline(F.arrays_zip("terms", "counts")))
               .groupBy("terms").agg(F.sum("counts").alias("n")).collect())
    by_term = {r["terms"]: r["n"] for r in counted}
    n, total = by_term.pop(-1, 0), by_term.pop(-2, 0)
    df = np.zeros(max(by_term, default=0) + 1, np.int64)
    df[list(by_term)] = list(by_term.values())
    return df, n, total / max(n, 1)


def rarest(ids: np.ndarray, length: np.ndarray, rank: np.ndarray, most: int = 8) -> np.ndarray:
    """By document the ``most`` smallest ranks of its terms, ascending; missing ones are the largest number."""
    ranks, row = rank[ids], np.repeat(np.arange(len(length)), length)
    some = np.sort(ranks[::64])
    # low ranks first; the others only of documents that have too few of them
    low = ranks <= (some[len(some) // 8] if len(some) else 0)
    held = np.unique(row[low] << 32 | ranks[low].astype(np.int64))
    few = np.bincount(held >> 32, minlength=len(length)) < most
    rest = np.flatnonzero(few[row] & ~low)
    if len(rest):
        held = np.unique(np.concatenate([held, row[rest] << 32 | ranks[rest].astype(np.int64)]))
    lo = np.searchsorted(held, np.arange(len(length) + 1) << 32)
    at = lo[:-1, None] + np.arange(most)
    return np.where(at < lo[1:, None], held[np.minimum(at, max(len(held) - 1, 0))] & 0xFFFFFFFF, LAST) if len(held) else (
        np.full((len(length), most), LAST))


def pack(docs: DataFrame, scratch: Scratch | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         window: int = 1024, shard_docs: int = 256, shard_tokens: int = 2_000_000) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with_columns_checked(docs, id_col, text_col)
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    table = scratch.write(tokenised(docs, tokenizer_path, id_col, text_col), "ids")
    df, n, mean = statistics(table)
    kind = width(shared_tokenizer(tokenizer_path).size)
    weights = idf(df, n).astype(np.float32)
    # terms from the rarest on; one that a single document holds leads to no other and comes last
    rank = np.empty(len(df), np.uint32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    rank[df < 2] = LAST

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = rarest(*numbers(batch.column(1), kind), rank).astype(">u4").tobytes()
                step = len(raw) // batch.num_rows
                key = pa.array([raw[i:i + step] for i in range(0, len(raw), step)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["id", "ids", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        shard, held, doc_type = [], 0, None

        def rows(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            ids, length = numbers(batch.column(1), kind)
            for doc, own in zip(batch.column(0).to_pylist(), np.split(ids.astype("<u4"), np.cumsum(length)[:-1])):
                shard.append((doc, own))
                held += len(own)
                if len(shard) >= shard_docs or held >= shard_tokens:
                    out: list = []
                    pack_shard(shard, packer, out, weights, mean)
                    shard, held = [], 0
                    yield rows(out)
        if doc_type is not None:
            out = []
            pack_shard(shard, packer, out, weights, mean)
            packer.close(out)
            yield rows(out)

    dealt = (table.where("ids IS NOT NULL").select("id", "ids").mapInArrow(keyed, f"id {id_type}, ids binary, key binary")
             .withColumn("tie", F.xxhash64("ids", "id")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "id"))
    return dealt.select("id", "ids").mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{x} long" for x in names[1:]))
