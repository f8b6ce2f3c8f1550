"""SentencePiece encoding and decoding of whole texts by a merge-type prefix table.

A merge vocabulary encodes a text as the one sequence of pieces in which each piece encodes itself and each pair of neighbours
is *compatible*: the merges inside the two pieces, run side by side, never prefer a merge across their border. A prefix of
such a sequence is the encoding of that prefix of the text, so every prefix has exactly one last piece. ``PieceModel.table``
walks the text once: an automaton reports the pieces that end at a place, and the one that is compatible with the last piece of
the prefix before it is stored. ``recover`` then reads the ids from the end backwards. The work is linear in the text, however
long a run without a space is.

``encode`` adds the ids of each row (little-endian unsigned 32-bit), ``decode`` the text of such ids. Both map rows where they
are read; nothing is shuffled, and a lost task is repeated on its own. No merge crosses the border before white space or beside
a character of no longer piece (a line end), so texts are cut there and the ids of short cuts remembered, in a bounded number
of bytes per worker.

Null and empty texts have the begin and end ids alone, and decode to the empty text; a null row of ids decodes to null. Ids and
all other columns are passed through, repeated rows too; only the columns named ``ids`` and ``decoded`` are replaced. An empty
table stays empty. Models that rewrite texts, lack byte pieces or have other than merge pieces are refused.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_columns_checked

SPACE = "▁"
#: Longer cuts are encoded anew each time.
REMEMBERED_CHARS = 48
REMEMBERED_PAIRS = 200_000
PACKED = [struct.Struct(f"<{n}I") for n in range(64)]
PROBE = " ﬁ  Á　\t\n\x00①  "


class PieceModel:
    """Vocabulary, automaton and prefix tables of one model file."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError(f"{path}: the model rewrites texts; only plain texts with a leading space mark are supported")
        n = sp.get_piece_size()
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError(f"{path}: the model has no byte pieces")
        self.byte_id = {v: i for i, v in self.byte.items()}
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: the model has unused pieces")
        special = self.control | self.byte.keys() | {self.unknown}
        plain = [i for i in range(n) if i not in special]
        self.rank = {self.piece[i]: -sp.get_score(i) for i in plain}
        self.length = [len(p) for p in self.piece]
        inner = {c for i in plain if self.length[i] > 1 for c in self.piece[i]}
        if not inner <= self.rank.keys():
            raise ValueError(f"{path}: characters of a piece are no pieces themselves")
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.piece[i], (i, self.length[i] - 1))
        self.automaton.make_automaton()
        self.surface = [p.replace(SPACE, " ") for p in self.piece]
        flags = np.zeros(n, bool)
        flags[list(special)] = True
        self.special = flags
        # places where no merge can happen: before a space mark, and around a character of no longer piece
        if any(SPACE in self.piece[i].lstrip(SPACE) for i in plain):
            self.cuts = re.compile(r"(?s).+").findall
        else:
            joined = "".join(map(re.escape, sorted(inner - {SPACE})))
            self.cuts = re.compile(f"(?s){SPACE}*[{joined}]+|{SPACE}+|.").findall
        self.cache_bytes = cache_bytes
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.runs: dict[int, list | None] = {}
        self.pairs: dict[int, bool] = {}

    def run(self, piece: int) -> list[tuple[float, str, str]] | None:
        """The merges that build a piece from its characters: (rank, first part, last part) after each; None if they do not."""
        if piece not in self.runs:
            parts, out = list(self.piece[piece]), []
            while len(parts) > 1:
                rank, at = min((self.rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == math.inf:
                    out = None
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                out.append((rank, parts[0], parts[-1]))
            self.runs[piece] = out
        return self.runs[piece]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side stay as they are: no step of their merges prefers one across the border.

        The answer is remembered; left == unknown asks whether the right piece encodes itself.
        """
        if left == self.unknown:
            ok = self.run(right) is not None
        else:
            ok = self._stay(left, right)
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = ok
        return ok

    def _stay(self, left: int, right: int) -> bool:
        a, b = self.run(left), self.run(right)
        if b is None:
            return False
        never, rank = math.inf, self.rank.get
        last, first = self.piece[left][-1], self.piece[right][0]
        i = j = 0
        next_a, next_b = a[0][0] if a else never, b[0][0] if b else never
        across = rank(last + first, never)
        while True:
            if across < next_a and across <= next_b:  # of equal ranks the leftmost merge is made first
                return False
            if next_a <= next_b:
                if next_a == never:
                    return True
                edge, i = a[i][2], i + 1
                next_a = a[i][0] if i < len(a) else never
                if edge is not last:
                    last, across = edge, rank(edge + first, never)
            else:
                edge, j = b[j][1], j + 1
                next_b = b[j][0] if j < len(b) else never
                if edge is not first:
                    first, across = edge, rank(last + edge, never)

    def table(self, text: str) -> list[int]:
        """For each prefix of the text the id of its last piece; the unknown id where its last character is no piece."""
        last = [self.unknown] * (len(text) + 1)
        known, done = self.pairs.get, -1
        for end, (piece, before) in self.automaton.iter(text):
            if end != done:
                before = last[end - before]
                ok = known(before << 32 | piece)
                if ok or ok is None and self.fits(before, piece):
                    last[end + 1] = piece
                    done = end
        return last

    def recover(self, text: str, last: list[int]) -> list[int]:
        """The ids of the text, from the end of its table backwards; characters without a piece become their bytes."""
        out, at = [], len(text)
        while at:
            piece = last[at]
            if piece == self.unknown:
                out.extend(self.byte_id[v] for v in reversed(text[at - 1].encode("utf-8")))
                at -= 1
            else:
                out.append(piece)
                at -= self.length[piece]
        out.reverse()
        return out

    def _learn(self, cut: str) -> bytes:
        """The ids of a cut, remembered if it is short; the older half of what is remembered goes when there is too much."""
        ids = self.older.get(cut)
        if ids is None:
            found = self.recover(cut, self.table(cut))
            ids = (PACKED[len(found)] if len(found) < len(PACKED) else struct.Struct(f"<{len(found)}I")).pack(*found)
        if len(cut) <= REMEMBERED_CHARS:
            self.held += len(ids) + 4 * len(cut) + 200
            if 2 * self.held > self.cache_bytes:
                self.older, self.cache, self.held = self.cache, {}, 0
            self.cache[cut] = ids
        return ids

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        cuts = self.cuts(SPACE + text.replace(" ", SPACE)) if text else []
        known = self.cache.get
        body = b"".join([known(c) or self._learn(c) for c in cuts])
        mark = lambda use, i: struct.pack("<I", i) if use else b""
        return mark(begin, self.bos) + body + mark(end, self.eos)

    def decode(self, data: bytes) -> str:
        """The text of ids: control ids say nothing, byte ids make characters, one leading space mark goes."""
        ids = np.frombuffer(data, "<u4")
        odd = np.flatnonzero(self.special[ids])
        out, at, surface = [], 0, self.surface
        empty = True  # until the first id that says something
        pending = bytearray()
        for stop in [*odd.tolist(), len(ids)]:
            if stop > at:
                if pending:
                    out.append(characters(pending))
                    pending, empty = bytearray(), False
                part = "".join(map(surface.__getitem__, ids[at:stop].tolist()))
                out.append(part[1:] if empty and part[0] == " " else part)
                empty = False
            if stop < len(ids):
                i = int(ids[stop])
                if i in self.byte:
                    pending.append(self.byte[i])
                else:
                    if pending:
                        out.append(characters(pending))
                        pending, empty = bytearray(), False
                    if i not in self.control:
                        out.append(" ⁇ ")
                        empty = False
            at = stop + 1
        if pending:
            out.append(characters(pending))
        return "".join(out)


def characters(data: bytearray) -> str:
    """The bytes as UTF-8; every byte that belongs to no whole character is U+FFFD."""
    out, rest = [], bytes(data)
    while rest:
        try:
            return "".join(out) + rest.decode("utf-8")
        except UnicodeDecodeError as bad:
            out.append(rest[:bad.start].decode("utf-8") + "�")
            rest = rest[bad.start + 1:]
    return "".join(out)


@functools.lru_cache(1)
def shared_model(path: str) -> PieceModel:
    """One per worker process; what it remembers of texts is bounded in bytes."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(df: DataFrame, source: str, out: str, kind: str, work, keep: list[str] | None, model_path: str,
            slice_bytes: int) -> DataFrame:
    """The columns ``keep`` (all) and ``out``, made from ``source`` by ``work(model, value)`` where the rows are."""
    given = free_name(df, "given")
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(given))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` {kind}"])
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model(model_path)
        for batch in batches:
            values, at, held = [], 0, 0
            column = batch.column(len(kept))
            for i in range(batch.num_rows):
                values.append(work(model, column[i].as_py()))
                held += len(values[-1] or "")
                if held >= slice_bytes or i == batch.num_rows - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values, arrow)], names=[*kept, out])
                    values, at, held = [], i + 1, 0

    return wide.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", out: str = "ids",
           keep: list[str] | None = None, slice_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (its columns ``keep``) with the ids of each whole text, begin and end ids included, in the binary column ``out``."""
    with_columns_checked(docs, text_col)
    return _mapped(docs, text_col, out, "binary", lambda m, text: m.encode(text or ""), keep, model_path or default_path(), slice_bytes)


def decode(encoded: DataFrame, model_path: str | None = None, ids_col: str = "ids", out: str = "decoded",
           keep: list[str] | None = None, slice_bytes: int = 32 << 20) -> DataFrame:
    """``encoded`` (its columns ``keep``) with the text of each row's ids in the column ``out``."""
    with_columns_checked(encoded, ids_col)
    return _mapped(encoded, ids_col, out, "string", lambda m, ids: None if ids is None else m.decode(ids), keep,
                   model_path or default_path(), slice_bytes)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded rows."""
    return decoded.select(
        F.col(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
