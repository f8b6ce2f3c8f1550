"""Language-model scores: a gated recurrent network with a class-factored softmax, and unigram counts of the whole corpus.

* **Counts.** Every token of every document is counted, in one shuffle: a task packs the postings of its documents by word
  bucket; a bucket sums each word over the training documents and sends back, per document, the sum of its words'
  log counts. No word list of the corpus is ever gathered; the driver sees totals and the ``head`` most frequent words.
* **Classes.** Head words stand in classes of equal size by frequency; any other word falls into one of ``tails`` classes by its
  last letters. p(word | history) = p(class | state) * p(word | class, state): a softmax over the words of a head class,
  the smoothed unigram distribution of a tail class. Each class sums to one, so the model does.
* **Network.** A gated recurrent unit reads the token before. It is fitted by truncated backpropagation in numpy on every token of
  every training document, in windows of ``steps`` tokens; the state carries over from window to window without gradient.
  Rounds average the weights of all tasks, weighted by tokens, on the executors.
* **Scores.** A document is read whole, the state carried on from its first token to its end.

Training documents are those whose crc32 of the id (as text) modulo 10 is not 0. A-Z are lower-cased; tokens are words
``[^\\x20\\x09-\\x0D]+`` and one end. Null texts are empty (one token); a null id counts as the text ``null``. Repeated rows are
rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, utf8, with_columns_checked
from .jaccard_join import batch_of, by_bucket

SMOOTH = 0.1
END = b"\n"  # no word holds white space


def in_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("null" if i is None else str(i)).encode()) % 10 != 0 for i in ids], bool)


def tail_class(words: list[bytes], tails: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-2:]) % tails for w in words), np.int64, len(words))


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


# --- counts ---------------------------------------------------------------------------------------------------------------

PACKED = "bucket int, first long, n int, words binary, lengths binary, counts binary, docs binary, tfs binary, trained binary"
LEAST_BUCKETS = 64


def postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed postings: per batch and bucket its words, how often each stands in which row, and which rows train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            # chunks of rows with consecutive numbers: the first number and the length name them all
            breaks = [*(np.flatnonzero(np.diff(rows) != 1) + 1).tolist(), len(rows)] if len(rows) else []
            starts = [i for a, b in zip([0, *breaks], breaks) for i in range(a, b, 2048)]
            for i, stop in zip(starts, [*starts[1:], len(rows)]):
                part = batch.slice(i, stop - i)
                trained = in_training(part.column(1).to_pylist())
                number: dict[bytes, int] = {}
                keys = []
                for d, t in enumerate(utf8(part.column(2))):
                    w = tokens_of(t)
                    keys.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)) * 2048 + d)
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                word, doc = key >> 11, (key & 2047).astype(np.uint16)
                words = list(number)
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                first = np.searchsorted(word, np.arange(len(words) + 1))
                cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
                out = []
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    mine = order[a:b]
                    n = first[mine + 1] - first[mine]
                    at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    ws = [words[x] for x in mine]
                    out.append((int(bucket[mine[0]]), int(rows[i]), stop - i, b"".join(ws), np.array([len(w) for w in ws], np.uint32).tobytes(),
                                n.astype(np.uint32).tobytes(), doc[at].tobytes(), tf[at].astype(np.uint32).tobytes(),
                                np.packbits(trained).tobytes()))
                yield batch_of(out, [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6], [c.split()[0] for c in PACKED.split(", ")])

    return docs.mapInArrow(run, PACKED)


COUNTED = "kind string, row long, a double, n long, word binary, class long, docs binary, sums binary, known binary"


def counted(packed: DataFrame, buckets: int, head: int, tails: int) -> DataFrame:
    """Per chunk and bucket (kind ``doc``): packed sums of log10(c + 0.1) and known tokens; per bucket: totals and frequent words.

    ``total``: tokens and distinct words in training (a, n), per tail class (``class``); ``head``: the bucket's words with
    their counts (n), the ``head`` most frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 3]
        names = [c.split()[0] for c in COUNTED.split(", ")]
        for _, rows in by_bucket(batches):
            number: dict[bytes, int] = {}
            blocks = []
            for at, size, words, lengths, counts, docs, tfs, trained in rows:
                ends = np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
                own, a = [], 0
                for b in ends:
                    own.append(number.setdefault(words[a:b], len(number)))
                    a = b
                word = np.repeat(np.array(own, np.int64), np.frombuffer(counts, np.uint32))
                blocks.append((word, np.frombuffer(docs, np.uint16), np.frombuffer(tfs, np.uint32).astype(np.int64),
                               at, size, np.unpackbits(np.frombuffer(trained, np.uint8), count=size).astype(bool)))
            c = np.zeros(len(number), np.int64)
            for word, doc, tf, _, _, trained in blocks:
                use = trained[doc]
                c += np.bincount(word[use], tf[use], len(c)).astype(np.int64)
            value = np.log10(c + SMOOTH)
            out = []
            for word, doc, tf, at, size, _ in blocks:
                some = np.flatnonzero(np.bincount(doc, minlength=size))
                sums = np.bincount(doc, tf * value[word], size)[some]
                known = np.bincount(doc, tf * (c[word] > 0), size)[some].astype(np.int64)
                out.append(("doc", at, None, size, None, None, some.astype(np.uint16).tobytes(), sums.tobytes(), known.tobytes()))
            words = list(number)
            seen = np.flatnonzero(c > 0)
            cls = tail_class([words[i] for i in seen], tails)
            tot, dis = np.bincount(cls, c[seen], tails), np.bincount(cls, minlength=tails)
            out += [("total", None, float(tot[i]), int(dis[i]), None, i, None, None, None) for i in range(tails) if dis[i]]
            top = seen[np.argsort(-c[seen], kind="stable")[:head]]
            out += [("head", None, None, int(c[i]), words[i], None, None, None, None) for i in top]
            yield batch_of(out, kinds, names)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, COUNTED)


def per_document(found: DataFrame) -> DataFrame:
    """(row, logs, known): the packed sums of all buckets, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, rows in by_bucket(batches):
            size = rows[0][0]
            logs, known = np.zeros(size), np.zeros(size, np.int64)
            for _, docs, sums, n in rows:
                at = np.frombuffer(docs, np.uint16)
                logs[at] += np.frombuffer(sums, np.float64)
                known[at] += np.frombuffer(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + size)), pa.array(logs), pa.array(known)], names=["row", "logs", "known"])

    return (found.where("kind = 'doc'").select("row", "n", "docs", "sums", "known").repartition("row").sortWithinPartitions("row", "docs", "sums")
            .mapInArrow(run, "row long, logs double, known long"))


# --- network --------------------------------------------------------------------------------------------------------------

class Vocabulary:
    """Head words in classes of ``per_class`` by frequency, then the tail classes."""

    def __init__(self, head: list[tuple[bytes, int]], tails: int, per_class: int = 32):
        self.words = {w: i for i, (w, _) in enumerate(head)}
        self.logs = np.log10(np.array([c for _, c in head], np.float64) + SMOOTH)
        self.heads, self.tails, self.per_class = len(head), tails, per_class
        self.head_classes = -(-len(head) // per_class)
        self.classes = self.head_classes + tails
        self.sizes = [min(per_class, len(head) - i * per_class) for i in range(self.head_classes)]

    def encode(self, tokens: list[bytes], cache: dict) -> np.ndarray:
        """Head words 0 to heads-1, then tail classes."""
        return np.fromiter(map(cache.__getitem__, tokens), np.int32, len(tokens))


class Codes(dict):
    """Token to input symbol, remembered up to a number of words."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.words)
        self.v = vocabulary

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self.update(self.v.words)
        self[w] = code = self.v.heads + zlib.crc32(w[-2:]) % self.v.tails
        return code


def fresh(v: Vocabulary, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    return {"E": 0.5 * n(v.heads + v.tails + 1, 3 * hidden), "U": n(hidden, 3 * hidden), "b": z(3 * hidden),
            "C": 0.1 * n(hidden, v.classes), "cb": z(v.classes), "W": 0.1 * n(v.head_classes, hidden, v.per_class), "wb": z(v.head_classes, v.per_class)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One unit step for symbols ``x`` and states ``h``: (new state, update gate, reset gate, candidate, h @ Un)."""
    k = h.shape[1]
    g = p["E"][x] + p["b"]
    u = h @ p["U"]
    zr = sigmoid(g[:, :2 * k] + u[:, :2 * k])
    z, r = zr[:, :k], zr[:, k:]
    un = u[:, 2 * k:]
    c = np.tanh(g[:, 2 * k:] + r * un)
    return c + z * (h - c), z, r, c, un


class Weights(dict):
    """Arrays that lie in one flat array, so that an update is one pass over all of them."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.flat = np.concatenate([a.ravel() for a in arrays.values()])
        ends = np.cumsum([a.size for a in arrays.values()]).tolist()
        super().__init__((n, self.flat[end - a.size:end].reshape(a.shape)) for end, (n, a) in zip(ends, arrays.items()))


class Space(dict):
    """Arrays that windows write into again, so that none asks the system for new memory."""

    def room(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        n = math.prod(shape)
        a = self.get(name)
        if a is None or a.size < n or a.dtype != kind:
            a = self[name] = np.empty(n, kind)
        return a[:n].reshape(shape)

    def cells(self, symbols: int, k: int) -> np.ndarray:
        """Places in the flat input weights: a row of units for each symbol and gate."""
        a = self.get("cells")
        if a is None or a.shape != (3 * symbols, k):
            a = self["cells"] = np.arange(3 * symbols * k).reshape(-1, k)
        return a


def by_gate(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Inputs, a row for each symbol and gate, and recurrent weights (gate, unit, unit); both gates' negated for ``advance``."""
    k = len(p["U"])
    e = p["E"] + p["b"]
    np.negative(e[:, :2 * k], out=e[:, :2 * k])
    u = p["U"].reshape(k, 3, k).transpose(1, 0, 2).copy()
    np.negative(u[:2], out=u[:2])
    return e.reshape(-1, k), u


def advance(g: np.ndarray, u: np.ndarray, h: np.ndarray, hu: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """``step`` without new arrays: inputs ``g`` (gate, row, unit) become the gates and the candidate, ``hu`` h @ U, ``out`` the state."""
    np.matmul(h, u, out=hu)
    zr, c = g[:2], g[2]
    zr += hu[:2]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[1], hu[2], out=spare)
    c += spare
    np.tanh(c, out=c)
    np.subtract(h, c, out=spare)
    spare *= zr[0]
    np.add(c, spare, out=out)


def softmax(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray | None:
    """Columns of ``x`` become probabilities, in place; the log probabilities of targets, if they stand at ``at`` of the flat ``x``."""
    x -= x.max(0)
    lp = None if at is None else x.ravel()[at]
    np.exp(x, out=x)
    total = x.sum(0)
    x /= total
    return None if lp is None else lp - np.log(total)


def output(p: dict, v: Vocabulary, h: np.ndarray, y: np.ndarray, space: Space | None = None, logs: bool = True) -> tuple[np.ndarray | None, ...]:
    """Natural log probabilities (``logs``) of targets ``y`` (-1: none, 0) without the tail words' share, and what the gradient needs.

    That is: the targets' order (so by class, tails last), the states in it with a column of ones, where head classes begin, the
    distributions over classes and over the words of the own class (a column each), the places of the targets in both, and the
    weights of the words (class, word, unit and bias). Words that a class does not have get no probability.
    """
    space = Space() if space is None else space
    k, kind = h.shape[1], h.dtype
    order = np.argsort(y.astype(code_type(v)), kind="stable")[:np.count_nonzero(y >= 0)]
    if len(order) and y[order[0]] < 0:
        order = np.argsort(y, kind="stable")[-len(order):]
    y = y[order]
    cls = np.where(y < v.heads, y // v.per_class, y + (v.head_classes - v.heads))
    cuts = np.searchsorted(cls, np.arange(v.head_classes + 1)).tolist()
    own = space.room("own", (len(y), k + 1), kind)
    own[:, :k] = h[order]
    own[:, k] = 1
    c1 = np.concatenate([p["C"], p["cb"][None]])
    lc = np.matmul(c1.T, own.T, out=space.room("lc", (v.classes, len(y)), kind))
    n = cuts[-1]
    w1 = space.room("w1", (v.head_classes, v.per_class, k + 1), kind)
    w1[:, :, :k] = p["W"].transpose(0, 2, 1)
    w1[:, :, k] = p["wb"]
    w1[-1, v.sizes[-1]:, k] = -np.inf
    lw = space.room("lw", (v.per_class, n), kind)
    for c, (a, b) in enumerate(itertools.pairwise(cuts)):
        if a < b:
            np.matmul(w1[c], own[a:b].T, out=lw[:, a:b])
    place = np.arange(len(y))
    at_c = cls * len(y) + place
    at_w = (y[:n] % v.per_class) * n + place[:n]
    lp = softmax(lc, at_c if logs else None)
    inside = softmax(lw, at_w if logs else None) if n else None
    out = None
    if logs:
        if n:
            lp[:n] += inside
        out = np.zeros(len(h), kind)
        out[order] = lp
    return out, order, own, cuts, lc, lw, at_c, at_w, w1


def adagrad(a: np.ndarray, grad: np.ndarray, memory: np.ndarray, rate: float, space: Space) -> None:
    """Moves the weights ``a`` against ``grad``, which is used up."""
    square = space.room("square", grad.shape, grad.dtype)
    np.maximum(grad, -1, out=grad)
    np.minimum(grad, 1, out=grad)
    memory += np.multiply(grad, grad, out=square)
    np.sqrt(memory, out=square)
    square += 1e-6
    grad *= rate
    grad /= square
    a -= grad


def train_windows(p: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray, rate: float, memory: dict,
                  space: Space | None = None) -> np.ndarray:
    """One truncated-backpropagation step over windows (rows, steps) from states ``h``; weights change in place (Adagrad).

    Arrays hold gate, step, row, unit, so that what a step touches lies together; all that need not wait for the states is done
    for the window at once.
    """
    space = Space() if space is None else space
    rows, steps = x.shape
    k, kind = h.shape[1], p["E"].dtype
    e, u = by_gate(p)
    place = x.T[:, None] * 3 + np.arange(3)[:, None]
    g = np.take(e, place, axis=0, out=space.room("g", (steps, 3, rows, k), kind), mode="clip")
    hu = space.room("hu", (steps, 3, rows, k), kind)
    states = space.room("states", (steps + 1, rows, k), kind)
    spare = space.room("spare", (rows, k), kind)
    states[0] = h
    for t in range(steps):
        advance(g[t], u, states[t], hu[t], states[t + 1], spare)
    _, order, own, cuts, d, dw, at_c, at_w, w1 = output(p, v, states[1:].reshape(-1, k), y.T.ravel(), space, logs=False)
    n = max(1, len(order))
    grads = {}
    d.ravel()[at_c] -= 1
    d /= n
    both = d @ own
    grads["C"], grads["cb"] = both[:, :k].T, both[:, k]
    dv = d.T @ p["C"].T.copy()
    dw.ravel()[at_w] -= 1
    dw /= n
    both = np.zeros(w1.shape, kind)
    inside = space.room("inside", (cuts[-1], k), kind)
    for c, (a, b) in enumerate(itertools.pairwise(cuts)):
        if a < b:
            np.matmul(dw[:, a:b], own[a:b], out=both[c])
            np.matmul(dw[:, a:b].T, w1[c, :, :k], out=inside[a:b])
    grads["W"], grads["wb"] = both[:, :, :k].transpose(0, 2, 1), both[:, :, k]
    dv[:cuts[-1]] += inside
    dh_out = space.room("dh_out", (steps * rows, k), kind)
    dh_out.fill(0)
    dh_out[order] = dv
    dh_out = dh_out.reshape(steps, rows, k)
    z, r, c, prev = g[:, 0], g[:, 1], g[:, 2], states[:-1]
    to_cz = space.room("to_cz", (2, steps, rows, k), kind)
    to_c, to_z = to_cz
    np.subtract(1, z, out=to_c)
    np.subtract(prev, c, out=to_z)
    to_z *= z
    to_z *= to_c
    np.multiply(c, c, out=c)
    np.subtract(1, c, out=c)
    to_c *= c
    to_r = hu[:, 2]
    to_r *= r
    np.subtract(1, r, out=c)
    to_r *= c
    ds = space.room("ds", (4, steps, rows, k), kind)  # of both gates, of the candidate, of h @ Un
    back = p["U"].reshape(k, 3, k).transpose(1, 2, 0)[[0, 1, 2]].copy()
    three = space.room("three", (3, rows, k), kind)
    dh = np.zeros((rows, k), kind)
    for t in range(steps - 1, -1, -1):
        one = ds[:, t]
        dh += dh_out[t]
        np.multiply(dh, to_cz[:, t], out=one[:2])
        np.multiply(one[0], to_r[t], out=one[2])
        np.multiply(one[0], r[t], out=one[3])
        dh *= z[t]
        np.matmul(one[1:], back, out=three)
        dh += three[0]
        dh += three[1]
        dh += three[2]
    ds = ds.reshape(4, -1, k)
    grads["U"] = (prev.reshape(-1, k).T @ ds[1:]).transpose(1, 0, 2).reshape(k, 3 * k)
    # ds has the candidate first, the weights have it last
    cells = np.take(space.cells(len(p["E"]), k), place.transpose(1, 0, 2)[[2, 0, 1]], axis=0, out=space.room("at", (3, steps, rows, k), np.int64), mode="clip")
    grads["E"] = np.zeros_like(p["E"])
    np.add.at(grads["E"].ravel(), cells.ravel(), ds[:3].ravel())
    grads["b"] = grads["E"].sum(0)
    if isinstance(p, Weights):
        adagrad(p.flat, np.concatenate([grads[name].ravel() for name in p]), memory.flat, rate, space)
    else:
        for name in p:
            adagrad(p[name], grads[name].copy(), memory[name], rate, space)
    return states[-1].copy()


def all_codes(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, trained, codes): all symbols of each document, packed as ``code_type``."""
    kind = code_type(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(v)
        for batch in batches:
            out = [v.encode(tokens_of(t), codes).astype(kind).tobytes() for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(in_training(batch.column(1).to_pylist())), pa.array(out, pa.binary())],
                                             names=["row", "trained", "codes"])

    return docs.mapInArrow(run, "row long, trained boolean, codes binary")


def code_type(v: Vocabulary) -> type:
    return np.uint16 if v.heads + v.tails < 1 << 16 else np.int32


def training_steps(docs: Iterable[np.ndarray], rows: int, steps: int, start: int, ahead: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """(keep, x, y) per training step: the next ``steps`` symbols of up to ``rows`` documents; -1 is no target.

    A document takes part from its first symbol to its last, window after window; where it has ended, the next one takes its
    place. ``keep`` names the rows of the step before that go on, in order; new documents follow them. Documents are cut into
    windows together, some ``ahead`` symbols at a time.
    """
    docs = iter(docs)
    xs = ys = np.zeros((0, steps), np.int32)  # windows read ahead
    at, end = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the rows: the next window, the one after the last
    ready: tuple[np.ndarray, np.ndarray] = (at, end)  # the same of documents that wait
    while True:
        keep = np.flatnonzero(at < end)
        at, end = at[keep], end[keep]
        while len(at) < rows:
            n = rows - len(at)
            at, end = np.append(at, ready[0][:n]), np.append(end, ready[1][:n])
            ready = ready[0][n:], ready[1][n:]
            if len(at) == rows:
                break
            more, held = [], 0
            for d in docs:
                more.append(d)
                held += len(d)
                if held >= ahead:
                    break
            if not more:
                break
            # windows that rows still need, then those of the new documents
            left = end - at
            used = np.repeat(at - (np.cumsum(left) - left), left) + np.arange(left.sum())
            length = np.array([len(d) for d in more])
            parts = -(-length // steps)
            first = np.cumsum(parts) - parts
            flat = np.concatenate(more)
            to = np.repeat(first * steps - (np.cumsum(length) - length), length) + np.arange(len(flat))
            y = np.full(int(parts.sum()) * steps, -1, np.int32)
            y[to] = flat
            x = np.full_like(y, start)
            x[1:] = y[:-1]
            x[first * steps] = start
            x[x < 0] = start
            xs, ys = np.concatenate([xs[used], x.reshape(-1, steps)]), np.concatenate([ys[used], y.reshape(-1, steps)])
            at = np.cumsum(left) - left
            end = at + left
            first += len(used)
            ready = first, first + parts
        if not len(at):
            return
        yield keep, xs[at], ys[at]
        at = at + 1


def fit(texts: DataFrame, v: Vocabulary, hidden: int, steps: int, rounds: int, rate: float, batch_rows: int,
        seed: int) -> dict[str, np.ndarray]:
    """Weights averaged over all tasks, ``rounds`` times over; a task starts each round from the average."""
    p = fresh(v, hidden, seed)
    shapes = {n: a.shape for n, a in p.items()}
    size = sum(a.size for a in p.values())
    chunk = 4096
    kind = code_type(v)

    def one_round(start: dict, rate: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Weights(start)
            memory = Weights({n: np.full(a.shape, 1e-4, np.float32) for n, a in own.items()})
            seen, h, space = 0, np.zeros((0, hidden), np.float32), Space()

            def documents() -> Iterator[np.ndarray]:
                for batch in batches:  # the longest first, so that few steps have few rows
                    for d in sorted(batch.column(0).to_pylist(), key=len, reverse=True):
                        yield np.frombuffer(d, kind)

            for keep, x, y in training_steps(documents(), batch_rows, steps, v.heads + v.tails):
                h = np.concatenate([h[keep], np.zeros((len(x) - len(keep), hidden), np.float32)])
                h = train_windows(own, v, x, y, h, rate, memory, space)
                seen += int((y >= 0).sum())
            if seen:
                flat = own.flat.astype(np.float64) * seen
                rows = [(i // chunk, flat[i:i + chunk].tobytes(), seen) for i in range(0, size, chunk)]
                yield batch_of(rows, [pa.int64(), pa.binary(), pa.int64()], ["part", "weights", "seen"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in by_bucket(batches):
                total = np.sum([np.frombuffer(w, np.float64) for w, _ in rows], 0) / sum(s for _, s in rows)
                yield batch_of([(part, total.astype(np.float32).tobytes())], [pa.int64(), pa.binary()], ["part", "weights"])

        return (texts.mapInArrow(run, "part long, weights binary, seen long").repartition("part").sortWithinPartitions("part", "seen", "weights")
                .mapInArrow(average, "part long, weights binary"))

    for i in range(rounds):
        parts = sorted((r["part"], r["weights"]) for r in one_round(p, rate / (i + 1)).collect())
        if not parts:
            break
        flat, at, nxt = np.frombuffer(b"".join(w for _, w in parts), np.float32), 0, {}
        for n, shape in shapes.items():
            k = int(np.prod(shape))
            nxt[n] = flat[at:at + k].reshape(shape).copy()
            at += k
        p = nxt
    return p


def score_batch(p: dict, v: Vocabulary, docs: list[np.ndarray], hidden: int, space: Space | None = None, states: int = 1 << 12) -> np.ndarray:
    """Natural log probability of whole documents (symbols), without the tail words' share; ``states`` are judged together."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    space = Space() if space is None else space
    kind = p["E"].dtype
    order = np.argsort([-len(d) for d in docs], kind="stable")
    length = np.array([len(docs[i]) for i in order])
    flat = np.concatenate([docs[i] for i in order])
    first = np.cumsum(length) - length
    alive = (len(docs) - np.searchsorted(length[::-1], np.arange(length[0]), "right")).tolist()
    e, u = by_gate(p)
    gates = np.arange(3)[:, None]
    room = states + len(docs)
    hs, ys, who = space.room("hs", (room, hidden), kind), space.room("ys", (room,), np.int64), space.room("who", (room,), np.int64)
    h, x, held = np.zeros((len(docs), hidden), kind), np.full(len(docs), v.heads + v.tails), 0
    names = np.arange(len(docs))
    for t, n in enumerate(alive):
        g = np.take(e, x[:n] * 3 + gates, axis=0, out=space.room("g", (3, n, hidden), kind), mode="clip")
        stop = held + n
        advance(g, u, h[:n], space.room("hu", (3, n, hidden), kind), hs[held:stop], space.room("spare", (n, hidden), kind))
        ys[held:stop] = flat[first[:n] + t]
        who[held:stop] = names[:n]
        h, x, held = hs[held:stop], ys[held:stop], stop
        if held >= states or t + 1 == len(alive):
            lp = output(p, v, hs[:held], ys[:held], space)[0]
            total += np.bincount(who[:held], lp, len(docs))
            h, x, held = h.copy(), x.copy(), 0
    back = np.empty_like(total)
    back[order] = total
    return back


def scores(codes: DataFrame, p: dict, v: Vocabulary, hidden: int, tail_logs: np.ndarray, long: int = 1500, flush: int = 6_000_000) -> DataFrame:
    """(row, tokens, part): part is the log10 probability without the sum of log10(c + 0.1) of tail words."""
    kind = code_type(v)
    # the caller adds log10(c + 0.1) of every token: take those of head words off again
    off = np.concatenate([v.logs, tail_logs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        names, kinds = ["row", "tokens", "part"], [pa.int64(), pa.int64(), pa.float64()]

        def result(rows: list, own: list) -> pa.RecordBatch:
            part = score_batch(p, v, own, hidden, space) / np.log(10)
            for i, d in enumerate(own):
                part[i] -= off[d].sum()
            return batch_of(list(zip(rows, map(len, own), part.tolist())), kinds, names)

        late_rows, late, held = [], [], 0
        for batch in batches:
            rows, own = [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                d = np.frombuffer(t, kind)
                if len(d) > long:  # long documents go together, so that steps have many rows
                    late_rows.append(r)
                    late.append(d)
                    held += len(d)
                else:
                    rows.append(r)
                    own.append(d)
                if held > flush:
                    yield result(late_rows, late)
                    late_rows, late, held = [], [], 0
            yield result(rows, own)
        yield result(late_rows, late)

    return codes.mapInArrow(run, "row long, tokens long, part double")


def score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", head: int = 512, tails: int = 16, hidden: int = 16,
          steps: int = 16, rounds: int = 2, rate: float = 0.1, batch_rows: int = 96, words_per_bucket: int = 8_000_000,
          seed: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with_columns_checked(docs, id_col, text_col)
    spark = docs.sparkSession
    # Rows are numbered once, in a written table, so that every pass speaks of the same rows.
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, shuffle_partitions(spark), -(-size // (8 * words_per_bucket)))
    found = scratch.write(counted(postings(rows, buckets), buckets, head, tails), "counts")
    sums = {r["class"]: (r["a"], r["n"]) for r in found.where("kind = 'total'").groupBy("class").agg(
        F.sum("a").alias("a"), F.sum("n").alias("n")).collect()}
    top = [(bytes(r["word"]), r["n"]) for r in found.where("kind = 'head'").orderBy(F.desc("n"), "word").limit(head).collect()]
    n_all, v_all = int(sum(a for a, _ in sums.values())), sum(n for _, n in sums.values())
    per_doc = per_document(found)
    if not top:  # nothing to learn from
        top = [(END, 0)]
    v = Vocabulary(top, tails)
    tail_n, tail_v = np.zeros(tails), np.zeros(tails)
    for c, (a, n) in sums.items():
        tail_n[c], tail_v[c] = a, n
    for (w, n), cls in zip(top, tail_class([w for w, _ in top], tails)):
        if n:
            tail_n[cls] -= n
            tail_v[cls] -= 1
    tail_logs = np.log10(tail_n + SMOOTH * (tail_v + 1))
    base = np.log10(n_all + SMOOTH * (v_all + 1))
    codes = scratch.write(all_codes(rows, v), "codes")
    p = fit(codes.where("trained").select("codes"), v, hidden, steps, rounds, rate, batch_rows, seed)
    scored = scratch.write(scores(codes, p, v, hidden, tail_logs), "scores")
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")) % 10
    return scored.join(per_doc, "row").join(rows.select("row", "id"), "row").select(
        F.col("id").alias(id_col), (crc == 0).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") - F.col("tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("part") + F.col("logs")).alias("score"))
