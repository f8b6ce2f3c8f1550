"""Parts that need no Spark: tokenizer, BM25 packing, isolation trees, records, pages, sets."""

import gzip
import io
import json
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest

from logloom.llm import html_main, jaccard_join, packing, quality, recurrent_lm, warc

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", " ", "  a  b", "a\n b", "a \nb", "a   b  ", "\n\n x\n\n", "it's  we'll ", " lead", "trail ", "x\x1c y",
         "<|endoftext|> hi <|endoftext|>", "tab\t x \t y", "a\n\n b  \n c", "\n \n", " 　 z", "naïve café “quotes” 東京", "w " * 3000]


def test_tokenizer_equals_the_library():
    t = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"), cache_bytes=20_000)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice([" ", "\n", "a", "Bc", "1", ".", "\t", "é", "'s"]) for _ in range(60)) for _ in range(200)]
    want = [e.ids for e in t.inner.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in t.encode_batch(texts)] == want
    assert [list(x) for x in t.encode_batch(texts)] == want  # from the cache


def test_merges_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = packing.MergeTokenizer(path, cache_bytes=20_000)
    rng = random.Random(7)
    signs = [" ", " ", "\n", "a", "th", "Bc", "1", ".", "\t", "é", "'s", "'LL", "東", "\x1c", "\u00a0", "\u3000", "ing", "🙂"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += [" " * 120_000 + "a" + "\n " * 20_000 + "b", "x" * 120_000]
    want = [e.ids for e in t.inner.encode_batch(texts, add_special_tokens=False)]
    assert t.cut is not None and [x.tolist() for x in t.encode_batch(texts)] == want
    t.cut = None  # without the merges: by the library
    assert [list(x) for x in t.encode_batch(texts)] == want


def test_merges_of_other_files_are_left_to_the_library(tmp_path):
    t = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    whole = json.loads(t.inner.to_str())
    merges = whole["model"]["merges"]
    other = [whole | {"normalizer": {"type": "Lowercase"}}, whole | {"model": whole["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}}]
    for i, x in enumerate(other):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(x))
        t = packing.MergeTokenizer(str(path))
        texts = ["The tea at THE table", "a b"]
        assert t.cut is None
        assert [list(x) for x in t.encode_batch(texts)] == [e.ids for e in t.inner.encode_batch(texts, add_special_tokens=False)]


def test_new_words_cost_less_than_in_the_library():
    t = packing.shared_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "in", "o", "an", "ti"]) for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(200)]
    spent = []
    for run in (lambda: t.encode_batch(texts), lambda: t.inner.encode_batch_fast(texts, add_special_tokens=False)):
        at = time.process_time()
        run()
        spent.append(time.process_time() - at)
    assert spent[0] < 0.6 * spent[1]


def plain_statistics(docs):
    """idf by term and mean length, counted one by one."""
    df = np.zeros(1000, np.int64)
    for _, d in docs:
        for term in set(d.tolist()):
            df[term] += 1
    return packing.idf(df, len(docs)), sum(len(d) for _, d in docs) / len(docs)


def test_packing_covers_every_id_once():
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint32)) for i in range(60)] + [(99, np.arange(500, dtype=np.uint32))]
    out: list = []
    packer = packing.Packer(64, 7)
    packing.pack_shard(docs, packer, out, *plain_statistics(docs))
    packer.close(out)
    for doc, ids in docs:
        at = 0
        for _, start, n, crc, total, _, _ in sorted(o for o in out if o[0] == doc):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start:start + n].tobytes())
            at += n
        assert at == len(ids)
    sequences: dict = {}
    for o in out:
        sequences.setdefault(o[5], []).append((o[6], o[2]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_bm25_against_the_formula():
    docs = [np.array(d, np.uint32) for d in ([1, 2, 2], [2, 3], [1, 1, 4], [5], [])]
    index = packing.ShardIndex(docs, *plain_statistics(list(enumerate(docs))))
    score = np.array([index.scores(d) for d in docs])
    avg = sum(map(len, docs)) / len(docs)
    for q in range(len(docs)):
        for d in range(len(docs)):
            if q == d:
                continue
            want = 0.0
            for term in set(docs[q].tolist()):
                tf = docs[d].tolist().count(term)
                df = sum(term in x for x in docs)
                if tf:
                    want += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))
            assert score[q, d] == pytest.approx(want, rel=1e-5)


def test_retrieval_puts_similar_documents_together():
    a, b = np.arange(100, 120, dtype=np.uint32), np.arange(500, 520, dtype=np.uint32)
    docs = [(0, a), (1, b), (2, b), (3, a)]
    out: list = []
    packing.pack_shard(docs, packing.Packer(40, 0), out, *plain_statistics(docs))
    assert [o[0] for o in out[:2]] == [0, 3]


def test_order_of_a_shard_against_brute_force():
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint32)) for i in range(40)]
    weights, mean = plain_statistics(docs)

    def score(q, d):
        own = d.tolist()
        return sum(weights[x] * own.count(x) * 2.2 / (own.count(x) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for x in set(q.tolist()))

    out: list = []
    packer = packing.Packer(64, 0)
    packing.pack_shard(docs, packer, out, weights, mean)
    packer.close(out)
    left, fill, seed, want = dict(docs), 0, None, []
    while left:
        if seed is None or fill == 0:
            seed = nxt = min(left)
        else:
            nxt = max(left, key=lambda i: (round(score(docs[seed][1], left[i]), 9), -i))
        want.append(nxt)
        n = len(left.pop(nxt))
        over = fill + n > 64
        fill = (fill + n) % 64
        if over and fill:
            seed = nxt
    assert list(dict.fromkeys(o[0] for o in out)) == want


def test_rarest_terms_of_documents():
    rank = np.array([5, 0, 2, packing.LAST, 1], np.uint32)
    got = packing.rarest(np.array([0, 4, 0, 3, 2, 1, 3], np.uint16), np.array([3, 0, 3, 1]), rank, 2)
    none = packing.LAST
    assert got.tolist() == [[1, 5], [none, none], [0, 2], [none, none]]


def test_rarest_terms_by_force():
    rng = np.random.default_rng(4)
    rank = rng.permutation(3000).astype(np.uint32)
    rank[rng.integers(0, 3000, 200)] = packing.LAST
    # some documents hold frequent terms only, some are short or empty
    docs = [rng.integers(0, 3000, n) if i % 3 else np.argsort(rank)[2000 + rng.integers(0, 900, n)] for i, n in enumerate(rng.integers(0, 300, 90))]
    docs += [np.full(50, 7), np.empty(0, np.int64)]
    got = packing.rarest(np.concatenate(docs).astype(np.uint16), np.array([len(d) for d in docs]), rank)
    for d, g in zip(docs, got):
        want = sorted(set(rank[d].tolist()))[:8]
        assert g.tolist() == want + [packing.LAST] * (8 - len(want))


def repeat_words(words):
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


def test_rule_statistics_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "\n", " "]) for _ in range(rng.randrange(40)))
        words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
        lines = [x for x in text.split("\n")]
        dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
        n, chars, symbols, d, rep, *_ = quality.text_statistics(text.encode())
        assert (n, chars, symbols, d, rep) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat_words(words))


def test_many_distinct_words_do_not_overflow():
    words = [str(i) for i in range(5000)] * 2
    assert quality._repeat_words(np.array([int(w) for w in words])) == len(words)


def test_forest_isolates_the_odd_row():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.01, (500, 4)), [[1, 1, 1, 1]]])
    nodes: list = []
    trees = []
    for _ in range(50):
        nodes = []
        quality._grow(x[np.r_[rng.choice(500, 100), 500]], rng, 0, 7, nodes)
        f, c, a, b, p = zip(*nodes)
        trees.append(tuple(map(np.array, (f, c, a, b, p))))
    s = quality.anomaly({"trees": trees, "norm": quality.average_path(101), "limit": 7}, x)
    assert s.argmax() == 500 and s[500] > s[:500].max() + 0.1
    assert (quality.anomaly({"trees": [], "norm": 1, "limit": 1}, x) == 0).all()


def test_records_round_trip_and_damage():
    import hashlib

    rows = [(1, "http://x/\r\ny", b"", None), (2, None, b"abc" * 1000, None), (None, "u", b"\r\n\r\nz", None), (3, "u", b"abc" * 1000, (2,))]
    data = b"".join(warc.record(i, u, p, hashlib.sha1(p).hexdigest(), r) for i, u, p, r in rows)
    got = [warc.parse(m) for m in warc.members(io.BytesIO(data))]
    assert got == [(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if r else "response", r[0] if r else None) for i, u, p, r in rows]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(data[:-9])))
    bad = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(next(warc.members(io.BytesIO(bad))))
    with pytest.raises(ValueError, match="no WARC header"):
        warc.parse(b"nothing")


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class=ad>buy</div><!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>One  <b>two</b>\n three.<p>A &lt; b
<aside>side</aside><form><label>mail</label><input></form><p>Last</p><section id="comments"><p>nice</p></section></article>
<div class="sidebar">x</div><footer>&copy; y</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "Head & line\nOne two three.\nA < b\nLast"
    assert html_main.main_text(None) == html_main.main_text("") == ""
    assert html_main.main_text("<article><p>cut off <b>here") == "cut off here"


def test_blocks_without_an_article():
    long = "The people of the town went to the market and it was as good as they had said it would be for all of them that day. "
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><h2>News of the day</h2><p>{long * 3}</p><p>Short one.</p><p>{long * 2}</p><p>Foo bar baz. <a href=x>more of it here</a></p>"
    assert html_main.main_text(page).split("\n") == ["News of the day", (long * 3).strip(), "Short one.", (long * 2).strip()]


def test_an_article_does_not_replace_the_rules():
    text = "The people of the town went to the market and it was as good as they had said it would be for all of them that day. "
    salad = "camera lens tripod battery charger memory card strap filter case cable adapter mount flash printer paper ink toner "
    links = "<p><a href=x>more links stand here than anything else on this line</a></p>"
    teasers = f"<article><h2>Teaser</h2><p>Short one.</p></article><div><p>{text * 3}</p><p>{text * 2}</p></div>"
    assert html_main.main_text(teasers).split("\n") == ["Teaser", "Short one.", (text * 3).strip(), (text * 2).strip()]
    page = lambda words: f"{links}<article><p>{words * 2}</p></article>{links}"
    assert html_main.main_text(page(text)) == (text * 2).strip() and html_main.main_text(page(salad)) == ""
    assert html_main.main_text(f"<article><p>{text * 2}</p></article>{links}<p>{text}</p>{links}") == (text * 2).strip()


def test_unclosed_parts_and_stray_quotes():
    assert html_main.main_text("<div><nav><ul><li>Menu</div><div><article><p>It is the text.</p></article></div>") == "It is the text."
    assert html_main.main_text("<nav><ul><li><a href=x>Menu</a></ul><article><h1>Head</h1><p>Body") == "Head\nBody"
    assert html_main.main_text("<article><p title=it's>One &amp; two <b class='x'>three</b></p></article>") == "One & two three"
    assert html_main.main_text("<article><p>a < b and </3 c<span></p><p>More <a href='cut off") == "a < b and </3 c\nMore"
    assert html_main.main_text("<article><svg><p>One of the words</p><p>Another</article>") == "One of the words\nAnother"
    assert html_main.main_text("<table><tr><td><div>out</td></div><td><article><p>It is in</article></table>") == "It is in"
    japanese = "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u9577\u3044\u6587\u7ae0\u3067\u3059\u3002" * 12
    assert html_main.main_text(f"<div><a href=x>\u30db\u30fc\u30e0</a></div><p>{japanese}</p>") == japanese


def test_tags_are_read_in_linear_time():
    for piece in ("<a b='", "<a b='>'", "<svg>", "<a ", "<", "<div>", "</x>", "<span><nav>", "<b></p>"):
        took = []
        for n in (10_000, 80_000):
            start = time.process_time()
            html_main.main_text(piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 40 * took[0] + 0.5, piece


def plain_labels(blocks):
    """The two passes restated block by block: each looks outwards for its nearest decided neighbours."""
    def first(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stops = sum(w in html_main.STOP_WORDS for w in words) / max(1, len(words))
        if b.links / len(b.text) > 0.33:
            return "bad"
        if len(b.text) < 70:
            return "bad" if b.links else "near" if b.article and stops >= 0.16 else "open"
        if stops >= 0.08:
            return "good" if stops >= 0.16 and len(b.text) > 200 else "near"
        return "doubt" if b.article else "bad"

    def around(labels, i):
        out = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(blocks) and labels[j] not in ("good", "bad"):
                if blocks[i].article and not blocks[j].article:
                    break
                j += step
            found = 0 <= j < len(blocks) and (blocks[j].article or not blocks[i].article)
            out.append(labels[j] if found and labels[j] in ("good", "bad") else "")
        return out

    labels = [first(b) for b in blocks]
    article = any(b.article for b in blocks)
    new = list(labels)
    for i, b in enumerate(blocks):
        if labels[i] == "near":
            x = around(labels, i)
            good = x in (["good", "good"], ["good", ""], ["", "good"]) if article and not b.article else x != ["bad", "bad"]
            new[i] = "good" if good else "bad"
    labels, done = new, list(new)
    for i, b in enumerate(blocks):
        x = around(labels, i)
        if labels[i] == "doubt":
            done[i] = "good" if "good" in x else "bad"
        elif labels[i] == "open" and x[0] and x[0] == x[1]:
            done[i] = x[0]
        elif labels[i] == "open" and b.heading and x[1]:
            done[i] = x[1]
        elif labels[i] == "open":
            done[i] = "good" if b.article and ("good" in x or x == ["", ""]) else "bad"
    return done


def test_two_passes_equal_a_plain_restatement():
    rng = random.Random(3)
    words = "the of and to market river stone camera walked under bridge is lens".split()
    changed = 0
    for _ in range(1500):
        blocks = []
        for _ in range(rng.randrange(12)):
            pool = words if rng.random() < 0.6 else words[4:]
            text = " ".join(rng.choice(pool) for _ in range(rng.choice([2, 6, 14, 25, 60])))
            blocks.append(html_main.Block(text, rng.choice([0, 0, 0, len(text) // 4, len(text)]), rng.random() < 0.6, rng.random() < 0.2))
        want = plain_labels(blocks)
        assert [b.label for b in html_main.classify(blocks)] == want
        changed += len(set(want)) > 1
    assert changed > 300


def test_stop_words_decide(monkeypatch):
    text = "The people of the town went to the market and it was as good as they had said it would be for all of them that day. "
    page = f"<article><h1>Head of the day</h1><p>{text * 2}</p><p>Short one.</p><p>{text}</p></article>"
    assert html_main.main_text(page).count("\n") == 3
    monkeypatch.setattr(html_main, "STOP_WORDS", frozenset())
    assert "people" not in html_main.main_text(page)


def test_signatures_find_every_link():
    """Whatever the edit, linked sets share a signature or a one-deletion signature, and pass the counting filter."""
    rng = np.random.default_rng(5)
    for trial in range(400):
        n = int(rng.integers(4, 200))
        base = np.unique(jaccard_join.mix64(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        n = len(base)
        cut = int(rng.integers(0, n // 5 + 1))
        other = np.delete(base, rng.choice(n, cut, replace=False))
        while True:
            more = np.unique(np.r_[other, jaccard_join.mix64(rng.integers(0, 1 << 62, 1).astype(np.uint64))])
            both = len(np.intersect1d(base, more))
            if 100 * both < 80 * (n + len(more) - both) or rng.random() < 0.05:
                break
            other = more
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (n + len(other) - both) or len(other) < 4 or len(base) == len(other) == both:
            continue
        sets = [base, other]
        size, band, _, value, _, parts = jaccard_join.signatures(sets)
        key, who, _ = jaccard_join.deletions(sets, size, band, value, parts)
        keys = [set(), set()]
        for p in parts:
            for k, w in zip(p[0].tolist(), p[1].tolist()):
                keys[w].add(k)
        passes = [False, False]
        for below, p in enumerate(parts):
            for w in (0, 1):
                mine = {k for k, x in zip(p[0].tolist(), p[1].tolist()) if x == w}
                other_ = keys[1 - w]
                h = int(jaccard_join.most_apart(size, bool(below))[w])
                passes[w] |= p[4][w] > 0 and len(mine & other_) >= p[3][w] - h
        for k, w in zip(key.tolist(), who.tolist()):
            keys[w].add(k)
        assert keys[0] & keys[1] and all(passes), (trial, n, len(other), both)


def test_linked_against_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)] + [np.arange(20, dtype=np.uint64)] * 2
    low = jaccard_join.linked(sets)
    want = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    want[i] = want[j] = min(want[i], want[j])
    assert low.tolist() == want


def test_network_gradient_and_normalisation():
    v = recurrent_lm.Vocabulary([(b"w%d" % i, 100 - i) for i in range(6)], tails=3, per_class=4)
    p = {n: a.astype(np.float64) for n, a in recurrent_lm.fresh(v, 5, 1).items()}
    h = np.random.default_rng(1).standard_normal((1, 5))
    total = sum(np.exp(recurrent_lm.output(p, v, h, np.array([y]))[0][0]) for y in range(v.heads + v.tails))
    assert total == pytest.approx(1)
    x, y = np.array([[9, 0, 7]]), np.array([[0, 7, 4]])

    def loss(q):
        s, out = np.zeros((1, 5)), 0.0
        for t in range(3):
            s = recurrent_lm.step(q, x[:, t], s)[0]
            out -= recurrent_lm.output(q, v, s, y[:, t])[0].sum() / 3
        return out

    for name in p:
        flat = int(np.abs(p[name]).argmax()) if p[name].any() else 0
        up, down = ({n: a.copy() for n, a in p.items()} for _ in range(2))
        up[name].flat[flat] += 1e-5
        down[name].flat[flat] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        q = {n: a.copy() for n, a in p.items()}
        memory = {n: np.zeros(a.shape) for n, a in p.items()}
        recurrent_lm.train_windows(q, v, x, y, np.zeros((1, 5)), 0.0, memory)
        assert np.sqrt(memory[name].flat[flat]) == pytest.approx(min(1, abs(slope)), rel=1e-3, abs=1e-7)


def test_training_reads_every_token_of_every_document():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 500, 3, 16, 17, 32, 1, 7, 130)]
    read, before = [], []
    for keep, x, y in recurrent_lm.training_steps(docs, 4, 16, 9):
        before = [before[i] for i in keep]
        while len(before) < len(x):
            before.append(len(read))
            read.append([])
        assert len(x) <= 4
        for doc, a, b in zip(before, x, y):
            n = int((b >= 0).sum())
            assert a[0] == (read[doc][-1] if read[doc] else 9) and a[1:n].tolist() == b[:n - 1].tolist() and (b[n:] == -1).all()
            read[doc] += b[:n].tolist()
    assert read == [d.tolist() for d in docs]


def test_training_step_of_many_documents_against_its_slope():
    """Rows that end at different places and a last class that is not full, by differences of the loss."""
    v = recurrent_lm.Vocabulary([(b"w%d" % i, 100 - i) for i in range(6)], tails=3, per_class=4)
    rng = np.random.default_rng(8)
    p = {n: 0.5 * rng.standard_normal(a.shape) for n, a in recurrent_lm.fresh(v, 5, 1).items()}
    p["W"][1, :, 2:] = p["wb"][1, 2:] = 0
    x, y, h = rng.integers(0, 10, (7, 4)), rng.integers(0, 9, (7, 4)), rng.standard_normal((7, 5))
    for row, end in enumerate((4, 4, 1, 3, 4, 2, 4)):
        y[row, end:] = -1

    def loss(q):
        s, out = h, 0.0
        for t in range(4):
            s = recurrent_lm.step(q, x[:, t], s)[0]
            ok = y[:, t] >= 0
            out -= recurrent_lm.output(q, v, s[ok], y[ok, t])[0].sum() / (y >= 0).sum()
        return out

    plain = {n: a.copy() for n, a in p.items()}
    memory = {n: np.zeros(a.shape) for n, a in p.items()}
    state = recurrent_lm.train_windows(plain, v, x, y, h, 0.1, memory)
    packed, packed_memory = recurrent_lm.Weights(p), recurrent_lm.Weights({n: np.zeros(a.shape) for n, a in p.items()})
    space = recurrent_lm.Space()
    for other in (1, 0):  # what another window has left in the arrays does not matter
        packed, packed_memory = recurrent_lm.Weights(p), recurrent_lm.Weights({n: np.zeros(a.shape) for n, a in p.items()})
        again = recurrent_lm.train_windows(packed, v, x[other:], y[other:], h[other:], 0.1, packed_memory, space)
    assert again == pytest.approx(state)
    for name in p:
        assert packed[name] == pytest.approx(plain[name]) and packed_memory[name] == pytest.approx(memory[name])
        for flat in rng.choice(p[name].size, min(12, p[name].size), replace=False):
            up, down = ({n: a.copy() for n, a in p.items()} for _ in range(2))
            up[name].flat[flat] += 1e-5
            down[name].flat[flat] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert np.sqrt(memory[name].flat[flat]) == pytest.approx(min(1, abs(slope)), rel=1e-3, abs=1e-8)
            assert plain[name].flat[flat] - p[name].flat[flat] == pytest.approx(-0.1 * np.sign(slope) if abs(slope) > 1e-7 else 0, rel=0.2, abs=0.11 * (abs(slope) < 1e-4))


def test_calls_of_a_training_step_do_not_grow_with_its_rows():
    docs = [np.arange(n).astype(np.uint16) % 9 for n in range(1, 600)]
    called = []
    for rows in (8, 96):
        count = 0

        def seen(frame, event, arg):
            nonlocal count
            count += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            steps = sum(1 for _ in recurrent_lm.training_steps(docs, rows, 16, 9))
        finally:
            sys.setprofile(None)
        called.append((count - len(docs)) / steps)
    assert called[1] < 2 * called[0] + 20


def test_windows_do_not_depend_on_how_far_is_read_ahead():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (40, 1, 500, 3, 16, 17, 32, 1, 7, 130, 15)]
    want = list(recurrent_lm.training_steps(docs, 4, 16, 9))
    for ahead in (1, 20, 600):
        got = list(recurrent_lm.training_steps(docs, 4, 16, 9, ahead))
        assert len(got) == len(want) and all((a == b).all() for g, w in zip(got, want) for a, b in zip(g, w))
    assert list(recurrent_lm.training_steps([], 4, 16, 9)) == []


def test_state_is_carried_over_whole_documents():
    v = recurrent_lm.Vocabulary([(b"w%d" % i, 100 - i) for i in range(6)], tails=3, per_class=4)
    p = recurrent_lm.fresh(v, 5, 1)
    docs = [np.array([0, 7, 3]), np.array([1]), np.array([8, 8, 2, 5, 0])]
    got = recurrent_lm.score_batch(p, v, docs, 5)
    for d, g in zip(docs, got):
        s, out, x = np.zeros((1, 5), np.float32), 0.0, v.heads + v.tails
        for y in d:
            s = recurrent_lm.step(p, np.array([x]), s)[0]
            out += recurrent_lm.output(p, v, s, np.array([y]))[0][0]
            x = y
        assert g == pytest.approx(out, rel=1e-4)
