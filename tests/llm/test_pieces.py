"""SentencePiece operator against the library: random texts, random ids, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from logloom.llm import pieces, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH, cache_bytes=20_000)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def random_texts(model, n, seed):
    rng = random.Random(seed)
    vocabulary = list(model.rank)
    kinds = (
        lambda: rng.choice(vocabulary),
        lambda: rng.choice("  \nab▁eé☃🎉=-t\t\x00 　"),
        lambda: rng.choice(["  ", " ", "a", "the", "er", "=", "==", "\n", " " * rng.randrange(1, 40), "▁▁"]),
        lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0xD7FF), rng.randrange(0xE000, 0x110000)])),
    )
    for _ in range(n):
        kind = rng.choice(kinds)
        yield "".join(kind() for _ in range(rng.randrange(40)))


def test_texts_equal_the_library(model, library):
    for text in random_texts(model, 4000, 5):
        data = model.encode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids_of(data) == want, text
        assert model.decode(data) == library.decode(want), text


def test_every_pair_of_common_pieces(model, library):
    words = [p for p in model.piece[261:1200]]
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.sample(words, 2)).replace("▁", " ")
        assert ids_of(model.encode(text, False, False)) == library.encode(text), text


def test_any_ids_decode_like_the_library(model, library):
    rng = random.Random(3)
    for _ in range(8000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), rng.randrange(195, 259), 28705, 259, 0, 1, 2])
               for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_prefix_table_holds_the_last_piece_of_every_prefix(model, library):
    text = "▁the▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁lower===========er"
    last = model.table(text)
    for n in range(2, len(text) + 1):
        assert last[n] == library.encode(text[1:n])[-1]


def test_long_runs_without_a_space(model, library):
    for text in ("abcdef" * 30_000, "=" * 50_000, " " * 50_000, "é☃" * 20_000):
        assert ids_of(model.encode(text)) == library.encode(text, add_bos=True, add_eos=True)


def test_rows_on_spark(spark, library):
    texts = [None, "", " ", "a b\nc", "a b\nc", "x" * 5000, "naïve ☃ \x00", " lead and trail "]
    df = spark.createDataFrame([(None if i == 4 else i, t, "y", 1, b"z") for i, t in enumerate(texts)],
                               "doc_id long, text string, given string, ids int, `decoded` binary").repartition(3)
    encoded = pieces.encode(df, slice_bytes=64)
    assert encoded.columns == ["doc_id", "text", "given", "decoded", "ids"]
    rows = pieces.decode(encoded, slice_bytes=64).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert ids_of(r["ids"]) == want and r["decoded"] == library.decode(want) and r["given"] == "y"
    null_ids = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert pieces.decode(null_ids).collect()[0]["decoded"] is None
    assert pieces.decode(pieces.encode(df.limit(0))).collect() == []


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op13_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
