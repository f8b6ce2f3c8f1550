"""The whole comparison on small pairs with known edits."""

import pytest

from logloom.operators import comparison as C
from logloom.operators import noise as N

WORD = ("pair_id long, side string, pos long, key string, block long, page int, x0 double, y0 double, x1 double, y1 double, size double, "
        "bold boolean, zone string, ends_line boolean")
BLOCK = "pair_id long, side string, block long, keys array<string>, lines int, size double, kind string"
A = "the offer is valid for all customers of the energy plan until further notice"
B = "payment is due within thirty days from the date of the invoice sent by mail"
CC = "the customer may withdraw from the contract without penalty by written notice only"
DD = "any dispute will be settled by the court of the place where the customer lives"


def tables(spark, pairs):
    """pairs = {id: (left blocks, right blocks)}; a block is text, or (text, page, size, lines)."""
    words, blocks = [], []
    for p, sides in pairs.items():
        for side, texts in zip("LR", sides):
            pos = 0
            for b, item in enumerate(texts):
                text, page, size, lines = item if isinstance(item, tuple) else (item, 0, 10.0, 1)
                keys = text.split()
                blocks.append((p, side, b, keys, lines, size, "paragrafo"))
                for k, key in enumerate(keys):
                    words.append((p, side, pos, key, b, page, 20.0 * k, 20.0 * b, 20.0 * k + 18, 20.0 * b + 10, size, False, "corpo", k == len(keys) - 1))
                    pos += 1
    return spark.createDataFrame(words, WORD), spark.createDataFrame(blocks, BLOCK)


def told(spark, pairs, rules=()):
    out = {p: [] for p in pairs}
    for r in sorted(C.compare_pairs(*tables(spark, pairs), rules).collect(), key=lambda r: (r["pair_id"], r["id"])):
        out[r["pair_id"]].append((r["op"], r["klass"], r["left_text"], r["right_text"]))
        assert r["id"] == len(out[r["pair_id"]])
    return out


@pytest.fixture(scope="module")
def got(spark):
    date = ("Data", N.PRESETS["Data"])
    return told(spark, {
        1: ([A, B, CC], [A, B, CC]),
        2: ([A, B, CC], [A, B.replace("thirty", "sixty"), CC]),
        3: ([A, B, CC, DD], [B, CC, DD, A]),
        4: ([A, (B, 0, 10.0, 2), CC], [A, CC]),
        5: ([A, CC], [A, B.replace("thirty", "10/02/2026"), CC]),
        6: ([A, B + " on 01/02/2026 here"], [A, B + " on 03/04/2026 here"]),
        7: ([A, (B, 0, 10.0, 1), CC], [A, (B, 0, 14.0, 1), CC]),
        8: ([(A, 0, 10.0, 1), (B, 0, 10.0, 1)], [(A, 0, 10.0, 1), (B, 1, 10.0, 1)]),
        9: ([A, B], [A.upper().replace("THE", "the"), B]),
    }, [date])


def test_equal_documents_have_no_differences(got):
    assert got[1] == []


def test_a_changed_word(got):
    assert got[2] == [("cambiato", "testo", "thirty", "sixty")]


def test_a_moved_block_is_one_move(got):
    assert got[3] == [("spostato", "composizione", A, A)]


def test_a_removed_block_of_two_lines_is_a_section(got):
    assert got[4] == [("sezione_assente", "composizione", B, "")]


def test_an_added_line_keeps_its_own_text(got):
    assert got[5] == [("in_piu", "testo", "", B.replace("thirty", "10/02/2026"))]


def test_other_dates_are_noise(got):
    assert got[6] == [("cambiato", "rumore", "01/02/2026", "03/04/2026")]


def test_another_size_is_style(got):
    assert got[7] == [("cambiato", "stile", B, B)]


def test_page_numbers_come_first(got):
    assert got[8] == [("pagine", "composizione", "", "")]


def test_capitals_change_every_word(got):
    assert {d[:2] for d in got[9]} == {("cambiato", "testo")}
    assert " ".join(d[2] for d in got[9]).upper() == " ".join(d[3] for d in got[9]).upper()


def test_nothing_to_compare(spark):
    words, blocks = tables(spark, {1: ([A], [A])})
    assert C.compare_pairs(words.limit(0), blocks.limit(0)).collect() == []
