"""Cutting differences at proven values: overlaps, remainders, proofs switched off, whole values."""

import pytest

from logloom.operators import variables as V

DIFF = ("pair_id long, id long, op string, klass string, tipo string, zone string, slot string, left_keys array<string>, right_keys array<string>, "
        "target_text string, prova string, nome string")
VALUE = "pair_id long, id long, s int, e int, prova string, nome string"


def diff(i, left, right, klass="testo", op=None, tipo="frase", slot=None):
    left, right = left.split(), right.split()
    return 1, i, op or ("mancante" if not right else "in_piu" if not left else "cambiato"), klass, tipo, "corpo", slot, left, right, "t", "", ""


def cut(spark, rows, values, **on):
    out = V.split_at_values(spark.createDataFrame(rows, DIFF), spark.createDataFrame(values, VALUE), **on).collect()
    return sorted((r["id"], r["part"], r["op"], r["klass"], " ".join(r["left_keys"]), " ".join(r["right_keys"]), r["prova"], r["nome"], r["target_text"]) for r in out)


@pytest.fixture(scope="module")
def got(spark):
    return cut(spark, [diff(1, "", "a 1 b 2 3 c"), diff(2, "x y", "1 z"), diff(3, "", "1 2"), diff(4, "", "A 1", tipo="maiuscole"), diff(5, "k", "", op="mancante"),
                       diff(6, "", "1 2 3"), diff(7, "", "no")],
               [(1, 1, 1, 2, "buco", "one"), (1, 1, 3, 5, "buco", "two"), (1, 2, 0, 1, "buco", "p"), (1, 3, 0, 2, "cella", "all"), (1, 4, 1, 2, "buco", "q"),
                (1, 6, 0, 2, "buco", "first"), (1, 6, 1, 3, "buco", "late"), (1, 99, 0, 1, "buco", "none")])


def test_covered_keys_go_and_the_rest_stays(got):
    assert [r for r in got if r[0] == 1] == [
        (1, 0, "in_piu", "testo", "", "a b c", "", "", "t"), (1, 1, "in_piu", "variabile", "", "1 2 3", "buco", "one", "t ⎵")]
    assert [r for r in got if r[0] == 2] == [
        (2, 0, "cambiato", "testo", "x y", "z", "", "", "t"), (2, 1, "in_piu", "variabile", "", "1", "buco", "p", "t ⎵")]


def test_nothing_but_a_value_is_a_variable_whole(got):
    assert [r for r in got if r[0] == 3] == [(3, 0, "in_piu", "variabile", "", "1 2", "cella", "all", "t")]


def test_the_first_of_overlapping_values_counts(got):
    assert [r[5] for r in got if r[0] == 6] == ["3", "1 2"]


def test_case_and_left_out_texts_are_never_cut(got):
    assert [r[2:7] for r in got if r[0] in (4, 5, 7)] == [
        ("in_piu", "testo", "", "A 1", ""), ("mancante", "testo", "k", "", ""), ("in_piu", "testo", "", "no", "")]


def test_switched_off_proofs_keep_counting(spark):
    rows, values = [diff(1, "", "a 1 2")], [(1, 1, 1, 2, "listino", "off"), (1, 1, 2, 3, "buco", "on")]
    assert cut(spark, rows, values, on=["buco"]) == [(1, 0, "in_piu", "testo", "", "a 1", "", "", "t"), (1, 1, "in_piu", "variabile", "", "2", "buco", "on", "t ⎵")]
    assert cut(spark, rows, values, on=[]) == [(1, 0, "in_piu", "testo", "", "a 1 2", "listino", "off", "t")]
