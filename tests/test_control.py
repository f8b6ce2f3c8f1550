"""Same-place proofs, display contexts, empty places and generated texts on small tables."""

from pyspark.sql import functions as F

from logloom.operators import control as C

DIFF = "pair_id long, id long, op string, klass string, left_keys array<string>, right_keys array<string>"


def diff(i, left, right, klass="testo", op="cambiato"):
    return 1, i, op, klass, left.split(), right.split()


def test_only_whole_values_at_the_same_place_are_proven(spark):
    diffs = spark.createDataFrame([
        diff(1, "importo 1.234,50 euro", "importo 9.999,00 euro"),  # numbers by value
        diff(2, "nato il 03/04/2026.", "nato il 05/06/2027."),  # dates as days
        diff(3, "Mario Rossi", "Luca Rossi"),  # the perturbed value is not whole
        diff(4, "il Mario Rossi", "Anna Bianchi il"),  # another place
        diff(5, "di Anna Verdi qui", "di Eva Neri qui"), diff(6, "Mario Rossi", "Anna Bianchi", klass="stile"),
        diff(7, "Mario Rossi", "Anna Bianchi", op="spostato"), diff(8, "«mario» ROSSI,", "ANNA bianchi"), diff(9, "", "x"),
    ], DIFF)
    changed = spark.createDataFrame([
        (1, 1, "1234.5", "9999"), (1, 2, "2026-04-03", "2027-06-05T00:00:00Z"), (1, 3, "Mario Rossi", "Anna  Bianchi"), (1, 4, "Anna Verdi", "Eva Neri"),
        (1, 5, "", "x"), (1, 6, "il", "zz"), (2, 1, "Mario", "Anna"),
    ], "pair_id long, value_id long, original string, perturbed string")
    got = sorted((r["id"], r["value_id"], r["start"], r["n"]) for r in C.same_place_words(diffs, changed).collect())
    assert got == [(1, 1, 1, 1), (2, 2, 2, 1), (5, 4, 1, 2), (8, 3, 0, 2)]


def test_contexts_stay_in_their_block(spark):
    words = spark.createDataFrame([(1, "L", p, f"w{p}", 0 if p < 7 else 1) for p in range(10)] + [(1, "R", 0, "no", 0)], "pair_id long, side string, pos long, text string, block long")
    changes = spark.createDataFrame([(1, 6, 7), (1, 7, 8), (1, 0, 1), (1, 9, 10), (1, 3, 3)], "pair_id long, i1 long, i2 long")
    got = {(r["i1"], r["i2"]): (r["before"], r["after"]) for r in C.display_context(changes, words).collect()}
    assert got == {(6, 7): ("w1 w2 w3 w4 w5", "w7 w8 w9"), (7, 8): ("w2 w3 w4 w5 w6", "w8 w9"), (0, 1): ("", "w1 w2 w3 w4 w5"), (9, 10): ("w7 w8", ""),
                   (3, 3): ("w0 w1 w2", "w3 w4 w5 w6")}


def test_an_empty_side_stands_by_its_neighbour(spark):
    words = spark.createDataFrame([(1, s, p, 0, 10.0 * p, 0.0, 10.0 * p + 8, 9.0) for s in "LR" for p in range(3)], "pair_id long, side string, pos long, page int, x0 double, y0 double, x1 double, y1 double")
    changes = spark.createDataFrame([(1, 2, 2, 0, 1), (1, 0, 0, 1, 2), (1, 0, 1, 3, 3), (1, 0, 1, 0, 1), (2, 0, 0, 0, 1)], "pair_id long, i1 long, i2 long, j1 long, j2 long")
    got = {tuple(r)[:5]: r["empty_at"] and r["empty_at"]["x0"] for r in C.empty_places(changes, words).collect()}
    assert got == {(1, 2, 2, 0, 1): 10.0, (1, 0, 0, 1, 2): 0.0, (1, 0, 1, 3, 3): 20.0, (1, 0, 1, 0, 1): None, (2, 0, 0, 0, 1): None}


def test_generated_texts_are_normal_forms(spark):
    rows = [(1, "l’importo  “x” ﬁne"), (2, None), (3, " ​ "), (None, "a b"), (None, "a b")]
    d = spark.createDataFrame(rows, "id long, right_text string")
    got = sorted(((r["id"], r["generated"]) for r in C.generated_texts(d.distinct(), ["id"]).collect()), key=str)
    assert got == [(1, "l'importo \"x\" fine"), (2, ""), (3, ""), (None, "a b")]
    assert C.generated_texts(d.where(F.lit(False)), ["id"]).collect() == []
