"""Comparison, verdict, noise, payload and streaming behaviour on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import batch, diff, noise, payload, review
from logloom.sources import html, packages


def test_assignment_is_optimal():
    rnd = random.Random(7)
    for _ in range(300):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        gain = {(i, j): rnd.randint(1, 9) for i in range(n) for j in range(m) if rnd.random() < 0.7}
        got = diff.best_pairs([(i, j, g) for (i, j), g in gain.items()])
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        best = max(sum(gain.get((i, c), 0) for i, c in enumerate(p) if c < m) for p in itertools.permutations(range(m + n), n))
        assert sum(gain[p] for p in got) == best


def test_changed_ranges_of_long_texts():
    a, b = "parola " * 3000 + "dodici mesi", "parola " * 3000 + "sei mesi"
    left, right = diff.changed_ranges(a, b)
    assert "".join(a[s["start"]:s["end"]] for s in left) == "dodci" and left[0]["start"] >= 21000
    assert right and right[-1]["end"] <= len(b) - len(" mesi")


def test_opcodes_turn_left_into_right():
    rnd = random.Random(3)
    for size in (5, 60, 1500):
        a = [f"w{rnd.randint(0, size)}" for _ in range(size)]
        b = [w for i, w in enumerate(a) if i % 17 != 3]
        b[2:2] = ["new", "words"]
        out, i = [], 0
        for o in diff._opcodes(a, b):
            out += a[i:o["i1"]] + b[o["j1"]:o["j2"]]
            i = o["i2"]
        assert out + a[i:] == b


def test_increasing_is_longest():
    assert sorted(diff.increasing([3, 1, 2, 5, 4])) == [1, 2, 4]
    assert diff.increasing([]) == set()


def _blocks(spark, left, right):
    rows = [(1, "L", i, t.split()) for i, t in enumerate(left)] + [(1, "R", i, t.split()) for i, t in enumerate(right)]
    df = spark.createDataFrame(rows, "pair_id bigint, side string, block bigint, keys array<string>")
    return df.withColumn("lines", F.lit(1)).withColumn("size", F.lit(10.0)).withColumn("kind", F.lit("paragrafo"))


LEFT = ["Il contratto decorre dal primo gennaio per dodici mesi interi", "Firma del cliente qui sotto", "Servizi di rete e di misura inclusi nel prezzo finale", "Chiusura"]


def test_alignment_and_differences(spark):
    right = [LEFT[0].replace("dodici", "sei"), "Testo nuovo mai visto prima in questa pagina oggi stesso", LEFT[2], "Chiusura"]
    b = _blocks(spark, LEFT, right)
    pairs = {(r.l, r.r) for r in diff.align(b).collect()}
    assert {(0, 0), (2, 2), (3, 3)} <= pairs and (None, 1) in pairs and (1, None) in pairs
    w = b.select("pair_id", "side", "block", F.posexplode("keys").alias("k", "key"))
    from pyspark.sql import Window

    w = w.withColumn("pos", (F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("block", "k")) - 1).cast("bigint"))
    d = diff.compare(w, b).orderBy("id").collect()
    assert [r.id for r in d] == list(range(1, len(d) + 1))
    one = next(r for r in d if r.left_text == "dodici")
    assert (one.op, one.klass, one.tipo, one.right_text) == ("cambiato", "testo", "parola", "sei")
    assert one.context == "primo gennaio per mesi interi Firma"


def test_copies_pair_in_order(spark):
    b = _blocks(spark, ["riga uguale"] * 3 + ["fine"], ["riga uguale"] * 4 + ["fine"])
    pairs = [(r.l, r.r) for r in diff.align(b).collect() if r.l is not None and r.r is not None]
    assert len(pairs) == 4 and sorted(pairs) == sorted(pairs, key=lambda p: p[1])


@pytest.mark.parametrize("a,b,want", [
    ("Alfa", "ALFA", "maiuscole"), ("S.p.A", "S.p.A.", "punteggiatura"), ("10 %", "10", "numeri"), ("a b", "ab", "spazi"),
    ("uno due", "uno tre", "parola"), ("uno due tre quattro", "cinque sei sette otto", "frase"), ("", "12,5", "numeri"), ("", "!", "punteggiatura"),
])
def test_types(spark, a, b, want):
    d = spark.createDataFrame([("cambiato", "testo", a, b)], "op string, klass string, left_text string, right_text string")
    assert diff.with_type(d).first().tipo == want


def test_verdict_rules(spark):
    f = "case bigint, anchor_id string, op string, klass string, tipo string, zone string, left_text string, right_text string, generated string, page int, pos bigint"
    row = lambda a, g, k="testo", t="parola": (1, a, "cambiato", k, t, "corpo", "T", g, g, 0, ord(a[0]))
    tobe = spark.createDataFrame([row("a", "x"), row("b", "y"), row("c", "z"), row("d", "v", "variabile"), row("e", "w", "stile")], f)
    asis = spark.createDataFrame([row("a", "x"), row("b", "old"), row("q", "gone")], f)
    cases = spark.createDataFrame([(1, 3, "tollerante", True, True, True, [])], "case bigint, version int, profile string, has_asis boolean, tobe_has_text boolean, asis_has_text boolean, tolerated_tipi array<string>")
    tol = spark.createDataFrame([], "case bigint, anchor_id string, generated string, note string, ord bigint")
    marks = spark.createDataFrame([(1, "a", "x", 2, 2), (1, "b", "was", 2, 2), (1, "zz", "k", 2, 2), (1, "yy", "k", 2, 1), (1, "c", "z", 3, 2)],
                                  "case bigint, anchor_id string, generated string, version int, engine int")
    none = spark.createDataFrame([], "case bigint, anchor_id string")
    unres = spark.createDataFrame([], "case bigint, anchor_id string, version int, generated string")
    out = review.judge(tobe, asis, cases, tol, marks, none, unres)
    got = {r.anchor_id: r for r in out["judged"].collect()}
    assert got["a"].verdict == "da_fare" and got["a"].unresolved
    assert got["b"].verdict == "in_corso" and got["b"].previous_text == "was"
    assert got["c"].verdict == "regressione" and got["c"].marked
    assert got["d"].verdict is None and got["e"].verdict == "tollerata" and got["q"].verdict == "fatta"
    v = out["verification"].first()
    assert (v.checked, v.resolved, v.unresolved, v.changed) == (3, 1, 1, 1)
    assert {r.anchor_id for r in out["marks"].collect()} == {"yy", "c"}
    s = out["summary"].first()
    assert (s.fatte, s.da_fare, s.in_corso, s.regressioni, s.avanzamento) == (1, 1, 1, 1, 0.25)


def test_noise_rules(spark):
    good, errors = noise.usable_rules([("a", r"\d+", True), ("a", "x", True), ("b", "(a+)+", True), ("c", "(", True), ("d", "z", False)])
    assert [n for n, _ in good] == ["a"] and errors["b"] == noise.SLOW and "c" in errors and errors["a"] == "nome duplicato"
    lines = spark.createDataFrame([("Il 01/02/2024 pagati 1.234,56 € a IT60X0542811101000000123456",)], "line string")
    rules = [(n, noise.PRESETS[n]) for n in ("Data", "IBAN", "Importo")]
    r = noise.apply_rules(lines, rules).first()
    assert r.noise_line == "Il ⁣NOISE:Data pagati ⁣NOISE:Importo a ⁣NOISE:IBAN" and [h.n for h in r.hits] == [1, 1, 1]


def test_units(spark):
    toks = ["(", "ciao", ")", "[", "x", "]", "A", "B", "C", "D", "forni-", "tura", "fine", "."]
    rows, x, y = [], 0.0, 0.0
    for i, t in enumerate(toks):
        if t == "tura":
            x, y = 0.0, 20.0
        rows.append(("d", i, t, t, 0, x, y, x + 5.0, y + 10.0))
        x += 10.0
    df = spark.createDataFrame(rows, "doc string, pos int, text string, key string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.key for r in noise.units(df).orderBy("unit").collect()] == ["(ciao)", "☒", "ABCD", "fornitura", "fine."]


def test_payload_fixture(spark):
    p = '{"template":{"x":"nascosto"},"description":"testo lungo","when":"2026-09-18T10:00:00+02:00","ms":"1758180000000","s":"ab","ok":true,"dossier":{"amount":1234.5},"attributes":[{"value":"0.01"},{"value":"89"}]}'
    f = payload.leaves(spark.createDataFrame([(1, p)], "id int, payload string"))
    idx = payload.payload_index(f, ["id"])
    texts = {r.printed: r.path for r in idx.where("printed is not null").collect()}
    assert texts["testo lungo"] == "description" and texts["18/09/2026"] in ("when", "ms") and "nascosto" not in texts
    cells = spark.createDataFrame([("S", 1, 1, "text", "Voce"), ("S", 1, 2, "text", "Prezzo"), ("S", 2, 1, "text", "Quota"), ("S", 2, 2, "number", "0.246813")],
                                  "sheet string, row int, col int, kind string, value string")
    vals = spark.createDataFrame([(1, v) for v in ("0,010", "1.234,50", "(89)", "0,2468", "0,247", "boh")], "id int, value string")
    got = {r.value: (r.found_name, r.proof) for r in payload.lookup(vals, idx, payload.dictionary(cells), ["id"]).collect()}
    assert got["0,010"] == ("attributes[0].value", "payload") and got["1.234,50"][0] == "dossier.amount" and got["(89)"][0] == "attributes[1].value"
    assert got["0,2468"] == ("S: Quota", "listino") and got["0,247"][1] == "listino" and got["boh"] == ("", None)


def test_html_blocks_and_numbers(spark):
    doc = "<html><body><p>Uno</p><table><tr><td>Prima <table><tr><td>Interna A</td><td>Interna B</td></tr></table> Dopo</td></tr></table><script>x</script></body></html>"
    got = html.html_blocks(spark.createDataFrame([(1, doc)], "page_id int, html string")).orderBy("id").collect()
    assert [b.text for b in got] == ["Uno", "Prima", "Interna A", "Interna B", "Dopo"]
    assert got[3].dom_path == "table[1]/tr[1]/td[1]/table[1]/tr[1]/td[2]"
    nums = {"0,010": 0.01, "1.234,56": 1234.56, "89": 89, "-3,5": -3.5, "12a": None, "1,2,3": None, "": None}
    for t, want in nums.items():
        v = spark.range(1).select(text.italian_number(F.lit(t)).alias("v")).first().v
        assert (None if v is None else float(v)) == want
    assert spark.range(1).select(text.url_norm(F.lit("HTTPS://User@Host.IT/p?b=2&utm_x=1&a=1#f")).alias("u")).first().u == "https://User@host.it/p?a=1&b=2#f"


def test_package_list(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_bytes("Template key;Nome;Iniz;cod ;package name\r\nKEY_A ;x;y;z;P1\r\nkey_a;x;y;z;P1\r\nKEY_A;x;y;z;P2\r\nKEY_B;x;y;z; \r\n;x;y;z;P1\r\n".encode("cp1252"))
    rows, skipped = packages.load_packages(spark, str(p))
    got = [(r.template_key, r.package) for r in rows.orderBy("ord").collect()]
    assert got == [("KEY_A", "P1"), ("KEY_A", "P2"), ("KEY_B", batch.NO_PACKAGE)] and skipped.first().skipped == 1
    p.write_bytes(b"a\x00b")
    with pytest.raises(packages.PackageListError):
        packages.load_packages(spark, str(p))


def test_reserved_names_mixed_family(spark):
    calls = spark.createDataFrame([(1, ["f"], "A"), (2, ["f"], "A_2"), (3, ["F"], "a"), (4, ["f"], "A_2"), (5, ["g"], "A")], "ord bigint, folders array<string>, key string")
    got = {(r.folder_ci, r.ord): r.name for r in batch.reserve_names(calls).collect()}
    assert got[("f", 1)] == "A" and got[("f", 2)] == "A_2" and got[("f", 3)] == "a_3" and got[("f", 4)] == "A_2_2" and got[("g", 5)] == "A"
