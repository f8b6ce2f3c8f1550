"""Daily logs: byte-exact scan, names, body reads, incremental store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions import names, paths
from logloom.operators import archive, catalog, search
from logloom.operators.batch import spread_days
from logloom.sources import daily_log

A = "aaaaaaaa-1111-4222-8333-444444444444"
B = "bbbbbbbb-1111-4222-8333-444444444444"


def write(root, env, day, data):
    p = root / env / f"{day:%Y}" / f"{day:%m}" / f"{day:%Y%m%d}.txt"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)
    return p


def body(n, when="2026-09-18T10:00:00Z"):
    docs = ",".join('{"template":{"templateKey":"K%d"}}' % i for i in range(n))
    return ('{"documents":[%s],"dossier":{"id":"d","number":"7","requestDate":"%s"},"note":"città"}' % (docs, when)).encode()


def content(spark, root):
    return daily_log.with_day_columns(daily_log.read_files(spark, str(root))).select("env", "day", "path", "content")


def test_scan_edge_file(spark, tmp_path):
    data = b"\xef\xbb\xbforphan\n### gone.json\n### a.json\n\n" + b'{"x":"\xc3\xa8"}\n' + b"### b\xff.json \n" + b"body two\nextra\n### last.json"
    write(tmp_path, "coll", dt.date(2026, 9, 18), data)
    got = daily_log.scan_entries(content(spark, tmp_path)).orderBy("seq").collect()
    for e in got:
        assert data[e.header_offset:].startswith(b"### ")
    assert [data[e.body_offset:e.body_offset + e.body_len] for e in got] == [b'{"x":"\xc3\xa8"}', b"body two"]
    assert [bytes(e.name_bytes) for e in got] == [b"a", b"b\xff"]
    assert got[1].name == "b�" and [e.json_ok for e in got] == [True, False]
    stats = daily_log.scan_stats(content(spark, tmp_path)).first()
    assert (stats.n_entries, stats.n_orphans) == (2, 4)


def test_scan_survey_offsets(spark, tmp_path):
    data = b"\xef\xbb\xbforphan\n### x.json\n\n### a.json\n \n" + b"\n" * 25 + b'{"ok":1}\n'
    write(tmp_path, "coll", dt.date(2026, 9, 18), data)
    e = daily_log.scan_entries(content(spark, tmp_path)).collect()
    assert len(e) == 1 and data[e[0].body_offset:e[0].body_offset + e[0].body_len] == b'{"ok":1}'


def test_empty_and_junk_files(spark, tmp_path):
    write(tmp_path, "coll", dt.date(2026, 9, 18), b"")
    (tmp_path / "coll/2026/09/20260917.txt.part").write_bytes(b"x")
    (tmp_path / "coll/2026/8").mkdir(parents=True)
    (tmp_path / "coll/2026/8/20260801.txt").write_bytes(b"x")
    assert [(r.env, r.day) for r in daily_log.list_days(spark, str(tmp_path)).collect()] == [("coll", dt.date(2026, 9, 18))]
    s = daily_log.scan_stats(content(spark, tmp_path)).first()
    assert (s.n_entries, s.n_orphans) == (0, 0)


def test_store_updates_and_heals(spark, tmp_path):
    root, day = tmp_path / "m", dt.date(2026, 9, 18)
    first = f"### {A}_SUM_1a2b3c0200000031.json\r\n".encode() + body(3) + b"\r\n"
    second = f"### {B}_SUM_1a2b3c0200000032.json\r\n".encode() + body(1) + b"\r\n"
    write(root, "coll", day, first + second)
    write(root, "coll", dt.date(2026, 8, 3), first)
    store = catalog.EntryStore(spark, str(tmp_path / "store"))
    plan = {(r.day, r.action) for r in store.update(str(root)).collect()}
    assert plan == {(day, "scan"), (dt.date(2026, 8, 3), "scan")}
    hits = search.search(store.entries(), "coll", fdi_prefix="AAAAAAAA")
    assert [h.ndocs for h in hits.collect()] == [3, 3]
    best = search.pick_best(store.entries().where("env = 'coll'"), ["env"]).where("is_best").first()
    assert (best.day, best.ndocs) == (day, 3)
    ok = daily_log.read_bodies(store.entries(), content(spark, root)).collect()
    assert not any(r.stale for r in ok) and {bytes(r.body) for r in ok} == {body(3), body(1)}
    # The day is published again with a line in front: offsets move, the same bodies come back.
    old = spark.createDataFrame(
        store.entries().where(F.col("day") == day).collect(), store.entries().schema)
    write(root, "coll", day, b"noise\n" + first + second)
    moved = daily_log.read_bodies(old, content(spark, root))
    assert moved.where("stale").count() == 2
    healed = daily_log.read_bodies_healing(old, content(spark, root)).collect()
    assert sorted(bytes(r.body) for r in healed) == sorted([body(3), body(1)])
    (root / "coll/2026/08/20260803.txt").unlink()
    plan = {(r.day, r.action) for r in store.update(str(root)).collect()}
    assert plan == {(day, "scan"), (dt.date(2026, 8, 3), "remove")}
    assert store.entries().select("day").distinct().count() == 1 and store.files().count() == 1
    # An update that dies before its snapshot shows nothing.
    whole = store._snapshot
    store._snapshot = lambda files: (_ for _ in ()).throw(RuntimeError("stopped"))
    write(root, "coll", day, b"noise only, nothing complete\n")
    with pytest.raises(RuntimeError):
        store.update(str(root))
    assert store.entries().count() == 2
    # A day that lost its entries keeps none of them.
    store._snapshot = whole
    store.update(str(root))
    assert store.entries().count() == 0 and store.files().first()["n_entries"] == 0


@pytest.mark.parametrize("raw,want", [
    (f"{A}_CTR_OFFER_FIX_B_1a2b3c0200000031", (A, "CTR_OFFER_FIX_B", "1a2b3c0200000031", True)),
    ("correlationId_vuoto_MOD_TEST_R_1a2b3c0300000000", (None, "MOD_TEST_R", "1a2b3c0300000000", False)),
    (f"{A}-t15_CTR_OFFER_FIX_B_1a2b3c0200000099", (A + "-t15", "CTR_OFFER_FIX_B", "1a2b3c0200000099", False)),
    (f"{A}_2_MOD_ALPHA_NUMERIC_RP_1a2b3c0100000041", (A, "2_MOD_ALPHA_NUMERIC_RP", "1a2b3c0100000041", True)),
    ("test-MOD_X_MOD_X_1a2b3c0100000041", ("test-mod_x", "MOD_X", "1a2b3c0100000041", False)),
    ("abc_X_X", ("abc", "X_X", None, False)),
    ("NOUNDERSCORE", (None, "NOUNDERSCORE", None, False)),
    (f"{A.upper()}_K_K", (A, "K_K", None, False)),
])
def test_entry_names(spark, raw, want):
    n = spark.range(1).select(names.entry_name(F.lit(raw)).alias("n")).first().n
    assert (n.fdi, n.template_key, n.call_id, n.well_formed) == want


def test_spread_and_path_days(spark):
    base = dt.date(2026, 9, 20)
    days = [base - dt.timedelta(d) for d in (0, 1, 2, 5, 9)]
    got = spark.range(1).select(spread_days(F.array(*[F.lit(d) for d in days])).alias("k")).first().k
    assert [(base - d).days for d in got] == [0, 1, 5, 9]
    today = F.lit(dt.date(2026, 9, 24))
    cases = {"2026/09/22.txt": dt.date(2026, 9, 22), "coll_22-09-2026.txt": dt.date(2026, 9, 22), "x/120260922.txt": None}
    for rel, want in cases.items():
        parts = F.reverse(F.split(F.lit(rel), "/"))
        assert spark.range(1).select(paths.path_day(parts, today)["day"].alias("d")).first().d == want


def test_coverage_calendar(spark):
    today = dt.date(2026, 9, 23)
    d = lambda n: today - dt.timedelta(n)
    local = spark.createDataFrame([("c", d(1), 5), ("c", d(2), 0), ("c", d(20), 5), ("c", d(3), 0)], "env string, day date, size bigint")
    listed = spark.createDataFrame([("c", d(2)), ("c", d(6))], "env string, day date")
    seen = spark.createDataFrame([("c", d(7))], "env string, day date")
    got = {r.day: r.kind for r in catalog.coverage_days(local, listed, seen, local, 30, today).collect()}
    assert got[d(1)] == "present" and got[d(2)] == "pending" and got[d(3)] == "empty"
    assert got[d(6)] == "pending" and got[d(7)] == "lost" and d(25) not in got
    assert got[d(8)] == "unknown" and d(0) not in got


def test_archive_discovery(spark, tmp_path):
    log = b"### a_K_1a2b3c0200000031.json\n{}\n"
    for rel, data in {
        "in/svil/20260922.txt": log, "in/copy/svil_20260922.txt": log + log, "in/coll20260921.txt": log,
        "in/x/coll_2026-09-21.txt": log.replace(b"K", b"J"), "in/production/20260920.txt": log, "in/coll/notes.md": b"hello", "in/a.zip": b"PK",
    }.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    root = str(tmp_path / "in")
    found = {r.rel_path: r for r in archive.discover(daily_log.read_files(spark, root), root, ["svil", "coll"], dt.date(2026, 9, 24)).collect()}
    assert found["copy/svil_20260922.txt"].status == "importable" and found["svil/20260922.txt"].status == "duplicate_same"
    assert found["coll20260921.txt"].status == found["x/coll_2026-09-21.txt"].status == "conflict"
    assert found["production/20260920.txt"].status == "needs_env" and found["a.zip"].reason == archive.R_COMPRESSED
    assert found["coll/notes.md"].reason == archive.R_NOT_A_LOG
