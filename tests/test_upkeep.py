"""Upkeep, states, policies, diagnostics and records that SQL does not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symtide.operators import records, store, telemetry, upkeep
from symtide.session import path_exists, scratch_path


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_files_are_replaced_whole(spark):
    sym = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b")], "usr string, file string")
    meta = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "path string, at int, success boolean")
    fresh, info = spark.createDataFrame([("u9", "a")], "usr string, file string"), spark.createDataFrame([("a", 2, True), ("b", 2, False)], "path string, at int, success boolean")
    kept, noted = upkeep.save_file(sym, meta, fresh, info)
    assert rows(kept) == {("u9", "a")} and rows(noted) == {("a", 2, True), ("b", 2, False)}
    got = upkeep.merge_worker_result(sym, spark.createDataFrame([("a", 1)], "file string, line int"), spark.createDataFrame([("h", "1")], "header string, hash string"), {"symbols": fresh, "sites": spark.createDataFrame([("a", 7), ("a", 7), ("c", 1)], "file string, line int"), "headers": spark.createDataFrame([("h", "1"), ("h", "2")], "header string, hash string")})
    assert rows(got["symbols"]) == {("u9", "a"), ("u3", "b")} and rows(got["sites"]) == {("a", 7), ("c", 1)} and rows(got["headers"]) == {("h", "1"), ("h", "2")}
    assert rows(upkeep.without_argument_hashes(spark.createDataFrame([("a", "h")], "path string, args_hash string"))) == {("a", None)}
    assert upkeep.cache_problems({"version": 1, "config_path": "c"}, {"version": 1, "config_path": "d"}) == ["config_path"] and upkeep.compile_database_changed("x", None)


def test_tables_can_be_cleared_backed_up_and_repaired(spark):
    import glob
    import os

    path = scratch_path(spark, "tab")
    t = store.Table(spark, path)
    for n in (3, 5):
        t.commit(spark.range(n).toDF("k"))
    t.backup(path + "-copy")
    assert t.at(t.versions()[0]).count() == 3 and spark.read.parquet(path + "-copy").count() == 5
    for f in glob.glob(f"{path.removeprefix('file:')}/{t.versions()[-1]}/*.parquet"):
        open(f, "wb").write(b"broken")
        crc = os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc")
        if os.path.exists(crc):
            os.remove(crc)
    spark.catalog.clearCache()
    assert t.repair() and t.read().count() == 3
    t.clear()
    assert t.read().count() == 0 and not store.Table(spark, path + "-none").repair()


def test_states_and_policies(spark):
    path = scratch_path(spark, "state")
    s = upkeep.ProjectState(spark, path)
    assert s.load() is None and s.status()["percent"] == 0.0
    s.to("initializing").to("indexing")
    s.done, s.total = 3, 8
    s.save()
    s.done = 6
    s.save()
    assert s.load()["percent"] == 75.0 and s.load()["partial"]
    with pytest.raises(ValueError):
        s.to("refreshing")
    run = lambda: spark.range(2)
    assert upkeep.under_policy("reject", s, run) == (None, "index is indexing") and upkeep.under_policy("block", s, run, lambda: False)[1] == "timed out"
    df, note = upkeep.under_policy("allow_partial", s, run)
    assert df.count() == 2 and note == "partial: 6 of 8 files, 75.0 percent"
    s.to("indexed")
    assert upkeep.under_policy("reject", s, run)[1] == ""
    assert upkeep.should_report(50, 0) and not upkeep.should_report(51, 4.9) and upkeep.should_report(3, 2.1, tty=True) and upkeep.hints("call_path") and not upkeep.hints("call_path", 2)


def test_logs_rotate(spark):
    path = scratch_path(spark, "log")
    spark.range(100).write.json(path)
    assert not upkeep.rotate(spark, path) and upkeep.rotate(spark, path, 10) and path_exists(spark, path + ".1") and not path_exists(spark, path) and not upkeep.rotate(spark, path, 10)


def test_diagnostics(spark):
    d = spark.createDataFrame([(4, False, "a"), (3, True, "b"), (2, None, "c"), (1, None, "d"), (3, None, "e")], "severity int, in_system_header boolean, text string")
    assert {r["text"]: r["level"] for r in upkeep.split_diagnostics(d).collect()} == {"a": "error", "b": "warning", "c": "warning", "d": "note", "e": "error"}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(upkeep.diagnostics_text(F.array(*[F.lit(f"m{i}") for i in range(7)]))) == "m0\nm1\nm2\nm3\nm4\n... and 2 more" and one(upkeep.diagnostics_text(F.array(F.lit("x")))) == "x"
    at = lambda *v: tuple(one(upkeep.location_columns(*map(F.lit, v))))
    assert at("a.h", 1, "a.cpp", 9) == ("a.cpp", 9, "a.h", 1) and at("a.h", 1, "a.h", 1) == ("a.h", 1, None, None) and at("a.h", 1, None, None) == ("a.h", 1, None, None)
    assert records.hierarchy_error('no "X"') == '{"error": "no \\"X\\""}' and records.hierarchy_error('no "X"', "cpp") == '// Error: no "X"'


def test_arguments_and_fixtures(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(telemetry.unwrapped(F.lit('{"parameters": {"a": 1}}'))) == '{"a":1}' and one(telemetry.unwrapped(F.lit('{"parameters": {"a": 1}, "b": 2}'))) == '{"parameters": {"a": 1}, "b": 2}' and one(telemetry.unwrapped(F.lit('{"parameters": 3}'))) == '{"parameters": 3}'
    holds = lambda spec, v: one(telemetry.fixture_holds(F.lit(spec), F.lit(v).cast("string")))
    assert holds("contains:ell", "HELLO") and holds("regex:^h.*o$", "Hello") and holds("hello", "HELLO") and not holds("hello", None) and not holds("regex:^x", "hello")
    calls = spark.createDataFrame([(1, "s", "a", dt.datetime(2024, 1, 1, 0, i), 0) for i in range(1)] + [(i, "s", "b", dt.datetime(2024, 1, 1, 1, i), 0) for i in range(2, 8)], "call_id int, session string, tool string, ts timestamp_ntz, result_count int")
    assert rows(telemetry.runaway_loops(calls)) == {("s", "b", 2, 6)}


def test_retries_over_hours_and_without_a_session(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    calls = [(1, "s", "a", at(0), 0), (2, "s", "b", at(1), 0), (3, "s", "a", at(59), 0), (4, "s", "a", at(61), 2), (5, "s", "a", at(300), 0), (6, None, "a", at(5), 0), (7, None, "a", at(200), 1), (8, "s", None, None, 0), (9, "s", None, at(1), 1), (10, "t", "a", at(400), 0)]
    df = spark.createDataFrame(calls, "call_id int, session string, tool string, ts timestamp_ntz, result_count int")
    got = {r["call_id"]: r["is_retry"] for r in telemetry.retries(df, None, None).collect()}
    want = {}
    for c, s, t, ts, _ in calls:
        before = [x for x in calls if x[1] == s and x[2] == t and (x[3] or dt.datetime.min, x[0]) < (ts or dt.datetime.min, c)]
        want[c] = bool(before) and max(before, key=lambda x: (x[3] or dt.datetime.min, x[0]))[4] == 0
    assert got == want and got[4] and got[7] and got[9]
    assert {r["call_id"] for r in telemetry.retries(df, 150.0, 1).filter("is_retry").collect()} == {4}


def test_timings_and_capped(spark):
    assert set(upkeep.timings({"a": lambda: spark.range(1), "b": lambda: spark.range(2)})) == {"a", "b"}
    pairs = spark.createDataFrame([("s", f"n{i}", i // 3) for i in range(9)] + [("t", "t", 0)], "start string, node string, depth int")
    assert rows(records.capped_hierarchies(pairs, 4)) == {("s", f"n{i}", i // 3, True) for i in range(4)} | {("t", "t", 0, False)}
