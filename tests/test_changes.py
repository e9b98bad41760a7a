"""Change capture: batches, failures, replays."""

import datetime as dt

import pytest

from symtide.operators.changes import ChangeCapture, capture_changes
from symtide.session import scratch_path

LOG = "record_id long, run_id long, file_path string, file_hash string, compile_args_hash string, indexed_at timestamp_ntz, success boolean"
RUNS = "run_id long, status string"


def t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


ROWS = [
    (1, 1, "a", "H1", None, t(1), True),
    (2, 1, "b", "h1", "X", t(1), None),
    (3, 2, "a", "h1", "", t(5), True),  # the same state in other letters: no change
    (4, 3, "b", "h2", "x", t(6), True),  # run 3 failed: it counts for run 4
    (5, 4, "c", "h9", None, t(2), True),
    (6, 4, "a", "h0", None, t(0), True),  # late: older than what is known
    (7, 5, "c", "h9", "q", t(9), True),
    (8, 5, "d", "h1", None, t(9), False),
    (9, 5, "e", None, None, t(9), True),
    (10, 6, "f", "h1", None, t(9), True),  # after the last success
    (11, 4, None, "h1", None, t(9), True),
    (12, 5, "b", "h2", "X", None, True),
    (7, 5, "c", "h9", "q", t(9), True),
]
STATUS = [(1, "succeeded"), (2, "succeeded"), (3, "failed"), (4, "succeeded"), (5, "succeeded"), (6, None)]
WANT = {(1, "a"), (1, "b"), (4, "b"), (4, "c"), (5, "c")}


def got(df):
    rows = [(r["run_id"], r["file_path"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_all_at_once(spark, clash):
    log, runs = spark.createDataFrame(ROWS, LOG), spark.createDataFrame(STATUS, RUNS)
    assert got(capture_changes(clash(log), clash(runs))) == WANT


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_run_by_run_with_failures(spark, partitions):
    log = spark.createDataFrame(ROWS, LOG)
    c = ChangeCapture(spark, scratch_path(spark, "test"), partitions=partitions)
    for last, arrived in enumerate((2, 3, 4, 6, 9, 12), 1):  # the log grows in order of record_id
        seen = log.filter(f"record_id <= {arrived}")
        runs = spark.createDataFrame(STATUS[:last], RUNS)
        with pytest.raises(RuntimeError):
            c.run(seen, runs, fail_before_commit=True)
        assert got(c.changes()) == {x for x in WANT if x[0] < last}
        # The replay, by another process, keeps to its plan even if more has arrived meanwhile.
        c = ChangeCapture(spark, c.dir, partitions=partitions)
        assert c.run(log, spark.createDataFrame(STATUS, RUNS))
        assert got(c.changes()) == {x for x in WANT if x[0] <= last}
        assert not c.run(seen, runs)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_late_records_of_old_runs(spark, partitions):
    """What arrives about a captured run is taken in, and corrects that run and those after it."""
    rows = [(1, 1, "a", "1", None, t(1), True), (2, 2, "b", "1", None, t(2), True), (3, 3, "b", "2", None, t(8), True)]
    late = [(4, 1, "late_file", "9", None, t(1), True), (5, 2, "a", "5", None, t(3), True), (6, 1, "b", "2", None, t(9), True), (7, 3, "c", "1", None, t(3), True)]
    good = lambda n: spark.createDataFrame([(i, "succeeded") for i in range(1, n + 1)], RUNS)
    c = ChangeCapture(spark, scratch_path(spark, "test"), partitions=partitions)
    assert c.run(spark.createDataFrame(rows[:2], LOG), good(2)) and got(c.changes()) == {(1, "a"), (2, "b")}
    assert c.run(spark.createDataFrame(rows, LOG), good(3)) and got(c.changes()) == {(1, "a"), (2, "b"), (3, "b")}
    every = spark.createDataFrame(rows + late, LOG)
    with pytest.raises(RuntimeError):
        c.run(every, good(3), fail_before_commit=True)
    while c.run(every, good(3)):
        pass
    want = {(1, "a"), (1, "late_file"), (2, "a"), (1, "b"), (3, "c")}
    assert got(c.changes()) == want == got(capture_changes(every, good(3)))


def test_success_that_changes_later(spark, monkeypatch):
    """A run that turns out to have succeeded after later ones were captured; in small batches, with the history merged."""
    import symtide.operators.changes as C

    monkeypatch.setattr(C, "MERGE_AFTER", 2)
    log = spark.createDataFrame(ROWS, LOG)
    late = [(i, "succeeded" if i == 3 else s) for i, s in STATUS]
    c = ChangeCapture(spark, scratch_path(spark, "test"), partitions=2, arrivals=3)
    for runs, want in ((STATUS, WANT), (late, WANT - {(4, "b")} | {(3, "b")}), (STATUS, WANT)):
        while c.run(log, spark.createDataFrame(runs, RUNS)):
            pass
        assert got(c.changes()) == want == got(capture_changes(log, spark.createDataFrame(runs, RUNS)))


def test_nothing(spark):
    assert capture_changes(spark.createDataFrame([], LOG), spark.createDataFrame(STATUS, RUNS)).count() == 0
    assert capture_changes(spark.createDataFrame(ROWS, LOG), spark.createDataFrame([], RUNS)).count() == 0
