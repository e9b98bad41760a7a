"""Orphan references against a brute-force check."""

import datetime as dt
import random

from symtide.operators import orphans as O

REFS = "ref_id long, side string, key string, made timestamp_ntz"
PARENTS = "key string, made timestamp_ntz, gone timestamp_ntz, kept boolean"


def t(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(refs, parents):
    out = []
    for i, side, k, at in refs:
        if k is None or not k.strip():
            continue
        own = [p for p in parents if p[0] == k]
        if any(p[3] for p in own) or at is not None and any(p[1] is not None and p[1] <= at and (p[2] is None or p[2] > at) for p in own):
            continue
        late = own and at is not None and all(p[1] is not None and p[1] > at for p in own)
        out.append((i, side, k, "missing" if not own else "late" if late else "deleted"))
    return sorted(out)


def case(seed, n=2000):
    rng = random.Random(seed)
    when = lambda: t(rng.randrange(100)) if rng.random() > 0.03 else None
    keys = [f"k{i}" for i in range(60)]
    parents = [(rng.choice(keys), when(), t(rng.randrange(100)) if rng.random() < 0.5 else None, rng.random() < 0.02) for _ in range(150)] + [(None, t(1), None, False)]
    parents += parents[:10]
    refs = [(i, rng.choice(["caller", "callee"]), rng.choice(["hot"] + keys[:3] if rng.random() < 0.4 else keys + ["nobody", "", "  ", None, "k" * 3000]), when()) for i in range(n)]
    return refs, parents


def found(df):
    return sorted((r["ref_id"], r["side"], r["key"], r["reason"]) for r in df.collect())


def test_brute_force(spark):
    for seed in (1, 2):
        refs, parents = case(seed)
        a, b = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
        assert found(O.orphan_references(a, b)) == brute(refs, parents)
        # few ranges, hot ones split over salts
        assert found(O.orphan_references(a, b, range_rows=100, fine_bits=2)) == brute(refs, parents)


def test_equal_hashes_are_told_apart():
    import numpy as np
    import pyarrow as pa

    base = {"h": pa.array([5, 5, 5], pa.int64()), "key": pa.array(["x", "y", "y"]), "made": pa.array([1, 2, 9], pa.timestamp("us")), "gone": pa.array([None, 5, None], pa.timestamp("us")), "kept": pa.array([False] * 3)}
    p = O._Parents([pa.RecordBatch.from_pydict(base)])
    why = p.probe(np.array([5, 5, 5, 5, 6]), pa.array(["x", "y", "y", "z", "x"]), np.array([3, 3, 6, 3, 3]), np.ones(5, dtype=bool))
    assert why.tolist() == [0, 0, 3, 1, 1]


def test_empty_sides(spark):
    refs, parents = case(3, 50)
    a, b = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    assert O.orphan_references(a.limit(0), b).count() == 0
    assert {r["reason"] for r in O.orphan_references(a, b.limit(0)).collect()} == {"missing"}


def test_report(spark, clash):
    sites = spark.createDataFrame([(1, "a", "b", t(10)), (2, "zz", None, t(900)), (3, "zz", "a", None)], "call_site_id long, caller_usr string, callee_usr string, created_at timestamp_ntz")
    syms = spark.createDataFrame([("a", t(1), None), ("b", t(500), None)], "usr string, created_at timestamp_ntz, removed_at timestamp_ntz")
    deps = spark.createDataFrame([("dep",)], "usr string")
    got = O.call_orphans(clash(sites), clash(syms), clash(deps))
    assert {(r["call_site_id"], r["side"], r["reason"]) for r in got.collect()} == {(1, "callee", "late"), (2, "caller", "missing"), (3, "caller", "missing"), (3, "callee", "deleted")}
    rep = {(r["side"], r["reason"], str(r["month"])): (r["n_refs"], r["n_usrs"]) for r in O.orphan_report(got).collect()}
    assert rep[("callee", "late", "2024-01-01")] == (1, 1) and rep[("caller", "missing", "2024-02-01")] == (1, 1)
