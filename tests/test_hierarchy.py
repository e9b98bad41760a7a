"""Hierarchies against a brute-force walk."""

import random

from pyspark.sql import types as T

from symtide.operators import hierarchy as H

LINKS = "id string, parent string"


def brute(links):
    parent = dict(links)
    out = {}
    for i in parent:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        out[i] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at) :]), -1)
    return out


def forest(n, seed, cycles=3):
    rng = random.Random(seed)
    links = [(f"n{i:04}", f"n{rng.randrange(i):04}" if i and rng.random() < 0.85 else None) for i in range(n)]
    for k in range(cycles):
        links += [(f"c{k}a", f"c{k}b"), (f"c{k}b", f"c{k}c"), (f"c{k}c", f"c{k}a"), (f"c{k}d", f"c{k}b"), (f"c{k}e", f"c{k}d")]
    return links + [("self", "self"), ("under", "self"), ("alone", None)]


def rows(df):
    return {r["id"]: (r["root"], r["depth"]) for r in df.collect()}


def test_small_and_giant_components_agree(spark):
    links = forest(300, 1)
    df = spark.createDataFrame(links, LINKS)
    want = brute(links)
    assert rows(H.hierarchies(df)) == want
    assert rows(H.hierarchies(df, max_component=4, bucket_nodes=10)) == want


def brute_full(links):
    """id -> (root, depth, path, n_descendants, on_cycle) by walking up from every node."""
    parent, roots = dict(links), brute(links)
    above = {}
    for i in parent:
        seen, at = [i], parent[i]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        above[i] = (seen, at)
    n = dict.fromkeys(parent, 0)
    for i, (seen, _) in above.items():
        for a in seen[1:]:
            n[a] += 1
    out = {}
    for i, (seen, back) in above.items():
        root, depth = roots[i]
        path = seen if depth >= 0 else seen[: seen.index(root) + 1]
        out[i] = (root, depth, path[::-1], n[i], back == i)
    return out


def full(df):
    return {r["id"]: (r["root"], r["depth"], r["path"], r["n_descendants"], r["on_cycle"]) for r in df.collect()}


def test_any_way_equals_brute_force_in_all_columns(spark):
    links = forest(300, 2) + [(f"r{i:02}", f"r{(i * 7 + 7) % 91 // 7:02}") for i in range(13)] + [("s1", "r04"), ("s2", "s1")]
    df, want = spark.createDataFrame(links, LINKS), brute_full(links)
    for way in ({}, {"max_component": 4, "bucket_nodes": 10}, {"max_component": 1}):
        assert full(H.hierarchies(df, **way)) == want
    assert sum(r[4] for r in want.values()) == 23
    flags = {r["id"]: r["on_cycle"] for r in H.hierarchies(df, max_component=4, paths=False).collect()}
    assert flags == {i: r[4] for i, r in want.items()}


def test_paths_round_a_ring(spark):
    """a under b under c under a, z under b: every entry of a path is the parent of the next."""
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("z", "b")]
    for size in (1, 100):
        got = full(H.hierarchies(spark.createDataFrame(links, LINKS), max_component=size))
        assert {i: r[2] for i, r in got.items()} == {"a": ["a"], "c": ["a", "c"], "b": ["a", "c", "b"], "z": ["a", "c", "b", "z"]}
        assert {i: r[3] for i, r in got.items()} == {"a": 3, "b": 3, "c": 3, "z": 0}


def test_long_chain_in_little_memory():
    """The walk of a chain of 100,000 nodes holds one path, not one for each node."""
    import tracemalloc

    chain = [(f"k{i:06}", f"k{i - 1:06}" if i else None, "k000000") for i in range(100_000)]
    tracemalloc.start()
    n = sum(r[2] == len(r[0]) - 7 + int(r[0][1:]) for r in H._traverse(chain, False))
    assert n == 100_000 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_deep_chain(spark):
    links = [(f"k{i:03}", f"k{i - 1:03}" if i else None) for i in range(200)]
    assert rows(H.hierarchies(spark.createDataFrame(links, LINKS))) == brute(links)


def test_chains_are_no_cycles(spark):
    """A few nodes left over at the deep end of a chain, beside a cycle."""
    links = [(f"k{i:03}", f"k{i - 1:03}" if i else None) for i in range(100)] + [("x", "y"), ("y", "x")]
    assert rows(H.hierarchies(spark.createDataFrame(links, LINKS))) == brute(links)


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "x")], LINKS)
    nodes = H.hierarchies(df)
    got = {r["id"]: r for r in nodes.collect()}
    assert got["c"]["path"] == ["a", "b", "c"] and got["a"]["n_descendants"] == 3
    assert got["z"]["path"] == ["x", "z"] and got["y"]["path"] == ["x", "y"] and got["x"]["path"] == ["x"]
    assert got["x"]["on_cycle"] and not got["z"]["on_cycle"]
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in H.descendants(nodes).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1), ("x", "z", 1), ("y", "z", 2), ("x", "y", 1), ("y", "x", 1)}


def test_all_pairs(spark):
    links = forest(200, 9) + [(f"r{i:02}", f"r{(i + 1) % 7:02}") for i in range(7)] + [("s1", "r04"), ("s2", "s1")]
    parent, want = dict(links), set()
    for i in parent:
        seen, at = [i], parent[i]
        while at is not None and at not in seen:
            want.add((at, i, len(seen)))
            seen.append(at)
            at = parent[at]
    rows = [tuple(r) for r in H.descendants(H.hierarchies(spark.createDataFrame(links, LINKS))).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_descendants_on_and_below_cycles(spark, monkeypatch):
    monkeypatch.setattr(H, "RING_BLOCK", 4)
    links = forest(300, 4) + [(f"r{i:02}", f"r{(i + 1) % 13:02}") for i in range(13)] + [("s1", "r04"), ("s2", "s1"), ("s3", "s2"), ("t", "r11")]
    leaves = [(f"m{k}", p) for k, p in enumerate(["n0007", "s3", "s3", "r00", "c1a", "c1d", "under", "self", None])]
    parent = dict(links + leaves)
    want = {}
    for i in parent:
        seen, at = {i}, parent[i]
        while at is not None and at not in seen:
            want.setdefault(at, []).append(len(seen))
            seen.add(at)
            at = parent[at]
    df = spark.createDataFrame([(*x, True) for x in links] + [(*x, False) for x in leaves], LINKS + ", is_class boolean")
    got = {r["id"]: (r["n_descendants"], r["reach"]) for r in H.descendant_counts(df).collect()}
    assert got == {i: (len(x), max(x)) for i, x in want.items()} and got["s1"] == (4, 3) and got["r00"][0] == 19


def test_empty(spark):
    assert H.hierarchies(spark.createDataFrame([], LINKS)).count() == 0
    assert H.descendant_counts(spark.createDataFrame([], LINKS + ", is_class boolean")).count() == 0


SYMBOL = T.StructType([T.StructField(c, T.StringType()) for c in ("usr", "kind", "qualified_name", "parent_class", "base_classes")] + [T.StructField("is_definition", T.BooleanType())])


def test_symbols(spark, clash):
    rows = [
        ("1", "class", "a::B", None, None, True),
        ("1", "class", "a::B", "wrong", None, False),  # a declaration loses to the definition
        ("2", "struct", "a::C", " ::a::B<int> ", "zzz", None),
        ("3", "method", "a::C::f", "a::C", None, True),
        ("4", "class", "a::D", "  ", "\"a::C<x, y>\" ; other", True),
        ("5", "class_template", "a::E", "gone::X", "a::B", True),  # its parent does not exist
        ("6", "class", "a::F", None, "a::G", True),
        ("7", "class", "a::G", None, "[\"a::F\"]", True),
        ("8", "method", "a::F::g", "a::F", None, True),
        ("9", "function", None, None, None, None),
        (None, "class", "a::N", None, None, True),
        ("9", "function", None, None, None, None),
        ("10", None, "a::Odd", "a::E<" + "T" * 5000 + ">", None, True),
    ]
    df = clash(spark.createDataFrame(rows, SYMBOL))
    got = {r["usr"]: (r["root_usr"], r["depth"]) for r in H.symbol_hierarchy(df).collect()}
    assert got == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 2), "4": ("1", 2), "5": ("5", 0), "6": ("6", -1), "7": ("6", -1), "8": ("6", -1), "9": ("9", 0), "10": ("5", 1)}
    assert H.symbol_hierarchy(df.limit(0)).count() == 0


def test_descendants_of_symbols_come_out_as_pairs(spark, tmp_path):
    """Classes and members in a tree, on a cycle and below it: each pair once, and as many as p1_descendants counts."""
    from symtide.plans import all_queries

    under = {"1": None, "2": "1", "3": "2", "4": "2", "5": "7", "6": "5", "7": "6", "8": "6", "9": "8", "10": "10", "11": "10", "12": None}
    leaves = ("4", "9", "11", "12")
    rows = [(i, "method" if i in leaves else "class", f"a::C{i}", p and f"a::C{p}", None, True) for i, p in under.items()]
    spark.createDataFrame(rows + rows[:3], SYMBOL).write.parquet(f"{tmp_path}/symbols.parquet")
    want = set()
    for i in under:
        seen, at = [i], under[i]
        while at is not None and at not in seen:
            want.add((at, i, len(seen)))
            seen.append(at)
            at = under[at]
    got = [tuple(r) for r in all_queries()["p1_descendant_pairs"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r["usr"]: (r["n_descendants"], r["reach"]) for r in all_queries()["p1_descendants"](spark, str(tmp_path)).collect()}
    far = {a: [x for u, _, x in got if u == a] for a, _, _ in got}
    assert counts == {a: (len(x), max(x)) for a, x in far.items()}


def test_hot_parent(spark):
    """A third of all nodes under one parent."""
    links = [("hub", None)] + [(f"m{i}", "hub" if i % 3 == 0 else f"m{i - 1}" if i else None) for i in range(3000)]
    import symtide.session as S

    old, S.HOT_ROWS = S.HOT_ROWS, 100
    try:
        assert rows(H.hierarchies(spark.createDataFrame(links, LINKS), max_component=500)) == brute(links)
    finally:
        S.HOT_ROWS = old
