from pyspark.sql import functions as F

from symtide.operators import eager

SITES = "call_site_id long, caller_usr string, callee_usr string, file string"
SYMS = "usr string, kind string"


def sites(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 70}", f"d{i % 90}" if i % 4 else "sink", f"f{i % 5}") for i in range(900)]
    rows += [(1000, None, "x", None), (1001, " ", "", "f"), (1002, "hot", "sink", "f0"), (1002, "hot", "sink", "f0")]
    return spark.createDataFrame(rows, SITES), rows


def test_dominant_keys(spark, clash):
    df, rows = sites(spark)
    want = set()
    for side, k in (("caller", 1), ("callee", 2)):
        for v in {r[k] for r in rows}:
            if v and v.strip() and sum(r[k] == v for r in rows) * 100 >= 2 * len(rows):
                want.add((side, v))
    assert {(r["side"], r["usr"]) for r in eager.dominant_keys(clash(df)).collect()} == want
    assert ("caller", "hot") in want


def test_profile(spark):
    df, rows = sites(spark)
    got = {(r["side"], r["usr"]): (r["n_sites"], r["n_partners"], r["n_files"]) for r in eager.key_profile(df).collect()}
    mine = [r for r in rows if r[1] == "hot"]
    assert got[("caller", "hot")] == (len(mine), len({r[2] for r in mine}), len({r[3] for r in mine}))
    assert got[("callee", "x")] == (1, 0, 0)


def test_counts_equal_those_of_the_join(spark):
    df, _ = sites(spark)
    into = df.select(F.col("callee_usr").alias("usr"))
    out = df.select(F.col("caller_usr").alias("usr")).unionByName(into)
    want = {r["usr"]: r["count"] for r in into.join(out, "usr").groupBy("usr").count().collect()}
    assert {r["usr"]: r["n"] for r in eager.eager_join_count(into, out, "usr").collect()} == want


def test_kind_matrix_multiplies_copies(spark):
    df = spark.createDataFrame([(1, "a", "b", "f"), (2, "a", "b", "f"), (3, "a", "zz", "f"), (4, None, "b", "f")], SITES)
    syms = spark.createDataFrame([("a", "method"), ("a", "method"), ("b", "class"), ("b", None), (None, "class")], SYMS)
    got = {(r["caller_kind"], r["callee_kind"]): r["n_rows"] for r in eager.kind_matrix(df, syms).collect()}
    assert got == {("method", "class"): 4, ("method", None): 4}


def test_empty(spark):
    none = spark.createDataFrame([], SITES)
    assert eager.dominant_keys(none).count() == eager.key_profile(none).count() == eager.two_step_chains(none).count() == 0
