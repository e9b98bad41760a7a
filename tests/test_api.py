"""The tools of a project: what a search finds, the detail tools accept."""

import pytest
from pyspark.sql import functions as F

from symtide.api import Project
from symtide.functions import naming
from symtide.operators import nested, store, telemetry


@pytest.fixture(scope="module")
def project(spark, data):
    return Project(spark, data)


def test_search_and_details_agree(project):
    hit = project.find_symbols_by_pattern(".*", "classes", "names_only", max_results=5)
    assert hit.rows.count() == 5 and hit.status.first()["status"] == "truncated" and "file" not in hit.rows.columns
    name = hit.rows.first()["qualified_name"]
    info = project.get_class_info(name)
    assert info["candidates"].count() == 1 and {"methods", "derived"} <= set(info)
    nodes, cut = project.get_class_hierarchy(name)
    assert nodes.filter(F.col("name") == name).count() == 1 and not cut.first()["truncated"]
    assert project.get_class_hierarchy(name, "up", output_format="cpp_with_meta")[0].filter(F.col("line").startswith("class " + name)).count() == 1
    assert project.get_class_hierarchy(name, "down", output_format="compact")[0].count() >= 1
    with pytest.raises(ValueError):
        project.get_class_hierarchy(name, "sideways")
    with pytest.raises(ValueError):
        project.find_symbols_by_pattern("x", max_results=0)


def test_empty_results_are_explained(project):
    got = project.find_symbols_by_pattern("void noSuchThing(int)")
    assert got.rows.count() == 0 and got.fallback.reason == "signature_in_pattern" and got.status.first()["status"] == "empty"


def test_calls_are_each_others_inverse(project):
    pair = project.edges.join(project.symbols.select(F.col("usr").alias("caller_usr"), F.col("qualified_name").alias("a")), "caller_usr").join(project.symbols.select(F.col("usr").alias("callee_usr"), F.col("qualified_name").alias("b")), "callee_usr").orderBy("a", "b").first()
    scope = "include_external_libraries"
    out = project.find_outgoing_calls("::" + pair["a"], search_scope=scope).rows
    into = project.find_incoming_calls("::" + pair["b"], search_scope=scope).rows
    assert out.filter(F.col("callee_usr") == pair["callee_usr"]).count() and into.filter(F.col("caller_usr") == pair["caller_usr"]).count()
    assert project.find_outgoing_calls("::" + pair["a"], return_format="call_sites").rows.count() >= 1
    assert [pair["caller_usr"], pair["callee_usr"]] in project.trace_execution_path("::" + pair["a"], "::" + pair["b"])


def test_files_aliases_and_sync(project, data):
    file = project.symbols.filter("file IS NOT NULL").orderBy("file").first()["file"]
    assert project.find_in_file(file.rsplit("/", 1)[-1]).rows.count() >= 1 and project.file_suggestions(file.upper()).first()["file"] == file
    assert project.get_type_alias_info("Alias_1").first()["kind"] == "alias" and project.get_type_alias_info("Nope").first()["kind"] == "unknown"
    assert project.sync_project(data).count() == 0 and project.sync_project(data, "full").count() > 0


def test_sync_names_every_changed_file(spark, data, tmp_path):
    """One symbol changed in each of 30 files, one file new and one gone."""
    import shutil

    old, new = tmp_path / "old", tmp_path / "new"
    for d in (old, new):
        d.mkdir()
        for name in ("call_sites", "customer"):
            shutil.copy(f"{data}/{name}.parquet", d / f"{name}.parquet")
    base = spark.read.parquet(f"{data}/symbols.parquet").filter("usr IS NOT NULL").dropDuplicates(["usr"]).limit(300).withColumn("k", F.monotonically_increasing_id())
    base = base.withColumn("file", F.concat(F.lit("f"), F.col("k") % 60, F.lit(".h")))
    base.coalesce(1).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    base.drop("k").write.parquet(str(old / "symbols.parquet"))
    line = F.when((F.col("k") < 30), F.col("line") + 1).otherwise(F.col("line"))
    file = F.when(F.col("file") == "f50.h", "f999.h").otherwise(F.col("file"))
    base.withColumn("line", line).withColumn("file", file).drop("k").write.parquet(str(new / "symbols.parquet"))
    p = Project(spark, str(old))
    got = {r["path"]: r["change"] for r in p.sync_project(str(new)).collect()}
    assert got == {f"f{i}.h": "modified" for i in range(30)} | {"f50.h": "removed", "f999.h": "added"}
    assert p.sync_project(str(new)).count() == 0


def test_a_delivery_spread_over_batches_stays_whole(spark, tmp_path):
    from symtide.operators.store import Table
    from symtide.session import scratch_path
    from symtide.streaming import streams

    src, table, point = str(tmp_path / "in"), Table(spark, scratch_path(spark, "sites")), str(tmp_path / "point")
    put = lambda *rows: spark.createDataFrame(rows, "file string, line int, version long").coalesce(1).write.mode("append").parquet(src)
    follow = lambda: spark.readStream.schema("file string, line int, version long").option("maxFilesPerTrigger", 1).parquet(src)
    put(("a", 1, 1), ("b", 1, 1))
    put(("a", 2, 1))
    got = lambda: {tuple(r) for r in streams.replace_by_file(spark, follow(), table, point).collect()}
    assert got() == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1)}
    put(("a", 9, 2))
    put(("a", 8, 2), ("b", 7, 0))  # the second half of a's newer delivery, and an old one of b
    put(("a", 9, 2))  # the same again
    assert got() == {("a", 9, 2), ("a", 8, 2), ("b", 1, 1)}


def test_bases_of_instantiations(spark):
    rows = [("p", ["T", "Fixed", "type-parameter-0-1"], None, None, ["T", "U"]), ("i", [], "p", ["int", "Foo"], None), ("j", ["Own"], "p", ["int"], None), ("k", None, "gone", None, None)]
    df = spark.createDataFrame(rows, "usr string, bases array<string>, primary_usr string, arguments array<string>, parameters array<string>")
    assert {r["usr"]: r["bases"] for r in naming.resolved_bases(df).collect()} == {"p": rows[0][1], "i": ["int", "Fixed", "Foo"], "j": ["Own"], "k": None}


def test_result_counts(spark):
    texts = ["[1,2]", '{"results": [1]}', '{"data": []}', '{"callers": [1], "callees": [2, 3]}', '{"count": 7}', '{"x": 1}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(telemetry.result_count(F.col("t"))).collect()] == [2, 1, 0, 3, 7, 1, None, None]


def test_scenarios(spark):
    s = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "scenario_id string, queries array<string>")
    assert {tuple(r) for r in telemetry.expanded_scenarios(s).collect()} == {("a", "x"), ("b/1", "y"), ("b/2", "z")}
    r = spark.createDataFrame([("c", True), ("c", False), ("d", True)], "category string, passed boolean")
    assert {x["category"]: x["pass_rate"] for x in telemetry.pass_rates(r).collect()} == {"c": 0.5, "d": 1.0}
    rec = spark.createDataFrame([("Q1", "search", "big-model"), ("C2", "calls", "small")], "query_id string, category string, model_id string")
    assert telemetry.chosen(rec, ["q1"]).count() == telemetry.chosen(rec, None, ["C"]).count() == telemetry.chosen(rec, None, None, ["BIG"]).count() == 1
    assert store.maintenance_plan(200, 20, 100) == ["analyze", "vacuum", "compact"] and store.maintenance_plan(1, 0, 1) == ["analyze"]


def test_conversations(spark, data):
    bridge = nested.nodes(spark.read.parquet(f"{data}/lms_conversations.parquet"))
    assert telemetry.tool_descriptions(bridge).filter("description IS NOT NULL").count() >= 1 and telemetry.conversation_text(bridge).count() >= 1
