"""Search fallbacks, graphs, aliases, stores, telemetry, sources and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from symtide.operators import graphs, search, store, telemetry, templates
from symtide.operators import relations as rel
from symtide.operators.search import Criteria
from symtide.session import scratch_path
from symtide.sources import extract, tables


def test_scope():
    assert search.project_only("project_code_only") and not search.project_only("include_external_libraries")
    with pytest.raises(ValueError):
        search.project_only("all")


def test_fallbacks(spark):
    s = spark.createDataFrame([("Foo", "a::Foo", "src/Foo.h"), ("FooBar", "a::FooBar", "src/x.h")], "name string, qualified_name string, file string").withColumn("name_lc", F.lower("name"))
    assert search.explain_empty(s, "void Foo(int)").alternatives == ("a::Foo",)
    assert search.explain_empty(s, "^FooB$").reason == "unnecessary_anchors"
    assert search.explain_empty(s, "Foo.").reason == "pattern_too_short"
    assert search.explain_empty(s, "zz::Foo").suggested == "Foo"
    assert search.explain_empty(s, "nope", "dir/foo.h").alternatives == ("src/Foo.h",)
    assert search.explain_empty(s, "nope") is None
    assert search.explain_empty(s, "(a+)+").reason == "signature_in_pattern"  # a parenthesis is the first thing looked at
    assert search.next_steps(5, filtered=False, n_methods=11, abstract=True) and not search.next_steps(1)


def test_status(spark):
    st = lambda n, **k: search.result_status(spark.range(n), **k).first()["status"]
    assert [st(0), st(3), st(25), st(3, total=9), st(0, partial=True)] == ["empty", "normal", "large", "truncated", "partial"]


def test_detail(spark):
    assert search.with_detail(spark.createDataFrame([(1, "b", "f")], "usr int, brief string, file string"), "names_only").columns == ["usr"]


def test_paths_and_orders(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c2"), ("c2", "d"), ("c", "d"), ("d", "a")], "x string, y string")
    assert graphs.bfs_path(e, "a", "d", "x", "y") == ["a", "c2", "d"]
    assert graphs.bfs_path(e, "a", "d", "x", "y", max_depth=2) is None and graphs.bfs_path(e, "a", "a", "x", "y") == ["a"] and graphs.bfs_path(e, "a", "nobody", "x", "y") is None
    nodes = spark.createDataFrame([(c,) for c in "abcxyz"], "node string")
    inh = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x")], "derived_usr string, base_usr string")
    assert {r["node"]: r["level"] for r in graphs.topological_levels(nodes, inh).collect()} == {"a": 0, "b": 1, "c": 2, "x": -1, "y": -1, "z": -1}
    top, cut = graphs.capped(spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "node string, depth int"), 2)
    assert [r["node"] for r in top.collect()] == ["a", "b"] and cut.first()["truncated"]


def test_whole_table_traversals_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 60) for _ in range(2)} | {("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c1", "n3"), ("d", "c0"), ("e", "d"), ("s", "s")}
    e = spark.createDataFrame(sorted(pairs), "derived_usr string, base_usr string")
    nodes = sorted({x for p in pairs for x in p} | {"alone"})
    up = {n: [b for a, b in pairs if a == n] for n in nodes}

    def reach(n):
        seen, now, d = {}, {n}, 0
        while now:
            d += 1
            now = {b for a in now for b in up[a]} - set(seen)
            seen |= dict.fromkeys(now, d)
        return seen

    want = {(n, b, d) for n in nodes for b, d in reach(n).items()}
    anc = graphs.closure(e, "derived_usr", "base_usr")
    assert {tuple(r) for r in anc.collect()} == want and anc.count() == len(want)
    start = spark.createDataFrame([(n,) for n in nodes], "node string")
    for way in ("up", "down", "both"):
        got = {tuple(r) for r in graphs.hierarchies_of(anc, start, way).collect()}
        one = {(n, *r) for n in ("n50", "n3", "c0", "e", "s", "alone") for r in map(tuple, graphs.hierarchy(e, start.filter(F.col("node") == n), way).collect())}
        assert {g for g in got if g[0] in ("n50", "n3", "c0", "e", "s", "alone")} == one, way
    bad = {n for n in nodes if n in reach(n) or any(b in reach(b) for b in reach(n))}
    level = lambda n: max((1 + level(b) for b in up[n]), default=0)
    assert {r["node"]: r["level"] for r in graphs.topological_levels(start, e).collect()} == {n: -1 if n in bad else level(n) for n in nodes}
    counts = {(r["node"], r["depth"]): r["n"] for r in graphs.walk_counts(e, "derived_usr", "base_usr", 3).collect()}
    made = graphs.walks(e, start, "derived_usr", "base_usr", 3).filter("depth > 0").groupBy("source", "depth").count().collect()
    assert counts == {(r["source"], r["depth"]): r["count"] for r in made}
    few = spark.createDataFrame([("n50",), ("e",), ("n3",)], "node string")
    got = {(r["source"], r["target"]): r["path"] for r in graphs.bfs_paths(e, few, few, "derived_usr", "base_usr").collect()}
    assert {k for k in got} >= {(n, n) for n in ("n50", "e", "n3")} and all(p[0] == s and p[-1] == t and all((a, b) in pairs for a, b in itertools.pairwise(p)) and len(p) - 1 == (reach(s)[t] if s != t else 0) for (s, t), p in got.items())


def test_parameter_inheritance(spark):
    t = spark.createDataFrame([("ns::Tmpl", ["T", "U"], ["U", "Fixed"]), ("Other", ["T"], ["Base"]), ("Num", ["T", "N"], ["type-parameter-0-0"])], "name string, params array<string>, bases array<string>")
    refs = spark.createDataFrame([("D", "ns::Tmpl<int, a::Base<x, y>>"), ("E", "Other<Base>"), ("F", "Tmpl<int>"), ("G", "Tmpl<int, Base>"), ("H", "::Num< Base , 3>"), ("I", "Plain")], "derived_usr string, base_raw string")
    got = {(r["derived_usr"], r["base"]) for r in templates.parameter_bases(refs, t).collect()}
    assert got == {("D", "a::Base<x, y>"), ("G", "Base"), ("H", "Base")}
    rows = [("D", "D", "class", ["ns::Tmpl<int, Base>", "T"], True, False), ("c:@ST>1#T@K", "K", "class_template", ["T", "a::Base"], True, True), ("B", "Base", "class", [], True, False), ("X", "X", "class", ["Base"], False, False), ("M", "Tmpl", "class_template", [], True, True), ("W", "BaseWidget", "class", [], True, False)]
    c = spark.createDataFrame(rows, "usr string, name string, kind string, bases array<string>, is_project boolean, is_template boolean")
    got = {tuple(r) for r in templates.derived_classes(c, t).collect()}
    assert got == {("Base", "c:@ST>1#T@K", "base"), ("Tmpl", "D", "specialization"), ("Base", "D", "parameter")}
    fit = lambda b, p: spark.range(1).select(templates.base_matches(F.lit(b), F.lit(p))).first()[0]
    assert fit("a::Base", "Base") and fit("Base<int>", "Base<") and fit("a::Base<int>", "Base<") and not fit("BaseWidget", "Base") and not fit("Base", "Base<")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(templates.parameters_of_usr(F.lit("c:@N@a@ST>2#T#NI@Box"))) == ["T", "U"] and one(templates.parameters_of_usr(F.lit("c:@ST>1#T@A@S@B"))) == []
    assert one(templates.is_specialization(F.lit("A<int>"), F.lit("class"))) and not one(templates.is_specialization(F.lit("f<T>(A<int>)"), F.lit("function_template"))) and not one(templates.is_specialization(F.lit("operator<(A<int>)"), F.lit("function")))


def test_hierarchy_both_leaves_siblings_out(spark):
    e = spark.createDataFrame([("leaf", "impl"), ("impl", "base"), ("impl2", "base"), ("leaf2", "impl2"), ("below", "leaf")], "derived_usr string, base_usr string")
    start = spark.createDataFrame([("leaf",)], "node string")
    assert {r["node"] for r in graphs.hierarchy(e, start, "both").collect()} == {"leaf", "impl", "base", "below"}


def test_store(spark):
    tab = store.Table(spark, scratch_path(spark, "tab"))
    a = spark.createDataFrame([("k", 1, 1), ("l", 2, 1)], "key string, v int, at int")
    tab.commit(a)
    tab.commit(store.upsert(tab.read(), spark.createDataFrame([("k", 9, 1), ("m", 3, 0), ("l", 0, 0)], "key string, v int, at int"), ["key"], "at"))
    assert {r["key"]: r["v"] for r in tab.read().collect()} == {"k": 9, "l": 2, "m": 3}
    tab.restore()
    assert tab.read().count() == 2
    assert store.health(spark.createDataFrame([], "usr string")).first()["status"] == "empty"


def test_telemetry(spark):
    hold = lambda k, w, a: spark.range(1).select(telemetry.assertion_holds(F.lit(k), F.lit(w), F.lit(a).cast("string"))).first()[0]
    assert hold("any", None, "x") and hold("absent", None, None) and hold("exact", "AB", "ab") and hold("contains", "b", "ABC") and hold("regex", "^a.c$", "ABC") and hold("one_of", "a|b", "B")
    assert not hold("any", None, None) and not hold("exact", "a", None) and not hold("huh", "a", "a")
    steps = telemetry.aligned([{"tool": "a"}, {"tool": "b", "optional": True}, {"tool": "c"}, {"tool": "d"}], [{"tool": "look"}, {"tool": "a"}, {"tool": "x"}], True, frozenset({"look"}))
    assert [(s["tool_match"], s["skipped"], s["missing"], s["actual_tool"]) for s in steps] == [(True, False, False, "a"), (False, True, False, None), (False, False, False, "x"), (False, False, True, None)]
    fx = spark.createDataFrame([(1, "t", 0, {"p": "a"}), (2, "t", 1, {"p": "a", "q": "b"}), (3, "t", 2, {"p": "A", "q": "b"}), (4, "t", 3, {})], "fixture_id int, tool string, pos int, criteria map<string,string>")
    calls = spark.createDataFrame([(1, "t", {"p": "A", "q": "B"}), (2, "t", {"p": "a"}), (3, "u", {"p": "a"})], "call_id int, tool string, args map<string,string>")
    assert {r["call_id"]: r["fixture_id"] for r in telemetry.best_fixtures(calls, fx).collect()} == {1: 2, 2: 1}
    rec = spark.createDataFrame([(1, ["a", "b"], ["b", "c"])], "seq int, expected array<string>, called array<string>")
    assert tuple(telemetry.tool_differences(rec).first()) == (1, "a", "c")


SOURCE = """
namespace app { // class Ghost {}
class Base { public: virtual void run() = 0; };
struct Derived : public Base, private other::Mixin<int> {
  void run() override { helper(1); obj.call("x(y)"); }
};
using Alias = std::vector<int>;
typedef unsigned long Word;
int helper(int x) { return helper(x - 1); }
}
"""


def test_extract(spark):
    df = spark.createDataFrame([("a.h", SOURCE), ("b.h", "class {{{ broken ( } class Whole { };"), ("c.h", None)], "file string, content string")
    rows = [tuple(r) for r in extract.facts(df).collect()]
    facts = {(r[1], r[2], r[3]) for r in rows if r[0] == "a.h"}
    assert {("class", "Base", "app"), ("struct", "Derived", "app"), ("alias", "Alias", "app"), ("alias", "Word", "app"), ("function", "helper", "app"), ("call", "helper", "app::helper"), ("call", "helper", "app::Derived::run"), ("call", "obj.call", "app::Derived::run")} <= facts
    assert ("class", "Ghost", "app") not in facts and any(r[:3] == ("b.h", "class", "Whole") for r in rows)
    assert next(r[4] for r in rows if r[2] == "Derived") == "Base, other::Mixin<int>"


DEEP = """
namespace app::ui {
/// A base.
class Base { public: virtual void run() = 0; protected: static int count(); int size() const; };
template <typename T, int N> class Box final : public Base, private other::Mixin<T> {
public:
  Box(); ~Box() override;
  T get(int i) const { return helper<T>(i); }
  bool operator==(const Box &o) const;
  explicit operator bool() const;
};
template <> class Box<int, 3> : public Base {};
template <typename T> class Box<T*, 1> {};
template <typename T> using Vec = std::vector<T>;
typedef unsigned long Word;
typedef void (*Callback)(int);
using W2 = Word;
}
app::ui::Base *make_base(const std::string &s = "a;b{", int n = 3);
template <typename T> T maxi(T a, T b) {
  return other::pick<app::ui::Base>(a, b);
}
Box::Box() : a(1), b{2} { init(); }
static const char *names[] = {"a"};
int broken( } class Whole { };
"""


def test_extract_declarations():
    rows = [dict(zip(extract._FIELDS, r)) for r in extract.lexical("d.h", DEEP)]
    by = {(r["fact"], r["name"], ",".join(r["template_args"] or ())): r for r in rows}
    base, box = by[("class", "Base", "")], by[("class_template", "Box", "")]
    assert base["doc_comment"] == "/// A base." and base["usr"] == "c:@N@app@N@ui@S@Base" and (box["line"], box["end_line"], box["detail"]) == (5, 11, "Base, other::Mixin<T>")
    assert box["template_params"] == ["typename T", "int N"] and box["usr"] == "c:@N@app@N@ui@ST>2#T#T@Box"
    assert by[("class", "Box", "int,3")]["is_specialization"] and by[("partial_specialization", "Box", "T *,1")]["template_params"] == ["typename T"]
    run, size, count, get = (by[("function", n, "")] for n in ("run", "size", "count", "get"))
    assert run["is_pure_virtual"] and run["is_virtual"] and run["access"] == "public" and size["is_const"] and size["access"] == "protected" and count["is_static"] and get["return_type"] == "T" and get["is_definition"] and not run["is_definition"]
    assert by[("function", "~Box", "")]["is_virtual"] and ("function", "operator==", "") in by and ("function", "operator bool", "") in by and ("function", "Box::Box", "") in by
    assert by[("function", "make_base", "")]["return_type"] == "app::ui::Base *" and by[("function_template", "maxi", "")]["template_params"] == ["typename T"] and by[("function_template", "maxi", "")]["end_line"] == 22
    assert by[("alias", "W2", "")]["canonical"] == "unsigned long" and by[("alias", "Vec", "")]["template_params"] == ["typename T"] and by[("alias", "Callback", "")]["return_type"] == "typedef"
    call = by[("call", "other::pick", "app::ui::Base")]
    assert (call["scope"], call["line"], call["column_no"], call["canonical"]) == ("maxi", 21, 10, "app::ui::Base") and ("call", "init", "") in by and ("call", "helper", "T") in by
    assert ("class", "Whole", "") in by and not any(r["name"] == "names" for r in rows)


def test_extract_tries_again(spark):
    def bad(file, content):
        raise ValueError("no")
        yield

    df = spark.createDataFrame([("a.h", "class A {};")], "file string, content string")
    assert [r["fact"] for r in extract.facts(df, bad, extract.lexical).collect()] == ["class"] and [r["fact"] for r in extract.facts(df, bad).collect()] == ["error"]


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "third_party").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for p in ("src/a.cpp", "src/third_party/b.h", "src/c.txt", ".git/d.h"):
        (tmp_path / p).write_text('#include "x.h"\n# include <vector>\n')
    files = tables.source_files(spark, str(tmp_path))
    assert {(r["file"].replace(str(tmp_path), ""), r["is_project"]) for r in files.collect()} == {("/src/a.cpp", True), ("/src/third_party/b.h", False)}
    small = {r["file"].rsplit("/", 1)[-1]: (r["content"], r["error"]) for r in tables.source_files(spark, str(tmp_path), max_mb=0.00001).collect()}
    assert small["a.cpp"] == (None, "larger than 1e-05 MB") and all(r["content"] for r in tables.source_files(spark, str(tmp_path), max_mb=None).collect())
    assert {r["included"] for r in tables.include_lines(files).collect()} == {"x.h", "vector"}
    (tmp_path / "cc.json").write_text('[{"file": "a.c", "directory": "/d", "arguments": ["cc", "-Ii", "a.c"]}, {"directory": "/d"}, {"file": "/d/a.c", "directory": "/d", "arguments": ["cc", "-DX"]}]')
    cc = tables.compile_database(spark, str(tmp_path / "cc.json"))
    assert [(r["file"], r["arguments"]) for r in tables.latest_arguments(cc).collect()] == [("/d/a.c", ["-DX"])]
    assert tables.choose_sources(cc, files).first()[0] == "/d/a.c" and tables.choose_sources(None, files).count() == 2
    (tmp_path / "log.json").write_text('{"file_path": "a", "retry_count": 1}\nnot json\n')
    assert tables.json_lines(spark, str(tmp_path / "log.json"), "parse_errors").count() == 1
    assert tables.json_lines(spark, str(tmp_path / "log.json"), "parse_errors", keep_bad=True).cache().filter("_corrupt_record IS NOT NULL").count() == 1


def test_commands_as_text_count(spark):
    rows = [
        ("/a.c", "/d", None, ["cc", "-DA"], 1), ("/a.c", "/d", "cc -D'B C' -Ix\\ y -c a.c", None, 2), ("/b.c", "/d", "cc -DOLD b.c", None, 1), ("/b.c", "/d", None, ["cc", "-DNEW", "b.c"], 2),
        ("/c.c", "/d", "g++ -DC", None, 1), ("/c.c", "/d", "  ", None, 2), ("/e.c", "/d", None, None, 1),
    ]
    cc = spark.createDataFrame(rows, "file string, directory string, command string, arguments array<string>, position long")
    got = {r["file"]: r["arguments"] for r in tables.latest_arguments(cc, fallback=("-std=c++17",)).collect()}
    assert got == {"/a.c": ["-DB C", "-I/d/x y"], "/b.c": ["-DNEW"], "/c.c": ["-DC"], "/e.c": ["-std=c++17"]}


def test_definition_wins_prefers_richer(spark, data):
    base = rel.all_symbols(spark, data).limit(1)
    rows = base.withColumn("usr", F.lit("u"))
    a = rows.withColumns({"is_definition": F.lit(False), "base_classes": F.lit("A"), "line": F.lit(1)})
    b = rows.withColumns({"is_definition": F.lit(True), "base_classes": F.lit(None).cast("string"), "line": F.lit(2), "start_line": F.lit(1), "end_line": F.lit(9)})
    c = b.withColumns({"base_classes": F.lit("B"), "line": F.lit(3), "end_line": F.lit(2)})
    assert rel.definition_wins(a.unionByName(b)).first()["line"] == 2
    assert rel.definition_wins(a.unionByName(b).unionByName(c)).first()["line"] == 3


def test_search_scope_and_limits(spark, data):
    s = rel.symbols(spark, data)
    few = search.search_symbols(s, Criteria(max_results=3, project_only=False))
    assert few.count() == 3
    assert search.search_classes(s, Criteria("(((a+)+", project_only=False).safe()).count() == 0
