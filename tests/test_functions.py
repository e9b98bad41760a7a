"""Column functions and text rules against listed cases."""

import re

import pytest
from pyspark.sql import functions as F

from symtide.functions import arguments as A
from symtide.functions import naming as N
from symtide.functions import patterns as P
from symtide.functions import usr as U


@pytest.mark.parametrize("p, kind", [("::A", "exact"), ("A.*", "regex"), ("a::B", "suffix"), ("A", "unqualified"), ("", "unqualified"), ("a::.*", "regex"), ("::a.*", "exact")])
def test_pattern_type(p, kind):
    assert P.pattern_type(p) == kind


MATCHES = [
    ("app::ui::View", "view", True), ("app::ui::View", "ui::View", True), ("app::ui::View", "UI::VIEW", True), ("app::ui::View", "pui::View", False), ("app::ui::View", "::app::ui::View", True),
    ("app::ui::View", "::app::ui::view", False), ("app::ui::View", "::View", False), ("View", "::View", True), ("app::ui::View", "app::.*", True), ("app::ui::View", "ui::.*", False), ("app::ui::View", "", True),
    ("É", "é", True), ("x\n", "x.?", False), ("f(int * )", "::f(int*)", True), ("a::b", "a::(b", False), ("View", "(?P<n>V).*", True),
    ("VV", "(?P<n>V)(?P=n)", True), ("View", "(?<n>V).*", False), ("View", "V(?i:I)ew\\Z", True), ("a[b", "a[[]b", True), ("a]b", "a[]]b", True), ("View", "V{2,1}", False), ("a&&b", "a[&&x]+b", True),
]


def test_matching(spark):
    for name, p, want in MATCHES:
        got = spark.range(1).select(P.matches_qualified(F.lit(name), p)).first()[0]
        assert got is want, (name, p)


def test_namespace_and_files(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.in_namespace(F.lit("a::b"), "b")) and not one(P.in_namespace(F.lit("a::xb"), "b")) and one(P.in_namespace(F.lit(None).cast("string"), "")) and not one(P.in_namespace(F.lit("A"), "a"))
    assert one(P.matches_glob(F.lit("/r/src/a/b.h"), "*.h")) and one(P.matches_glob(F.lit("/r/src/b.h"), "src/*.h", "/r")) and not one(P.matches_glob(F.lit("/r/src/b.hpp"), "src/*.h"))
    assert one(P.matches_glob(F.lit("/r/b1.h"), "b[0-9].?")) and not one(P.matches_glob(F.lit("/r/bx.h"), "b[!a-z].h"))
    assert one(P.at_path(F.lit("/x/Foo.h"), "Foo.h")) and not one(P.at_path(F.lit("/x/BarFoo.h"), "Foo.h")) and one(P.at_path(F.lit("/x/BarFoo.h"), "Foo.h", False))
    assert one(N.project_file(F.lit("/r/a/b.h"), "/r", ("dep",))) and not one(N.project_file(F.lit("/r/a/dep/b.h"), "/r", ("dep",)))
    assert one(N.skipped_file(F.lit("/r/.git/b.h"), "/r", (".git",))) and not one(N.skipped_file(F.lit("/r/a/.git/b.h"), "/r", (".git",))) and one(N.skipped_file(F.lit("/q/b.h"), "/r", ()))


@pytest.mark.parametrize("p, why", [("(a+)+", "quantified group"), ("(a|b)*", "alternatives"), ("a" * 1001, "longer"), ("a+b+c+d+e+f+g+h+i+j+k+", "complexity"), ("(", "not an expression")])
def test_unsafe(p, why):
    assert why in P.unsafe_because(p) and P.safe(p) == re.escape(p)


def test_safe_and_complexity(spark):
    for p in ("foo.*", "(a(b))", "x|y|z", "(a+)+", "(a|b)*", "[a-z]{2}"):
        assert spark.range(1).select(P.complexity_column(F.lit(p))).first()[0] == P.complexity(p)
    assert P.safe("get.*") == "get.*"
    assert P.unsafe_because("([a+]b)+") is None and P.unsafe_because(r"(\(a+\))*") and P.unsafe_because("((a|b))*") and P.complexity("(a+)+") == 54


LINT = [("Foo\\\\.*", True, False, True), ("Foo\\.", True, False, True), ("Foo\\.*", False, False, True), ("^Foo", False, True, True), ("[^a]Foo^", False, False, False), ("Foo$", False, True, True), ("I[A-Z]", False, False, True), ("getValue.", False, False, False)]


def test_lint(spark):
    for p, escapes, anchors, short in LINT:
        assert (P.has_double_escapes(p), P.has_anchors(p), P.is_short_regex(p)) == (escapes, anchors, short), p
        got = spark.range(1).select(*(v.alias(k) for k, v in P.pattern_lint(F.lit(p)).items())).first()
        assert tuple(got) == (escapes, anchors, short), p


def test_signatures():
    assert P.looks_like_signature("void f(int)") and P.looks_like_signature("const Foo") and not P.looks_like_signature("intern") and not P.looks_like_signature("class")
    assert P.identifier_of("void a::f(int x)") == "a::f" and P.identifier_of("const IConfig &") == "IConfig" and P.identifier_of("()") is None
    assert U.parameter_text("void f(std::function<int (int)> a) const") == "std::function<int (int)> a" and U.qualifier_text("void f() const noexcept") == " const noexcept" and U.parameter_text("int x") == ""


@pytest.mark.parametrize(
    "usr, name",
    [
        ("c:@N@app@S@Foo@F@bar#i#", "app::Foo::bar"), ("c:@S@Box>#I", "Box<unsigned int>"), ("c:@S@Box>#$@N@a@S@B", "Box<a::B>"), ("c:@ST>1#T@Container", "Container"), ("c:@SP>1#T@Pair>#*t0.0", "Pair<T *>"),
        ("c:@N@ns@FT@>1#Tmax#t0.0#S0_#S0_#", "ns::max"), ("c:@F@free#", "free"), ("c:@S@V>#&1c", "V<const char &>"), ("c:@F@foo#$@N@std@S@string#i#", "foo"), ("c:@N@a@S@B@F@operator->#*#d#1", "a::B::operator->"), ("c:@S@A>#I#*b@F@f#v#", "A<unsigned int, bool *>::f"),
        ("c:@S@N>#VI4#c", "N<unsigned int, char>"), ("c:@N@a@ST>2#T#NI@Box@F@f#", "a::Box::f"), ("c:x.cpp@12@F@local#", "local"), ("c:@N@a@aN@F@f#", "a::f"), ("c:@S@B>#&&3t0.1", "B<const volatile U &&>"),
        ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_usr(usr, name):
    assert U.display_name(usr) == name


def test_template_arguments():
    assert U.arguments_of("A<std::pair<int, char>, B<C>>") == ["std::pair<int, char>", "B<C>"] and U.arguments_of("A") == [] and U.split_arguments("f(int, char), x") == ["f(int, char)", "x"]


def test_arguments(spark):
    assert A.useful(["/usr/bin/g++", "-c", "-I", "inc", "-o", "x.o", "a.CC", "-DX"]) == ["-I", "inc", "-DX"]
    assert A.useful([]) == A.useful(None) == []
    assert A.absolute_includes(["-I", "inc", "-Isub", "-isystem", "../s", "-I/abs"], "/w/d") == ["-I", "/w/d/inc", "-I/w/d/sub", "-isystem", "/w/s", "-I/abs"]
    rules = [
        {"type": "exact_match", "patterns": ["-g"]}, {"type": "prefix_match", "patterns": ["-W"]}, {"type": "flag_with_optional_value", "pattern": "-f"}, {"type": "xclang_sequence", "sequence": ["-Xclang", "-include", "-Xclang", "<arg>"]},
        {"type": "xclang_conditional_sequence", "sequence": ["-Xclang", "<arg>"], "condition": {"arg_index": 0, "contains": ["pch"]}}, {"type": "xclang_option_with_value", "patterns": ["-opt"]}, {"type": "unknown"},
    ]
    assert A.sanitized(["-g", "-Wall", "-f", "v", "-f", "-x", "-Xclang", "-include", "-Xclang", "a.h", "-Xclang", "-PCH-through", "-Xclang", "-opt", "v", "-Xclang", "-other"], rules) == ["-x", "-Xclang", "-other"]
    df = spark.createDataFrame([(["g++", "-I", "i", "-g"], "/d"), (None, "/d")], "a array<string>, d string")
    assert [r[0] for r in df.select(A.clean_arguments(F.col("a"), F.col("d"), rules)).collect()] == [["-I", "/d/i"], None]


def test_prototypes(spark):
    cols = "signature string, parent_class string, access string, is_pure_virtual boolean, is_virtual boolean, is_static boolean, name string, qualified_name string"
    rows = [
        ("void f(int) const", "a::B", "public", True, True, None, "f", "a::B::f"), ("void f()", None, "public", None, None, True, "f", "f"), ("int (int)", "B", "private", None, True, None, "g", "B::g"), (None, "B", "public", None, None, None, "h", "B::h"),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(N.function_prototype()).collect()]
    assert got == ["public virtual void a::B::f(int) const = 0", "static void f()", "private virtual int (int)", None]
    one = lambda c: spark.range(1).select(c).first()[0]
    params = F.array(F.struct(F.lit("T").alias("name"), F.lit("type").alias("kind")), F.struct(F.lit("N").alias("name"), F.lit("value").alias("kind")))
    assert one(N.class_prototype(F.lit("a::B"), F.lit("class_template"), F.array(F.lit("X"), F.lit("Y")), params)) == "template<typename T, N> class a::B : X, Y"
    assert one(N.simple_name(F.lit("a::B<int>"))) == "B" and one(N.simple_name(F.lit("a::operator<"))) == "operator<" and one(N.namespace_of(F.lit("a::b::c"))) == "a::b"
    assert one(N.brief_of(F.lit("/**\n * @param x\n * Says this.\n */"))) == "Says this." and one(N.brief_of(F.lit("/// @brief That.\n/// more"))) == "That." and len(one(N.doc_text(F.lit("x" * 5000)))) == 4000
