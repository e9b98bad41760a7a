"""Function heads, what comments say, and the pairs of both."""

import pytest

from symtide.llm import docpairs as D
from symtide.llm.gll import Parse

SAYS = [
    "/** Opens the file and returns its handle. */", "// @param limit upper bound for the rows of a table", "/// \\brief Not reentrant; hold the lock first.", "/* TODO: revisit\n * Walks the graph once and hands every node on. */", "//! Generated sources skip this call because the hash is unchanged.",
    "/// See the notes on the cache: the old unit must come first.", "/** @return number of nodes left, or -1 on failure */", "// 返回缓存中的条目数量", "/** TODO: revisit Liefert die Anzahl der offenen Einträge. @return */", "/* Copyright (c) 2020 X. All rights reserved.\n * Keeps at most ten entries in memory. */",
]
SILENT = [
    None, "", "  ", "/** */", "//------", "// TODO", "/// FIXME: document", "/** @param n @return */", "/** @brief getThing method */", "// Gets the thing .", "/** Gets the things. */", "/// @copydoc A::getThing", "/// {@inheritDoc}", "//! \\sa A::getThing", "// see above",
    "// if (a(x)) { return b; }\n// c(x, 0);", "/* int t = f(a); g += t; h(b); */", "/// This file was generated by gen 3.2, do not edit it by hand.", "// Copyright (c) 2014 the X contributors. All rights reserved.\n// Licensed under the terms found in the LICENSE file.", "// n/a", "// ok", "/** @{ */", "// Internal use only.", "-", "/**\n * .\n */",
]


@pytest.mark.parametrize("text", SAYS)
def test_says_something(text):
    assert D.description(text, "getThing", ("n",))


@pytest.mark.parametrize("text", SILENT)
def test_says_nothing(text):
    assert D.description(text, "getThing", ("n",)) == ""


def test_long_comment():
    assert len(D.description("/// " + "word " * 50_000, "f")) > 200_000


def test_gll_handles_left_recursion_and_ambiguity():
    g = {"E": [("E", "+", "E"), ("E", "*"), ("x",)]}
    assert Parse(g, list("x+x+x*"), "E").accepted() == [1, 3, 5, 6]
    assert Parse({"A": [("A", "A"), ("a",), ()]}, list("aaa"), "A").accepted() == [0, 1, 2, 3]
    assert Parse(g, list("+x"), "E").accepted() == []


def test_signatures():
    h = D.Heads(D.SIGNATURE)
    assert D.signature_parts("double (std::function<void (int)>, bool) const", h)[2] == 2
    assert D.signature_parts("std::map<int, std::vector<int>> a::B<T>::f(const std::string & x, int y = 3) const noexcept", h) == ("a::B<T>::f", ["x", "y"], 2)
    assert D.signature_parts("bool operator==(const A & o)", h)[0] == "operator==" and D.signature_parts("%% broken", h) == (None, [], 0) and D.signature_parts("", h) == (None, [], 0)


@pytest.mark.parametrize(
    "text",
    ["double (std::function<void (int)>, bool) const", "void ()", "int (const char * a, ...)", "T a::B<x, y>::f(T lo, std::map<int, A<B>> m, int) const noexcept", "void (void (*cb)(int n), int k[3])", "%% broken", "int (", "int (a, , b)", "auto f(int x = 1 + 2)", "bool operator()(int x, int y) const", "void (a < b, c > d)", "int f(unsigned long n, const volatile Foo & x) &&", "", "x"],
)
def test_signatures_by_part_and_whole_agree(text):
    assert D.Signatures().parts(text) == D.signature_parts(text, D.Heads(D.SIGNATURE))


BROKEN = """
#include <x>
/// Reads all of the pending rows.
std::vector<int> readRows(std::istream & in, int n)
{
    if (n) { lost(n;  // unbalanced
/** Counts what the index holds now. */
static int countAll() const noexcept;
call(x, 0);
auto t = std::make_shared<A>(1);
// trivial
void f();
template <T> @@ %% $
/* Closes every open handle at once. */
virtual void a::B::closeAll(std::function<void (int)> cb = nullptr) override {
"""


def test_functions_come_out_of_broken_files(spark, clash):
    got = {n: (c, p) for n, _, c, p in D.functions_of(BROKEN, D.Heads(D.SOURCE))}
    assert set(got) == {"readRows", "countAll", "f", "a::B::closeAll"} and got["readRows"][1] == ["in", "n"]
    df = clash(spark.createDataFrame([(1, BROKEN), (2, None), (3, ""), (4, "no code (here) // at all")], "doc_id long, text string"))
    assert {(r["doc_id"], r["function_name"], r["description"]) for r in D.source_pairs(df).collect()} == {
        (1, "readRows", "Reads all of the pending rows."), (1, "countAll", "Counts what the index holds now."), (1, "a::B::closeAll", "Closes every open handle at once."),
    }


WHOLE = """
/// Takes very many parameters and says so here.
int many(%s);
/** Adds three to one by its default value. */
void sums(int a, int b = 1 + 2, std::vector<int> v = {1, 2});
/// Tells whether this is so or not.
[[nodiscard]] bool ok() const;
// The type of what y gives back here.
auto given() const -> decltype(x.y());
/// Keeps a value between two given bounds.
template <typename T, int N = 3> requires std::integral<T>
T clamp(T lo, T hi = T{}) noexcept(noexcept(lo + hi));
class Widget { public:
  /// Builds a widget out of its name.
  explicit Widget(const char *name);
  /// Builds one from nothing at all here.
  Widget();
  /// Frees what the widget holds, but not its children.
  ~Widget();
};
/// Starts with one and counts on from there.
Widget::Widget() : a(1) {}
/// This is about a call and no function.
call(x);
/// And this is about a variable and its value.
auto layout = std::make_shared<Source>(5);
""" % ", ".join(f"const std::string &p{i} = \"x\"" for i in range(60))


def test_all_forms_of_functions(spark):
    got = [(n, c) for n, _, c, _ in D.functions_of(WHOLE, D.Heads(D.SOURCE)) if c]
    assert [n for n, _ in got] == ["many", "sums", "ok", "given", "clamp", "Widget", "Widget", "~Widget", "Widget::Widget"]
    df = spark.createDataFrame([(1, WHOLE)], "doc_id long, text string")
    assert D.source_pairs(df).count() == 9


def test_broken_text_takes_time_in_proportion():
    import time

    took = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        list(D.functions_of("see (a: b " * n, D.Heads(D.SOURCE)))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


CODE = ["int tmp = submit(a); gauge += tmp; resize(b);", "if (trim(x)) { return clock; }", "open(x, 0);", "#include <x>", "for (int i = 0; i < n; ++i) {", "return a ? b : c->d[2];", "std::vector<int> v{1, 2};", "delete p;", "x++;", "auto f = [&](int x) { return x; };", "else {"]
WORDS = ["Walks the tree; then returns.", "Returns {a, b} pairs", "foo", "See the docs;", "{@inheritDoc}", "@{", "Note: it is slow; use the other one;", "returns the number of rows that are left;"]


def test_the_parser_tells_code_from_words():
    assert all(map(D.is_code, CODE)) and not any(map(D.is_code, WORDS))
    kept = lambda t: t == ""
    assert kept(D.description("/// " + CODE[0], "f")) and D.description("/// " + CODE[0], "f", code=lambda _: False)


SYMBOL = "usr string, kind string, name string, qualified_name string, signature string, doc_comment string, brief string, is_definition boolean"


def test_symbols(spark, clash):
    doc = "/// Opens the file and reads it."
    rows = [
        ("1", "function", "f", "f", "void ()", doc, None, True), ("1", "function", "f", "f", "void ()", None, None, False), ("2", "method", "g", "A::g", " ", doc, None, True), ("3", "class", "A", "A", "void ()", doc, None, True),
        ("4", "method", "h", "A::h", "int (", "/** */", "Says a thing of its own.", None), ("5", "function_template", "k", "k", "T (T)", None, "TODO", True), ("6", "function", None, None, "void ()", doc, None, None), (None, "function", "z", "z", "void ()", doc, None, True),
        ("7", "function", "f7", "f7", "void ()", None, doc, True), ("7", "function", "f7", "f7", "void ()", None, doc, True),
    ]
    df = clash(spark.createDataFrame(rows, SYMBOL))
    assert sorted(r["usr"] for r in D.symbol_pairs(df).collect()) == ["1", "4", "6", "7"]
    assert D.symbol_pairs(df.limit(0)).count() == 0


def test_repeated_boilerplate_goes(spark):
    rows = [(str(i), "function", f"f{i}", "f", "void ()", "/// Boilerplate of the contributors goes here.", None, True) for i in range(25)] + [("x", "function", "g", "g", "void ()", "/// Checks the license of one plugin file.", None, True)]
    assert [r["usr"] for r in D.symbol_pairs(spark.createDataFrame(rows, SYMBOL)).collect()] == ["x"]


def test_repeated_boilerplate_beside_own_words(spark):
    """Sentence by sentence: what is left counts, then the brief; the symbol's own words do not smell; what only notices have beside them goes."""
    plate, own = "/// Boilerplate of the contributors goes here.", "Opens the file and reads it."
    licence = "/// Copyright (c) 2014 the X authors.\n/// Provided as is and for any purpose whatsoever.\n"
    # name, doc_comment, brief and what must come out
    cases = {
        "mixed": ("open", f"{plate} {own}", None, own),
        "short": ("open", f"{plate} Rather slow.", None, None),
        "brief": ("open", plate, own, own),
        "both": ("open", plate, plate, None),
        "notice": ("open", licence, None, None),
        "beside": ("close", f"{licence}/// Closes every handle at once.", None, "Closes every handle at once."),
        "named": ("checkLicense", "/// Checks the license before a plugin starts.", None, "Checks the license before a plugin starts."),
        "recurs": ("open", "/// Must be called by the main thread.", None, "Must be called by the main thread."),
    }
    rows = [(f"{k}{i}", "function", name, "f", "void ()", doc, brief, True) for k, (name, doc, brief, _) in cases.items() for i in range(25)]
    got = D.symbol_pairs(spark.createDataFrame(rows, SYMBOL)).collect()
    assert {r["usr"]: r["description"] for r in got} == {f"{k}{i}": c[3] for k, c in cases.items() for i in range(25) if c[3]} and len(got) == 125
