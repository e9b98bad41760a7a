"""Residue documents: listed cases of either kind."""

import pytest

from symtide.llm import residue as R

CASES = [
    "Content coming soon.", "TODO - limits\nTBD describe", "# View\n\n404 Not Found\nNothing matches the given address.\n\nBack to top", "Hi #{name},\n\nissue #{nr} in #{repo} was closed by #{who}.\n\nRegards,\n#{me}", "Skip to main content\n<h1>{{ a }}</h1>\n<ul>\n<li>{{ b }}</li>\n</ul>",
    "Please enable JavaScript to view this page.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "/**\n * ClassName.\n *\n * Write something about the class.\n *\n * @author your name here\n * @date YYYY-MM-DD\n */",
    "undefined\n\nnull\n\n[object Object]", "The class %(a)s lives in namespace %(b)s and derives from %(c)s.", "Seite nicht gefunden. Die Datei zu a/b.h existiert nicht mehr.", "Página no encontrada. El documento X no existe.", "Accès refusé : Foo", "xxxx xxxx\nxxxx xxxx",
    "Too many requests (9 in one minute). Slow down and retry.", "# <AUTHOR>\n\n<TITLE>", "页面不存在", "{{Title}}",
]
NOT = [
    "", "  \n ", "We log '503 Service Unavailable' with the retry counter.", "The layout test fills the label with lorem ipsum, since any long text will do.", '#include "a/b.h"', "auto x = std::array<int, 2>{{1, 2}};", "# Title\n\nThe page describes the cache.\n\n404 Not Found",
    "Users without JavaScript see the notice 'Please enable JavaScript', so the index was added.", "Write `${CMAKE_SOURCE_DIR}/include` instead of a fixed path; CMake fills it in at configure time.", "TODO: mention the lock order here. Apart from that the page is complete.",
    "a.cpp:3:4: error: 'x' was not declared in this scope", "Fixed in 3.2", "Die Klasse wird neu eingelesen.", "# Title", "Call open() once.",
]


def found(df):
    return {r["doc_id"] for r in R.residue_documents(df).collect()}


def test_cases(spark, clash):
    rows = [(i, t, "a") for i, t in enumerate(CASES)] + [(1000 + i, t, None) for i, t in enumerate(NOT)] + [(2000, None, "a"), (0, CASES[0], "b"), (3000, "word " * 100_000, "a"), (3001, "{{ x }}\n" * 20_000, None)]
    got = found(clash(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert [CASES[i] for i in range(len(CASES)) if i not in got] == []
    assert [NOT[i - 1000] for i in got if 1000 <= i < 2000] == [] and {3001} == {i for i in got if i >= 2000}


def test_unlisted_notices_need_to_recur(spark):
    odd = "Kindly contact us if the robot 7 was mistaken."
    docs = [(i, f"404 Not Found\n{odd.replace('7', str(i))}", f"s{i}") for i in range(3)]
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert R.judge(odd) == R.MAYBE and found(mk(docs)) == {0, 1, 2} and found(mk(docs[:2])) == set()
    assert found(mk([(i, odd, f"s{i}") for i in range(5)])) == set()


@pytest.mark.parametrize("odd", ["Kindly contact us if the robot 7 was mistaken.", "Leider ist dieser Bereich gerade geschlossen.", "Lo sentimos, esta zona no abre hoy.", "Désolé, cet espace est fermé.", "抱歉，这里今天不开放"])
def test_notices_known_by_company_count_alone(spark, odd):
    docs = [(i, f"404 Not Found\n{odd}", f"s{i}") for i in range(3)]
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert R.judge(odd) == R.MAYBE and found(mk([*docs, (10, odd, "s9")])) == {0, 1, 2, 10}
    assert found(mk([*docs[:2], (10, odd, "s9")])) == {0, 1}
    assert found(mk([*docs, (10, odd + "\nThe cache is read again.", "s9")])) == {0, 1, 2}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert R.residue_documents(none).count() == R.recurring_messages(none).count() == 0


@pytest.mark.parametrize("a, b", [("Try again in 5 seconds", "Try again in 90 seconds"), ("See a/b.h on 2024-01-02", "See c/d/e.cpp on 2023-11-30"), ("Moved FooBar", "Moved BazQux")])
def test_masks(a, b):
    assert R.masked(a) == R.masked(b)


def test_placeholders_in_capitals(spark):
    texts = ["<H1>%(ISSUE_NUMBER)S</H1>\n<P>%(MODULE)S</P>\n<UL>\n<LI>%(CLASS_NAME)S</LI>\n</UL>", "<UL>\n<LI>The parser keeps one table for each class.</LI>\n</UL>", "<UL>\n</UL>", "blah " * 500, "asdf " * 300 + "The index keeps its rows."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in R.residue_documents(df).collect()} == {0, 3}
