"""Functions paired with their documentation.

Method: a generalised LL parser (``gll``) reads function declarations; it starts
anew at every place where one may begin, so valid functions come out of broken
files whatever stands between them. The same parser tells commented-out code from
words: a line of a comment that parses as statements says nothing. Comments are cleaned of marks, tags and all
that says nothing, and sentence templates that the corpus repeats are found by
hash counts over all descriptions: a sentence is dropped when its template recurs and it smells of boilerplate
or never stands without a notice. What is left of a text must still say something, else the next text counts.

Defined results: null and blank signatures or names of other kinds give no pair;
the row that counts of a usr is a definition if there is one, ties go to the
largest row; doc_comment comes first, then brief, also where boilerplate is all that
doc_comment holds; repeated rows give one pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import blank, materialize
from .gll import Grammar, Parse

FUNCTION_KINDS = ("function", "method", "function_template")
#: Words that a description must have left, and the symbols from which on a template repeats.
LEAST_WORDS, REPEATED = 4, 20

# --- parsing --------------------------------------------------------------

_TOKEN = re.compile(r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<pre>^[ \t]*\#[^\n]*)|(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.']*)|(?P<op>::|->|\.\.\.|&&|[^\s\w])", re.S | re.M)
_TYPE_WORDS = frozenset("const volatile typename class struct enum unsigned signed long short".split())
_LEAD = frozenset("static inline virtual explicit constexpr friend extern consteval constinit mutable template".split())
_TRAIL = frozenset("const volatile noexcept override final".split())
#: What a keyword that no declaration has stands for among statements.
_STATEMENT = {w: kind for kind, words in {"ctl": "if for while switch catch", "else": "else do try", "ret": "return throw goto delete co_return co_await", "jump": "break continue", "case": "case default", "new": "new sizeof", "using": "using namespace typedef", "access": "public private protected"}.items() for w in words.split()}
_NEVER = frozenset(_STATEMENT)
_OPS = ("=", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "->", "&&", "?", ".")

_SHARED: Grammar = {
    "Type": [("Core", "Marks"), ("cv", "Type"), ("decltype", "(", "Expr", ")", "Marks")],
    "Core": [("Name",), ("Core", "cv"), ("cv",)],
    "Marks": [(), ("&", "Marks"), ("*", "Marks"), ("&&", "Marks"), ("cv", "Marks"), ("...",)],
    "Name": [("Seg",), ("Seg", "::", "Name"), ("::", "Name")],
    "Seg": [("id",), ("id", "Targs"), ("~", "id"), ("operator", "Op")],
    "Op": [("Any",), ("Any", "Any"), ("Any", "Any", "Any"), ("(", ")"), ("[", "]"), ("Type",), ("new",), ("ret",)],
    "Any": [(c,) for c in (*_OPS, ",") if c not in ("?", ".")],
    "Targs": [("<", ">"), ("<", "Tlist", ">")],
    "Tlist": [("Targ",), ("Targ", ",", "Tlist")],
    "Targ": [("Type",), ("Type", "Args"), ("num",), ("-", "num"), ("string",), ("Type", "id"), ("Type", "Init"), ("Type", "id", "Init"), ("lead", "Targs", "Type"), ("lead", "Targs", "Type", "id")],
    "Args": [("(", ")"), ("(", "Plist", ")")],
    "Plist": [("Param",), ("Param", ",", "Plist"), ("...",)],
    "Param": [("Type",), ("Type", "PName"), ("Type", "Init"), ("Type", "PName", "Init"), ("Type", "Args"), ("Type", "PName", "[", "Bound", "]"), ("Type", "(", "Ptr", "PName", ")", "Args"), ("Type", "(", "Ptr", ")", "Args"), ("Attr", "Param")],
    "Ptr": [("*",), ("&",), ("&&",)],
    "Bound": [(), ("Expr",)],
    "PName": [("id",)],
    "Init": [("=", "Expr")],
    "Expr": [("Post",), ("Ops", "Post"), ("Expr", "Ops", "Post"), ("Expr", "?", "Expr", ":", "Expr"), ("new", "Post"), ("cv", "Post")],
    "Ops": [("Op1",), ("Op1", "Op1"), ("Op1", "Op1", "Op1")],
    "Op1": [(c,) for c in _OPS if c not in ("->", "?", ".", "~")] + [("~",)],
    "Post": [("Name",), ("num",), ("string",), ("(", "Expr", ")"), ("Post", "Call"), ("Post", ".", "Name"), ("Post", "->", "Name"), ("Post", "[", "Expr", "]"), ("Post", "Twice"), ("Braces",), ("Post", "Braces"), ("[", "Bal", "]", "Bal", "{", "Bal", "}"), ("string", "Post"), ("trail", "Call"), ("decltype", "Call")],
    "Call": [("(", ")"), ("(", "Elist", ")")],
    "Elist": [("Expr",), ("Expr", ",", "Elist")],
    "Twice": [("+", "+"), ("-", "-")],
    "Braces": [("{", "}"), ("{", "Elist", "}")],
    "Quals": [(), ("Qual", "Quals")],
    "Qual": [("cv",), ("trail",), ("&",), ("&&",), ("trail", "(", "Expr", ")"), ("=", "num"), ("=", "id"), ("=", "case"), ("=", "ret"), ("->", "Type"), ("requires", "Clause"), ("Attr",), ("throw", "(", "Bal", ")")],
    "Clause": [("Post",), ("Clause", "&&", "Post"), ("Clause", "|", "|", "Post")],
    "Lead": [(), ("lead", "Lead"), ("lead", "Targs", "Lead"), ("lead", "(", "Expr", ")", "Lead"), ("Attr", "Lead"), ("requires", "Clause", "Lead"), ("alignas", "(", "Expr", ")", "Lead"), ("lead", "string", "Lead")],
    "Attr": [("[", "[", "Bal", "]", "]")],
    # Anything with its brackets in balance; what stands in it is of no interest.
    "Bal": [(), ("Loose", "Bal"), ("(", "Bal", ")", "Bal"), ("[", "Bal", "]", "Bal"), ("{", "Bal", "}", "Bal")],
    "Loose": [(c,) for c in (*_OPS, ",", ":", "::", ";", "...", "id", "num", "string", "cv", "lead", "trail", "operator", "decltype", "requires", "alignas", "throw", *sorted(set(_STATEMENT.values())))],
    "FName": [("Name",)],
}
#: A function as a source file has it, and as the index stores it (with or without a name).
SOURCE: Grammar = _SHARED | {
    "Fn": [("Lead", "Type", "FName", "Args", "Quals", "End"), ("lead", "Lead", "FName", "Args", "Quals", "End"), ("Attr", "Lead", "FName", "Args", "Quals", "End")],
    "End": [(";",), ("{",), (":",)],
}
#: A constructor or destructor, which has no type; only the name tells it from a call.
MAKER: Grammar = _SHARED | {"Fn": [("FName", "Args", "Quals", "End")], "End": SOURCE["End"]}
SIGNATURE: Grammar = _SHARED | {"Fn": [("Lead", "Type", "Args", "Quals"), ("Lead", "Type", "FName", "Args", "Quals"), ("Lead", "FName", "Args", "Quals")]}
#: Statements, whole or broken off at a brace, as commented-out code has them.
CODE: Grammar = _SHARED | {
    "Fn": [("Stmt",), ("Stmt", "Fn")],
    "Stmt": [("Expr", ";"), ("Decl", ";"), (";",), ("ctl", "(", "Head", ")"), ("else",), ("ret", "Expr", ";"), ("ret", ";"), ("jump", ";"), ("{",), ("}",), ("pre",), ("case", "Expr", ":"), ("case", ":"), ("access", ":"), ("using", "Bal", ";"), ("Lead", "Type", "FName", "Args", "Quals", "{"), ("Lead", "Type", "FName", "Args", "Quals", ";")],
    "Decl": [("Lead", "Type", "id"), ("Lead", "Type", "id", "Init"), ("Lead", "Type", "id", "Braces"), ("Lead", "Type", "id", "Call"), ("Lead", "Type", "id", "[", "Bound", "]")],
    "Head": [("Expr",), ("Decl",), ("Decl", ":", "Expr"), ("Part", ";", "Part", ";", "Part"), ("...",)],
    "Part": [(), ("Expr",), ("Decl",)],
}
_WANTED = frozenset({"FName", "PName", "Param", "Args"})
#: Heads of at most so many tokens are remembered by their categories; longer ones are parsed each time.
REMEMBERED = 120


_WORD_KIND = dict.fromkeys(_TRAIL, "trail") | dict.fromkeys(_TYPE_WORDS, "cv") | dict.fromkeys(_LEAD, "lead") | _STATEMENT | {w: w for w in ("operator", "decltype", "requires", "alignas", "throw")}


def tokens_of(text: str) -> list[tuple[str, str, int, int]]:
    """(category, text, from, to) of a C++ text; nothing is ever an error."""
    out = []
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m.group()
        if kind == "id":
            kind = _WORD_KIND.get(word, "id")
        elif kind == "op":
            kind = word
        out.append((kind, word, m.start(), m.end()))
    return out


class Heads:
    """Parses of token categories; equal sequences are parsed once."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.known = grammar, {}

    def parse(self, kinds: tuple[str, ...]) -> tuple[int, list[tuple[str, int, int]]] | None:
        """End of the longest head that starts ``kinds`` and its parts, or None."""
        if kinds in self.known:
            return self.known[kinds]
        if len(self.known) > 50_000:
            self.known.clear()
        got = self.known[kinds] = self._parse(list(kinds), 0, len(kinds))
        return got

    def parse_at(self, kinds: list[str], at: int, stop: int) -> tuple[int, list[tuple[str, int, int]]] | None:
        """``parse`` of ``kinds[at:stop]``; long stretches are neither copied nor remembered."""
        return self.parse(tuple(kinds[at:stop])) if stop - at <= REMEMBERED else self._parse(kinds, at, stop)

    def _parse(self, kinds: list[str], at: int, stop: int) -> tuple[int, list[tuple[str, int, int]]] | None:
        p = Parse(self.grammar, kinds, "Fn", at)
        ends = [e for e in p.accepted() if e <= stop]
        return (ends[-1] - at, [(k, a - at, b - at) for k, a, b in p.extract("Fn", at, ends[-1], _WANTED)]) if ends else None

    def whole(self, kinds: tuple[str, ...]) -> bool:
        """Does all of ``kinds`` parse?"""
        if kinds not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[kinds] = len(kinds) in Parse(self.grammar, list(kinds), "Fn").accepted()
        return self.known[kinds]


#: One parameter by itself.
PARAMETER: Grammar = _SHARED | {"Fn": [("Param",)]}


class Signatures:
    """Parses of stored signatures: the head and each parameter by themselves, so equal parts of different signatures are parsed once.

    Where the parameter list cannot be told by its brackets alone, or a part does not parse, the whole is parsed at once.
    """

    def __init__(self) -> None:
        self.heads, self.params = Heads(SIGNATURE), Heads(PARAMETER)

    def parts(self, signature: str) -> tuple[str | None, list[str], int]:
        """(name, parameter names, number of parameters) of a stored signature, as far as it parses."""
        toks = [t for t in tokens_of(signature) if t[0] not in ("comment", "pre")]
        got = self._by_part(toks)
        return signature_parts(toks, self.heads) if got is None else got

    def _by_part(self, toks: list[tuple]) -> tuple[str | None, list[str], int] | None:
        depth = angle = 0
        groups, commas, begin = [], [], 0
        for i, (k, *_) in enumerate(toks):
            if k in ("operator", "=", "->", "{", "[", "decltype", "requires", "lead", "string"):
                return None  # marks may mean other things than brackets there
            if k == "(":
                depth += 1
                if depth == 1 and angle == 0:
                    begin, commas = i, []
            elif k == ")":
                depth -= 1
                if depth == 0 and angle == 0:
                    groups.append((begin, i, commas))
            elif k == "<":
                angle += 1
            elif k == ">":
                angle -= 1
            elif k == "," and depth == 1 and angle == 0:
                commas.append(i)
            if depth < 0 or angle < 0:
                return None
        if depth or angle or len(groups) != 1:
            return None
        a, b, commas = groups[0]
        head = self.heads.parse(tuple(t[0] for t in toks[: a + 1]) + tuple(t[0] for t in toks[b:]))
        if head is None or head[0] != len(toks) - (b - a - 1):
            return None
        name = next(("".join(t[1] for t in toks[x:y]) for k, x, y in head[1] if k == "FName" and y <= a), None)
        names, n = [], 0
        for x, y in zip([a, *commas], [*commas, b]) if b > a + 1 else ():
            kinds = tuple(t[0] for t in toks[x + 1 : y])
            if kinds == ("...",):
                continue
            got = self.params.parse(kinds)
            if got is None or got[0] != len(kinds):
                return None
            n += 1
            nested = [(p, q) for k, p, q in got[1] if k == "Args"]
            names += [toks[x + 1 + p][1] for k, p, q in got[1] if k == "PName" and not any(u <= p and q <= v for u, v in nested)]
        return name, names, n


def signature_parts(signature: str | list[tuple], heads: Heads) -> tuple[str | None, list[str], int]:
    """``Signatures.parts`` of a signature or its tokens, parsed as a whole."""
    toks = [t for t in tokens_of(signature) if t[0] not in ("comment", "pre")] if isinstance(signature, str) else signature
    got = heads.parse(tuple(t[0] for t in toks))
    if got is None:
        return None, [], 0
    _, parts = got
    lists = sorted((p for p in parts if p[0] == "Args"), key=lambda p: (-p[2], p[1]))
    # Of the parameter lists the last and widest is the function's; others belong to function types.
    def inside(p: tuple[str, int, int], q: tuple[str, int, int]) -> bool:
        return q[1] <= p[1] and p[2] <= q[2]

    own = [p for p in parts if p[0] in ("Param", "PName") and inside(p, lists[0]) and not any(inside(p, q) and inside(q, lists[0]) for q in lists[1:])]
    name = next(("".join(t[1] for t in toks[a:b]) for k, a, b in parts if k == "FName"), None)
    return name, [toks[a][1] for k, a, b in own if k == "PName"], sum(p[0] == "Param" for p in own)


class _Stretches:
    """Where the stretch ends in which the head that begins at a token may stand.

    It ends with a ``;``, with a brace outside parentheses, or before a word that no head has. The
    end found last is kept, so the many starts of one long stretch do not each run through it.
    """

    def __init__(self, kinds: list[str]):
        self.kinds, self.at, self.stop = kinds, -1, -1
        self.depth = [0]
        for k in kinds:
            self.depth.append(self.depth[-1] + (k == "(") - (k == ")"))
        self.paren = [False] * (len(kinds) + 1)  # a parenthesis opens before the next ; or break
        self.brace = [len(kinds)] * (len(kinds) + 1)  # the next brace
        for i in range(len(kinds) - 1, -1, -1):
            k = kinds[i]
            self.brace[i] = i if k in ("{", "}") else self.brace[i + 1]
            self.paren[i] = k == "(" or k not in (";", "comment", "pre") and k not in _BREAKS and self.paren[i + 1]

    def end(self, i: int) -> int:
        """0 if no parenthesis opens in it."""
        if not self.paren[i]:
            return 0
        if not (self.at <= i < self.stop and (self.depth[i] == self.depth[self.at] or self.brace[i] >= self.stop)):
            level, braces, j = self.depth[i], 0, i
            while j < len(self.kinds):
                k = self.kinds[j]
                if k in ("comment", "pre") or k in _BREAKS:
                    break
                j += 1
                braces += (k == "{") - (k == "}")
                if k == ";" or k in ("{", "}") and (self.depth[j] <= level and not (k == "{" and self.kinds[j - 2] == "=") or braces < 0):
                    break
            self.at, self.stop = i, j
        return self.stop


def functions_of(text: str, heads: Heads, makers: Heads | None = None) -> Iterator[tuple[str, str, str, list[str]]]:
    """(name, head, comment, parameter names) of every function of a source text, however long its head is.

    Parsing restarts after each ``;``, brace, colon, comment and preprocessor line,
    so what is broken is skipped and what is whole comes out.
    """
    makers = makers or Heads(MAKER)
    toks = tokens_of(text)
    kinds = [t[0] for t in toks]
    stretches = _Stretches(kinds)
    classes = {toks[i + 1][1] for i in range(len(toks) - 1) if toks[i][1] in ("class", "struct") and kinds[i + 1] == "id"}
    start, comment = True, []
    i = 0
    while i < len(toks):
        kind = kinds[i]
        if kind == "comment":
            if not text[text.rfind("\n", 0, toks[i][2]) + 1 : toks[i][2]].strip():  # one behind code is about that code
                comment.append(toks[i][1])
                start = True
            i += 1
            continue
        if start and kind in _STARTS and (stop := stretches.end(i)):
            got = heads.parse_at(kinds, i, stop)
            glued = got is not None and any(k == "FName" and kinds[i + a] == "::" for k, a, b in got[1])  # A::A is no type A and a name ::A
            if got is None and (kind == "~" or toks[i][1] in classes or kinds[i + 1 : i + 2] == ["::"]) or glued:
                made = makers.parse_at(kinds, i, stop)
                if made is not None:
                    last = next("".join(t[1] for t in toks[i + a : i + b]) for k, a, b in made[1] if k == "FName").split("::")
                    if last[-1].lstrip("~") in classes or (len(last) > 1 and last[-1].lstrip("~") == last[-2]):
                        got = made  # else it is a call
            if got is not None:
                end, parts = got
                name = next("".join(t[1] for t in toks[i + a : i + b]) for k, a, b in parts if k == "FName")
                names = [toks[i + a][1] for k, a, b in parts if k == "PName"]
                yield name, text[toks[i][2] : toks[i + end - 2][3]], "\n".join(comment), names
                i, start, comment = i + end, True, []
                continue
        start = kind in (";", "{", "}", ":", "pre")
        comment = []
        i += 1


_STARTS = frozenset(("id", "cv", "lead", "::", "[", "~", "decltype", "alignas", "requires"))
_BREAKS = frozenset(set(_STATEMENT.values()) - {"new", "ret", "case"})


# --- what a comment says --------------------------------------------------

_MARK = re.compile(r"^\s*(?:/\*+!?<?|//[/!]*<?|\*+/|\*+(?=\s|$|[@\\]))\s?|\s*\*+/\s*$")
_TAG = re.compile(r"(?<![\w.])[@\\]([A-Za-z]+|[{}])(?:\[[^\]]*\])?")
_TAG_NAMES_ONE = frozenset("param tparam throw throws exception retval see sa copydoc copybrief copydetails ref link author authors since version date file name ingroup addtogroup defgroup class fn relates memberof headerfile".split())
_NOTICE = re.compile(
    r"(?i)\bcopyright\b|\(c\)\s*\d{4}|©|\ball rights reserved\b|\blicen[cs]ed? under\b|\bspdx-|\bsee (?:the )?licen[cs]e\b|\bpermission is hereby granted\b|\bwithout warrant(?:y|ies)\b"
    r"|\bauto(?:matically)?[- ]?generated\b|\b(?:was|is|been|file|code) (?:automatically )?generated (?:by|from|with|using)\b|\bdo not (?:edit|modify|change)\b|\b(?:manual )?changes? (?:will|would) be (?:lost|overwritten)\b|\bgenerated (?:file|code)\b.*\bdo not\b"
)
_SOFT = re.compile(r"(?i)\b(?:licen[cs]e|contributors|redistribut\w+|warrant\w+|boilerplate|regenerat\w+|all rights|internal use|trademark\w*)\b")
_TODO = re.compile(r"^\W*(?:(?i:todo|fixme|tbd)|XXX|HACK)\b(?:\([^)]*\))?[\s:,-]*(?:(?i:revisit|document(?: this| me)?|describe|write (?:me|this|docs?)|add (?:a |some )?(?:description|docs?|documentation|comments?)|fill (?:me |this )?in)\b[.!]?)?")
#: Without one of these no line can be a statement.
_CODE_MARK = re.compile(r"[;{}]|^\s*#")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_WORDS = re.compile(r"[^\W\d_][\w'’-]*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_FILL = frozenset("a an the this that of for to and function method class constructor destructor ctor dtor getter setter accessor helper default member operator wrapper is does".split())
_POINTER = re.compile(r"(?i)^\W*(?:(?:please )?(?:see|refer to|cf\.?|same as|as in|like|documented in|inherits?(?: documentation)? from)(?: also)?)\s+(?:above|below|there|the (?:base|parent|super) ?class|overridden \w+|[\w:~<>]*(?:::|\(|[a-z][A-Z])[\w:~<>()]*)[\s().,]*(?:above|below|for (?:more )?(?:details|documentation|information)|documentation)?\W*$")


def name_words(name: str | None) -> set[str]:
    """The words of an identifier, in lower case."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")}


@lru_cache(maxsize=1000)
def name_forms(name: str | None) -> frozenset[str]:
    """The words of an identifier in all their forms."""
    own = name_words(name)
    return frozenset(own).union(*((n + "s", n + "es", n + "ed", n + "d", n + "ing", n[:-1] + "ies", n[:-1] + "ied", n[:-1] + "ing", n + n[-1:] + "ing", n + n[-1:] + "ed") for n in own if len(n) > 1))


def count_words(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk + len(_WORDS.findall(_CJK.sub(" ", text) if cjk else text))


def _segments(line: str) -> Iterator[str]:
    """The texts between the tags of a line, without the names that belong to the tags."""
    line = re.sub(r"\{[@\\]\w+[^{}]*\}", " ", line)
    at, names = 0, 0
    for m in [*_TAG.finditer(line), None]:
        part = line[at : m.start() if m else len(line)]
        if names:
            part = re.sub(r"^\s*\S+", "", part)
        yield part
        if m:
            at, names = m.end(), m.group(1).lower() in _TAG_NAMES_ONE


_STATEMENTS = Heads(CODE)


def is_code(line: str) -> bool:
    """Does a line of a comment parse as C++ statements from end to end?"""
    if not _CODE_MARK.search(line):
        return False
    kinds = tuple(t[0] for t in tokens_of(line) if t[0] != "comment")
    return bool(kinds) and _STATEMENTS.whole(kinds)


def sentences(comment: str | None, name: str | None = None, params: tuple[str, ...] = (), code=is_code) -> tuple[list[str], bool]:
    """What a comment says of its own, and whether a notice stands beside it."""
    if not comment or not comment.strip():
        return [], False
    own, kept, beside = name_forms(name) | _FILL, [], False
    for raw in re.split(r"\r\n|\r|\n", comment):
        line = _MARK.sub("", _MARK.sub("", raw)).strip()
        if not any(c.isalnum() for c in line) and not re.search(r"[@\\][{}]", line):
            continue
        if code(line):
            continue
        for part in _segments(line):
            for s in _SENTENCES.split(part):
                s = _TODO.sub("", s.strip()).strip()
                words = _WORDS.findall(s)
                if not words:
                    continue
                if _NOTICE.search(s):
                    beside = True
                    continue
                if _POINTER.match(s):
                    continue
                if all(w.lower() in own or w in params for w in words):
                    continue
                kept.append(s)
    return kept, beside


def description(comment: str | None, name: str | None = None, params: tuple[str, ...] = (), code=is_code) -> str:
    """What a comment says of its own as one text; empty if it says nothing."""
    text = " ".join(sentences(comment, name, params, code)[0])
    return text if count_words(text) >= LEAST_WORDS else ""


def template_of(text: str, name: str | None) -> tuple[int, bool, bool]:
    """A hash of a sentence with numbers and the symbol's own words masked, whether what is left smells of boilerplate, and whether any word was its own."""
    own = name_forms(name) - _FILL
    words = ["_" if w in own else w for w in re.findall(r"\w+", re.sub(r"\d+", "0", text).lower())]
    masked = " ".join(words)
    return int.from_bytes(hashlib.blake2b(masked.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True), bool(_SOFT.search(masked)), "_" in words


def said_of(comments: tuple[str | None, ...], name: str | None, params: tuple[str, ...], shown: str | None = None) -> list[tuple]:
    """The sentences of a symbol's comments (place, text, words, template, soft, beside, first); none if no comment says something.

    place: which comment it is; beside: a notice stands in it too, and the sentence has no word of the symbol; first: the symbol's first sentence of its template; ``shown`` is the name whose words are masked, if not ``name``.
    """
    out, seen, enough = [], set(), False
    for place, comment in enumerate(comments):
        kept, beside = sentences(comment, name, params)
        n = 0
        for s in kept:
            template, soft, named = template_of(s, shown or name)
            out.append((place, s, count_words(s), template, soft, beside and not named, template not in seen))
            seen.add(template)
            n += out[-1][2]
        enough = enough or n >= LEAST_WORDS
    return out if enough else []


# --- operators ------------------------------------------------------------

_SAID = "said array<struct<place int, text string, words int, template long, soft boolean, beside boolean, first boolean>>"
_PAIR = f"usr string, code string, qualified_name string, {_SAID}"


def _drop_repeated(pairs: DataFrame, key: list[str], repeated: int) -> DataFrame:
    """``pairs`` (unique by ``key``) with a description in place of ``said``: the first comment that says something without repeated boilerplate.

    A template that ``repeated`` symbols share, counted over all sentences, is boilerplate if it smells of it, or if every
    comment that holds it holds a notice too and it names no symbol. Recurrence alone makes none, as valid sentences recur as widely.
    """
    pairs = materialize(pairs, "pairs")  # parsed once, read several times
    each = pairs.select(*key, F.explode("said").alias("x")).select(*key, "x.*")
    counts = each.groupBy("template").agg(F.count_if("first").alias("n"), F.bool_or("soft").alias("smells"), F.bool_and("beside").alias("always_beside"))
    many = counts.filter((F.col("n") >= repeated) & (F.col("smells") | F.col("always_beside"))).select("template")
    gone = each.join(many, "template", "left_semi").groupBy(*key).agg(F.collect_set("template").alias("gone"))
    met = pairs.join(gone, key, "left").withColumn("said", F.when(F.col("gone").isNull(), F.col("said")).otherwise(F.filter("said", lambda x: ~F.array_contains("gone", x["template"]))))

    def text(place: int) -> Column:
        own = F.filter("said", lambda x: x["place"] == place)
        return F.when(F.aggregate(own, F.lit(0), lambda n, x: n + x["words"]) >= LEAST_WORDS, F.array_join(F.transform(own, lambda x: x["text"]), " "))

    return met.withColumn("description", F.coalesce(text(0), text(1))).filter(F.col("description").isNotNull()).drop("said", "gone")


def symbol_pairs(symbols: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """(usr, code, qualified_name, description) of every function symbol that is documented."""
    rows = (
        symbols.filter(F.col("usr").isNotNull())
        .groupBy("usr")
        .agg(F.max(F.struct(F.coalesce("is_definition", F.lit(False)).alias("d"), *(F.col(c) for c in ("kind", "name", "qualified_name", "signature", "doc_comment", "brief")))).alias("s"))
        .select("usr", "s.*")
        .filter(F.col("kind").isin(*FUNCTION_KINDS) & ~blank(F.col("signature")) & ~(blank(F.col("doc_comment")) & blank(F.col("brief"))))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signatures = Signatures()
        for b in batches:
            out = []
            for usr, name, qn, sig, doc, brief in zip(b["usr"], b["name"], b["qualified_name"], b["signature"], b["doc_comment"], b["brief"]):
                _, params, _ = signatures.parts(sig)
                if said := said_of((doc, brief), name, tuple(params)):
                    out.append((usr, sig, qn, said))
            yield pd.DataFrame(out, columns=["usr", "code", "qualified_name", "said"])

    pairs = rows.select("usr", "name", "qualified_name", "signature", "doc_comment", "brief").mapInPandas(run, _PAIR)
    return _drop_repeated(pairs, ["usr"], repeated).select("usr", "code", "qualified_name", "description")


def source_pairs(documents: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """(doc_id, pos, function_name, code, description) of the documented functions of source texts.

    Every text that holds C++ counts, whatever its kind says; a comment belongs to
    the function right below it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, makers = Heads(SOURCE), Heads(MAKER)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                for pos, (name, head, comment, params) in enumerate(functions_of(text, heads, makers)):
                    if said := said_of((comment,), name.rpartition("::")[2], tuple(params), name):
                        out.append((doc, pos, name, head, said))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "function_name", "code", "said"])

    texts = documents.select("doc_id", "text").filter(F.col("text").contains("(") & F.col("text").rlike(r"//|/\*"))
    pairs = texts.mapInPandas(run, f"doc_id long, pos int, function_name string, code string, {_SAID}")
    return _drop_repeated(pairs, ["doc_id", "pos"], repeated)
