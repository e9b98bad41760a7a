"""Facts from C++ texts by reading declarations: classes, templates, functions, aliases and calls.

This is no compiler: it reads declarations as they stand, without includes, macros
or overload resolution. A real front end plugs in as any function of the same shape
(``Extractor``); records that one has made already are read by ``tables.read``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (file, content) to rows of FACTS.
Extractor = Callable[[str, str], Iterator[tuple]]
FACTS = (
    "file string, fact string, name string, scope string, detail string, line int, is_definition boolean, column_no int, end_line int, access string, return_type string, is_virtual boolean, is_pure_virtual boolean, "
    "is_const boolean, is_static boolean, template_params array<string>, template_args array<string>, is_specialization boolean, doc_comment string, canonical string, usr string"
)
_FIELDS = [c.split()[0] for c in FACTS.split(", ")]

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pre>^[ \t]*\#(?:[^\n\\]|\\.)*)|(?P<string>(?:u8|[uUL])?R\"(?P<d>[^()\s\\]{0,16})\(.*?\)(?P=d)\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<word>[^\W\d]\w*)|(?P<num>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<op>::|->|\.\.\.|&&|[^\s\w])",
    re.S | re.M,
)
_NO_CALL = frozenset("if for while switch return sizeof catch new delete throw else do alignof decltype static_assert operator noexcept alignas typeid co_return co_await co_yield case goto".split())
_SPECIFIERS = frozenset("static virtual inline explicit constexpr consteval constinit friend extern mutable thread_local register typename".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Reader:
    """One pass over the tokens of a text with a stack of open scopes."""

    def __init__(self, file: str, content: str):
        self.file, self.text, self.rows = file, content, []
        self.toks: list[tuple[str, str, int]] = []
        self.docs: dict[int, str] = {}  # comments right above a token
        self.starts = [0] + [m.end() for m in re.finditer("\n", content)]
        above: list[str] = []
        for m in _TOKEN.finditer(content):
            if m.lastgroup == "comment" or m["comment"]:
                own = not content[content.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
                above = above + [m["comment"]] if own else above
            elif m["pre"] is None:
                kind = "word" if m["word"] else "num" if m["num"] else "string" if m["string"] else "op"
                if above:
                    self.docs[len(self.toks)] = "\n".join(above)
                    above = []
                self.toks.append((kind, m.group(), m.start()))
            else:
                above = []
        self.i = 0
        self.scopes: list[dict] = []
        self.aliases: dict[str, str] = {}
        self.classes: set[str] = set()

    # --- tokens
    def at(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if 0 <= self.i + k < len(self.toks) else ""

    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k][0] if 0 <= self.i + k < len(self.toks) else ""

    def place(self, i: int) -> tuple[int, int]:
        """Line and column, from 1, of token ``i``."""
        from bisect import bisect_right

        off = self.toks[min(i, len(self.toks) - 1)][2] if self.toks else 0
        line = bisect_right(self.starts, off)
        return line, off - self.starts[line - 1] + 1

    def said(self, a: int, b: int) -> str:
        """Tokens ``a`` to ``b`` as C++ is usually spaced."""
        out = ""
        for k, w, _ in self.toks[a:b]:
            glue = not out or w in (",", ")", "(", "::", ">", "<", "[", "]", ";", ".", "->") or out.endswith(("::", "(", "<", "~", "[", ".", "->"))
            out += w if glue and not (k == "word" and out.endswith((",", ">"))) else " " + w
        return out

    def closing(self, i: int) -> int:
        """The token that closes the bracket at ``i``, or the end."""
        depth = 0
        for j in range(i, len(self.toks)):
            w = self.toks[j][1]
            depth += (w in _OPEN) - (w in _CLOSE)
            if depth == 0:
                return j
        return len(self.toks)

    def angle(self, i: int) -> int:
        """The ``>`` that closes the ``<`` at ``i``, or -1 if it is a comparison."""
        depth, j = 0, i
        while j < len(self.toks):
            w = self.toks[j][1]
            if w in ("(", "["):
                j = self.closing(j)
            elif w in (";", "{", "}", ")", "&&") and not (w == "&&" and depth):
                return -1
            else:
                depth += (w == "<") - (w == ">")
                if depth == 0:
                    return j
            j += 1
        return -1

    def parts(self, a: int, b: int) -> list[str]:
        """What stands between ``a`` and ``b``, parted at its own commas."""
        out, depth, start = [], 0, a
        for j in range(a, b + 1):
            w = self.toks[j][1] if j < b else ","
            depth += (w in ("(", "[", "{", "<")) - (w in (")", "]", "}", ">"))
            if w == "," and depth == 0 or j == b:
                if j > start:
                    out.append(self.said(start, j))
                start = j + 1
        return out

    # --- scopes
    def where(self) -> str:
        return "::".join(s["name"] for s in self.scopes if s["name"] and s["kind"] in ("namespace", "class"))

    def function(self) -> dict | None:
        return next((s for s in reversed(self.scopes) if s["kind"] == "function"), None)

    def usr(self, kind: str, name: str, more: str = "", n_params: int = 0) -> str:
        """A key in the form of a USR; of a function it has the parameters as written in place of type codes."""
        out = "c:"
        for s in self.scopes:
            if s["name"] and s["kind"] in ("namespace", "class"):
                tag = "N" if s["kind"] == "namespace" else "S" if not s.get("n_params") else f"ST>{s['n_params']}" + "#T" * s["n_params"]
                for part in s["name"].split("::"):
                    out += f"@{tag}@{part}"
        tag = {"class": "S", "function": "F", "alias": "T"}[kind]
        if n_params and kind == "class":
            tag = f"ST>{n_params}" + "#T" * n_params
        return f"{out}@{tag}@{name}" + (f"#{more}#" if kind == "function" else "")

    def push(self, kind: str, name: str = "", row: int | None = None, **more) -> None:
        self.scopes.append({"kind": kind, "name": name, "row": row, **more})

    def emit(self, fact: str, name: str, scope: str, detail: str, i: int, is_definition: bool, **more) -> int:
        line, column = self.place(i)
        row = dict.fromkeys(_FIELDS) | {"file": self.file, "fact": fact, "name": name, "scope": scope, "detail": detail, "line": line, "is_definition": is_definition, "column_no": column, "end_line": line} | more
        self.rows.append(row)
        return len(self.rows) - 1

    def pop(self) -> None:
        if self.scopes:
            s = self.scopes.pop()
            if s["row"] is not None:
                self.rows[s["row"]]["end_line"] = self.place(self.i)[0]

    # --- the pass
    def run(self) -> Iterator[tuple]:
        params: list[str] | None = None
        first = 0
        while self.i < len(self.toks):
            if params is None:
                first = self.i
            if self.function() is not None:
                self.body()
                continue
            w = self.at()
            if w == "}":
                self.pop()
                self.i += 1
            elif w == ";" or self.kind() == "string":
                self.i += 1
            elif w == "{":
                self.push("block")
                self.i += 1
            elif w == "[" and self.at(1) == "[":
                self.i = self.closing(self.i) + 1
                continue
            elif w == "template" and self.at(1) == "<":
                end = self.angle(self.i + 1)
                if end < 0:
                    self.i += 1
                else:
                    params = (params or []) + self.parts(self.i + 2, end)
                    self.i = end + 1
                    if self.at() == "requires":
                        self.i += 1
                        while self.i < len(self.toks) and self.at() not in ("class", "struct", ";", "{", "using") and not (self.kind() == "word" and self.kind(1) == "word" and self.at(-1) not in ("&&", "|", "requires")):
                            self.i = self.closing(self.i) + 1 if self.at() == "(" else self.i + 1
                    continue
            elif w in ("public", "private", "protected") and self.at(1) == ":":
                if self.scopes:
                    self.scopes[-1]["access"] = w
                self.i += 2
            elif w == "inline" and self.at(1) == "namespace":
                self.i += 1
            elif w == "namespace":
                self.namespace()
            elif w == "extern" and self.kind(1) == "string" and self.at(2) == "{":
                self.push("block")
                self.i += 3
            elif w == "using":
                self.using(params, first)
            elif w == "typedef":
                self.typedef(first)
            elif w == "enum":
                self.skip()
            elif w in ("class", "struct", "union") and self.record(params, first):
                pass
            else:
                self.declaration(params, first)
            params = None
        for row in self.rows:
            if row["fact"] == "alias":
                row["canonical"] = self.canonical(row["detail"])
            yield tuple(row[f] for f in _FIELDS)

    def skip(self) -> None:
        """Past the end of a declaration of no interest."""
        while self.i < len(self.toks) and self.at() not in (";", "}"):
            self.i = self.closing(self.i) + 1 if self.at() in _OPEN else self.i + 1
        self.i += self.at() == ";"

    def namespace(self) -> None:
        self.i += 1
        start = self.i
        while self.kind() == "word" or self.at() == "::":
            self.i += 1
        name = self.said(start, self.i)
        if self.at() == "{":
            self.push("namespace", name or "(anonymous)")
            self.i += 1
        else:
            self.skip()

    def using(self, params: list[str] | None, first: int) -> None:
        name = self.at(1)
        if self.at(2) == "=" and self.kind(1) == "word":
            start = self.i + 3
            at = self.i + 1
            self.skip()
            target = self.said(start, self.i - 1)
            self.aliases.setdefault(name, target)
            self.emit("alias", name, self.where(), target, at, True, template_params=params, doc_comment=self.docs.get(first), usr=self.usr("alias", name), return_type="using")
        else:
            self.skip()

    def typedef(self, first: int) -> None:
        start = self.i + 1
        self.skip()
        end = self.i - 1
        pointer = next((j for j in range(start, end) if self.toks[j][1] == "(" and j + 2 < end and self.toks[j + 1][1] in ("*", "&")), None)
        at = pointer + 2 if pointer is not None else end - 1
        if at >= start and self.toks[at][0] == "word":
            name = self.toks[at][1]
            target = self.said(start, at) if pointer is None else self.said(start, at) + self.said(at + 1, end)
            self.aliases.setdefault(name, target)
            self.emit("alias", name, self.where(), target, at, True, doc_comment=self.docs.get(first), usr=self.usr("alias", name), return_type="typedef")

    def canonical(self, target: str) -> str:
        """``target`` with the aliases of this text put in, as far as they go."""
        for _ in range(len(self.aliases) + 1):
            new = re.sub(r"[^\W\d]\w*", lambda m: self.aliases.get(m.group(), m.group()), target)
            if new == target or len(new) > 10_000:
                break
            target = new
        return target

    def record(self, params: list[str] | None, first: int) -> bool:
        """A class, struct or union, declared or defined; False if the word only stands before a type."""
        j, word = self.i + 1, self.at()
        while j < len(self.toks):
            if self.toks[j][1] == "[" or self.toks[j][1] == "alignas":
                j = self.closing(j + (self.toks[j][1] == "alignas")) + 1
            elif self.toks[j][0] == "word" and j + 1 < len(self.toks) and self.toks[j + 1][0] == "word" and self.toks[j + 1][1] != "final":
                j += 1  # an export macro before the name
            else:
                break
        if j >= len(self.toks) or self.toks[j][0] != "word":
            if j < len(self.toks) and self.toks[j][1] == "{":
                self.push("block")
                self.i = j + 1
                return True
            return False
        at = j
        while j + 2 < len(self.toks) and self.toks[j + 1][1] == "::":
            j += 2
        name, args = self.said(at, j + 1), None
        j += 1
        if j < len(self.toks) and self.toks[j][1] == "<" and (end := self.angle(j)) > 0:
            args = self.parts(j + 1, end)
            j = end + 1
        if j < len(self.toks) and self.toks[j][1] == "final":
            j += 1
        bases: list[str] = []
        if j < len(self.toks) and self.toks[j][1] == ":":
            start = j = j + 1
            while j < len(self.toks) and self.toks[j][1] not in ("{", ";"):
                j = self.closing(j) + 1 if self.toks[j][1] in ("(", "[") else j + 1
            bases = [re.sub(r"\b(?:public|private|protected|virtual|class|struct|typename)\b\s*", "", b).removesuffix("...").strip() for b in self.parts(start, j)]
        if j >= len(self.toks) or self.toks[j][1] not in ("{", ";"):
            return False
        whole = self.toks[j][1] == "{"
        fact = "class_template" if params and args is None else "partial_specialization" if params and args else word
        row = self.emit(
            fact, name, self.where(), ", ".join(bases), at, whole, access=self.access(), template_params=params or None, template_args=args, is_specialization=args is not None, doc_comment=self.docs.get(first),
            usr=self.usr("class", name, n_params=len(params or []) if args is None else 0) + (">" + "".join(f"#{a}" for a in args) if args else ""),
        )
        self.classes.add(name.rsplit("::", 1)[-1])
        self.i = j + 1
        if whole:
            self.push("class", name, row, access="private" if word == "class" else "public", n_params=len(params or []) if args is None else 0)
        return True

    def access(self) -> str | None:
        return self.scopes[-1].get("access") if self.scopes and self.scopes[-1]["kind"] == "class" else None

    def declaration(self, params: list[str] | None, first: int) -> None:
        """A function or a variable: up to its ``;`` or into its body."""
        start, j, paren, name_at = self.i, self.i, None, None
        while j < len(self.toks):
            w = self.toks[j][1]
            if w == "operator":
                k = j + 1
                if k + 1 < len(self.toks) and self.toks[k][1] in ("(", "[") and self.toks[k + 1][1] in (")", "]"):
                    k += 2
                while k < len(self.toks) and self.toks[k][1] not in ("(", ";", "{"):
                    k += 1
                name_at, paren, j = j, k if k < len(self.toks) and self.toks[k][1] == "(" else None, k
                break
            if w == "(":
                if j > start and self.toks[j - 1][0] == "word" and self.toks[j - 1][1] not in _NO_CALL or j > start and self.toks[j - 1][1] == ">":
                    paren = j
                    break
                j = self.closing(j) + 1
                continue
            if w == "<" and (end := self.angle(j)) > 0:
                j = end + 1
                continue
            if w in (";", "=", "{", "}", ":") or w in ("class", "struct") and j > start:
                if w in ("class", "struct"):
                    j += 1
                    continue
                break
            j = self.closing(j) + 1 if w == "[" else j + 1
        if paren is None:
            self.i = max(j, start)
            if self.at() == ":" :  # a bit field, or a label in broken text
                self.i += 1
            if self.at() == "{":
                self.i = self.closing(self.i) + 1
            elif self.at() == "}":
                return
            else:
                self.skip()
            if self.i == start:
                self.i += 1
            return
        if name_at is None:
            name_at = paren - 1
            if self.toks[name_at][1] == ">":  # a specialised function
                depth = 0
                while name_at > start:
                    depth += (self.toks[name_at][1] == ">") - (self.toks[name_at][1] == "<")
                    name_at -= 1
                    if depth == 0:
                        break
            if name_at > start and self.toks[name_at - 1][1] == "~":
                name_at -= 1
        while name_at - 2 >= start and self.toks[name_at - 1][1] == "::" and self.toks[name_at - 2][0] == "word":
            name_at -= 2
        close = self.closing(paren)
        if close >= len(self.toks) or self.toks[close][1] != ")":  # broken: what stands in it may be whole
            self.i = paren + 1
            return
        at = next((k for k in range(name_at, paren) if self.toks[k][1] == "operator"), None)
        name = self.said(name_at, paren)
        if at is not None:
            after = "".join(t[1] for t in self.toks[at + 1 : paren])
            name = self.said(name_at, at) + "operator" + (" " if after[:1].isalpha() else "") + after
        j, pure, quals = close + 1, False, []
        while j < len(self.toks) and self.toks[j][1] not in (";", "{", "}", ":"):
            w = self.toks[j][1]
            if w == "=":
                pure = j + 1 < len(self.toks) and self.toks[j + 1][1] == "0"
            if w == "(":
                j = self.closing(j)
            else:
                quals.append(w)
            j += 1
        init = j < len(self.toks) and self.toks[j][1] == ":"
        while init and j < len(self.toks) and self.toks[j][1] not in (";", "}"):  # member initialisers, then the body
            if self.toks[j][1] == "{" and self.toks[j - 1][0] != "word" and self.toks[j - 1][1] != ">":
                break
            j = self.closing(j) + 1 if self.toks[j][1] in _OPEN else j + 1
        head = {t[1] for t in self.toks[start:name_at]}
        returns = self.said(*self._returns(start, name_at))
        body = j < len(self.toks) and self.toks[j][1] == "{"
        simple = name.rsplit("::", 1)[-1] if not name.startswith("operator") else name
        maker = simple.lstrip("~") in self.classes
        plausible = bool(returns) or maker or name.startswith("operator") or "::" in name
        if not plausible:
            self.i = close + 1
            self.skip() if not body else None
            if body:
                self.i = j
            return
        words = " ".join(q for q in quals if q in ("const", "noexcept", "override", "final", "volatile", "&", "&&"))
        args = self.parts(paren + 1, close)
        row = self.emit(
            "function_template" if params else "function", name, self.where(), f"({self.said(paren + 1, close)})" + (f" {words}" if words else ""), name_at, body, access=self.access(), return_type=returns or None,
            is_virtual="virtual" in head or "override" in quals, is_pure_virtual=pure, is_const="const" in quals, is_static="static" in head, template_params=params or None, is_specialization=False, doc_comment=self.docs.get(first), usr=self.usr("function", name, "#".join(args)),
        )
        self.i = j + 1
        if body:
            self.push("function", "::".join(x for x in (self.where(), name) if x), row)
        elif j < len(self.toks) and self.toks[j][1] == "}":
            self.i = j

    def _returns(self, a: int, b: int) -> tuple[int, int]:
        """The return type among the tokens before a function's name."""
        while a < b and self.toks[a][1] in _SPECIFIERS:
            a += 1
        while a < b and self.toks[a][1] == "[":
            a = self.closing(a) + 1
        while a < b and self.toks[a][1] in _SPECIFIERS:
            a += 1
        return a, b

    def body(self) -> None:
        """One step inside a function: calls, blocks and the end."""
        w = self.at()
        if w == "{":
            self.push("block")
        elif w == "}":
            self.pop()
        elif self.kind() == "word" and w not in _NO_CALL and self.at(-1) not in (".", "->", "::"):
            start = j = self.i
            args = None
            while j + 2 < len(self.toks) and self.toks[j + 1][1] in (".", "->", "::") and self.toks[j + 2][0] == "word":
                j += 2
            if j + 1 < len(self.toks) and self.toks[j + 1][1] == "<" and (end := self.angle(j + 1)) > 0 and end + 1 < len(self.toks) and self.toks[end + 1][1] == "(":
                args, after = self.parts(j + 2, end), end + 1
            else:
                after = j + 1
            before = self.toks[start - 1] if start else ("", "", 0)
            declares = before[0] == "word" and before[1] not in _NO_CALL | {"and", "or", "not"}
            if after < len(self.toks) and self.toks[after][1] == "(" and not declares:
                name = "".join(t[1] for t in self.toks[start : j + 1])
                self.emit("call", name, self.function()["name"], "", start, False, template_args=args, canonical=",".join(a for a in args or () if a.rsplit("::", 1)[-1] in self.classes) or None)
            self.i = max(after - 1, self.i)
        self.i += 1


def lexical(file: str, content: str) -> Iterator[tuple]:
    """The facts of one text; strings and comments hold none."""
    return _Reader(file, content).run()


def facts(files: DataFrame, *extractors: Extractor) -> DataFrame:
    """All facts of ``files`` (file, content): of each text those of the first extractor that does not fail on it, else an 'error' fact."""
    tries = extractors or (lexical,)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for file, content in zip(b["file"], b["content"]):
                error = None
                for extract in tries:
                    try:
                        out += list(extract(file, content or ""))
                        break
                    except Exception as e:  # one bad file must not end the scan
                        error = error or e
                else:
                    row = dict.fromkeys(_FIELDS) | {"file": file, "fact": "error", "name": type(error).__name__, "scope": "", "detail": str(error), "line": 0, "is_definition": False}
                    out.append(tuple(row[f] for f in _FIELDS))
            yield pd.DataFrame(out, columns=_FIELDS)

    return files.select("file", "content").mapInPandas(run, FACTS)


def code_in(text: str) -> Column:
    """The C++ of a text: what stands in fences, else the whole if a line of it is a directive or ends as code does; null if there is none."""
    c = F.col(text)
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```[^\n]*\n(.*?)(?:```|\z)"))
    whole = F.when(c.rlike(r"(?m)^\s*#\s*include\b|[;{}]\s*$"), c)
    return F.when(c.contains("```"), F.nullif(F.array_join(fenced, "\n"), F.lit(""))).otherwise(whole)
