"""Rules for fields that pack several values into one text.

Pure functions on single texts; the operators call them from Arrow batches.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class Cut:
    """A place where a text may be split: the span of the marks and what they look like.

    A hard one always splits, one that is not never does; None where the text alone does not tell.
    """

    start: int
    end: int
    kind: str
    hard: bool | None


def json_strings(text: str) -> list[str] | None:
    """The elements of a JSON array of strings, or None if the text is no such array."""
    t = text.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    try:
        got = json.loads(t)
    except ValueError:
        return None
    return got if isinstance(got, list) and all(isinstance(x, str) for x in got) else None


# --- commands -------------------------------------------------------------

def command_cuts(text: str) -> list[Cut]:
    """Runs of unquoted blanks and semicolons of a shell command, in order.

    Quoted spans and escaped characters are atomic; a backslash before a line
    end vanishes together with it and neither splits nor joins by itself.
    """
    cuts: list[Cut] = []
    i, n, quote = 0, len(text), ""
    while i < n:
        c = text[i]
        if quote:
            if c == "\\" and quote == '"':
                i += 2
                continue
            if c == quote:
                quote = ""
            i += 1
        elif c in "'\"":
            quote = c
            i += 1
        elif c == "\\":
            i += 2
        elif c in " \t\r\n;":
            j = i
            seen = set()
            while j < n:
                if text[j] in " \t\r\n;":
                    seen.add("semi" if text[j] == ";" else "line" if text[j] in "\r\n" else "tab" if text[j] == "\t" else "blank")
                    j += 1
                elif text.startswith("\\\n", j):
                    seen.add("continued")
                    j += 2
                else:
                    break
            cuts.append(Cut(i, j, "sh:" + "+".join(sorted(seen)), True))
            i = j
        else:
            i += 1
    return cuts


def unquote_word(raw: str) -> tuple[str, bool]:
    """A shell word without its quotes and backslashes; whether it held any quote."""
    out: list[str] = []
    i, n, quote, quoted = 0, len(raw), "", False
    while i < n:
        c = raw[i]
        if quote == "'":
            if c == "'":
                quote = ""
            else:
                out.append(c)
            i += 1
        elif quote == '"':
            if c == '"':
                quote = ""
                i += 1
            elif c == "\\" and i + 1 < n and raw[i + 1] in '$`"\\\n':
                if raw[i + 1] != "\n":
                    out.append(raw[i + 1])
                i += 2
            else:
                out.append(c)
                i += 1
        elif c in "'\"":
            quote, quoted = c, True
            i += 1
        elif c == "\\":
            if i + 1 >= n:
                out.append(c)
                i += 1
            else:
                if raw[i + 1] != "\n":
                    out.append(raw[i + 1])
                i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out), quoted


def command_value(raw: str) -> str | None:
    """The value of one piece of a command, or None where there is none."""
    word, quoted = unquote_word(raw)
    return word if word or quoted else None


# --- base class lists -----------------------------------------------------

_OPEN, _CLOSE = "<([{", ">)]}"


def _name_char(c: str) -> bool:
    return c == "_" or c.isalnum()


def _is_blank(c: str) -> bool:
    return c == " " or unicodedata.category(c) == "Zs"


def unwrapped(text: str) -> tuple[int, int]:
    """The span of ``text`` without blanks and without brackets or braces around the whole."""
    a, b = 0, len(text)
    while True:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b - a >= 2 and text[a] in "[{" and text[b - 1] == {"[": "]", "{": "}"}[text[a]]:
            a, b = a + 1, b - 1
        else:
            return a, b


def _nested(text: str, i: int, end: int) -> int:
    """End of the bracketed span that opens at ``i``, or ``i`` if it never closes."""
    stack = []
    for j in range(i, end):
        c = text[j]
        if c in _OPEN:
            stack.append(_CLOSE[_OPEN.index(c)])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return j + 1
        elif c in ")]}" and c in stack:
            while stack.pop() != c:
                pass
            if not stack:
                return j + 1
    return i


def base_cuts(text: str) -> list[Cut]:
    """Places where a list of base classes may be split.

    Hard cuts are marks and control characters that cannot belong to a C++ type
    name where they stand; soft ones are the marks and blanks inside names and their
    brackets, which only look like delimiters. Whether quotes stand around one value
    or around several the text alone does not tell.
    """
    a, b = unwrapped(text)
    cuts: list[Cut] = []
    if a:
        cuts.append(Cut(0, a, "wrap", True))

    def add(i: int, j: int, kind: str, hard: bool | None) -> None:
        if hard and cuts and cuts[-1].hard and not text[cuts[-1].end : i].strip():
            last = cuts.pop()
            kind = last.kind if kind in last.kind else last.kind + kind
            i = last.start
        cuts.append(Cut(i, j, kind, hard))

    i = a
    fresh = True  # at the start of a value: a quote here opens a quoted value
    while i < b:
        c = text[i]
        if c in "\"'" and fresh:
            j = text.find(c, i + 1, b)
            if j >= 0:
                inner = i + 1  # end of the last brackets
                for k in range(i + 1, j):
                    if k >= inner and text[k] in "<(" and k > i + 1:
                        inner = max(inner, _nested(text, k, j))
                    if text[k] in ",;|\t\n":
                        add(k, k + 1, "q" + text[k], False if k < inner else None)
                i, fresh = j + 1, False
                continue
        if _name_char(c):
            i, fresh = i + 1, False
        elif _is_blank(c):
            j = i
            while j < b and _is_blank(text[j]):
                j += 1
            if not fresh and j < b and _name_char(text[j]):
                add(i, j, "blank", False)
            i = j
        elif c == ":" and text.startswith("::", i):
            i, fresh = i + 2, False
        elif c in "<(" and not fresh and (j := _nested(text, i, b)) > i:
            for k in range(i + 1, j - 1):
                if text[k] in ",;|\t\n":
                    add(k, k + 1, "in" + text[k], False)
            i = j
        elif c == "." and text.startswith("...", i) and not fresh:
            i += 3
        elif c in "*&" and not fresh:
            j = i
            while j < b and text[j] in "*& ":
                j += 1
            if j < b and (_name_char(text[j]) or text[j] == ":") and not text.startswith(("const", "volatile"), j):
                add(i, j, c, True)
                fresh = True
            i = j
        else:
            add(i, i + 1, c if c.isprintable() else "ctl", True)
            i, fresh = i + 1, True
    if b < len(text):
        add(b, len(text), "wrap", True)
    return cuts


def base_value(raw: str) -> str | None:
    """One base class as written, without blanks and quotes around it, or the one quote around several that it has; None if empty."""
    v = raw.strip()
    if len(v) >= 2 and v[0] in "\"'" and v[-1] == v[0]:
        v = v[1:-1].strip()
    elif v and v[0] in "\"'" and v.count(v[0]) == 1:
        v = v[1:].strip()
    elif v and v[-1] in "\"'" and v.count(v[-1]) == 1:
        v = v[:-1].strip()
    return v or None


GRAMMARS = {"command": (command_cuts, command_value), "base": (base_cuts, base_value)}


def pieces(text: str, cuts: list[Cut]) -> list[str]:
    out, at = [], 0
    for c in cuts:
        out.append(text[at : c.start])
        at = c.end
    out.append(text[at:])
    return out


def rule_values(text: str | None, grammar: str) -> list[str]:
    """The values of ``text`` by rule: every cut splits that is hard or that the text alone does not tell, nothing else does.

    Null and blank texts hold nothing. A JSON array of strings holds its elements
    (empty ones are dropped from base class lists only).
    """
    if text is None or not text.strip():
        return []
    got = json_strings(text)
    if got is not None:
        return [x for x in got if x.strip()] if grammar == "base" else got
    cuts_of, value_of = GRAMMARS[grammar]
    return [v for p in pieces(text, [c for c in cuts_of(text) if c.hard is not False]) if (v := value_of(p)) is not None]


def first_base(text: str | None) -> str | None:
    got = rule_values(text, "base")
    return got[0] if got else None
