"""Compiler arguments: filtering, absolute include paths, sanitising rules, hashes."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .packed import rule_values

#: What counts as a compiler and as a source file.
COMPILERS = {"gcc", "g++", "clang", "clang++", "cc", "c++", "cl"}
SOURCES = (".c", ".cc", ".cpp", ".cxx", ".c++", ".m", ".mm")
INCLUDE_FLAGS = ("-I", "-isystem")


def useful(args: list[str] | None) -> list[str]:
    """Arguments without the compiler, ``-c``, ``-o`` with its file, and source files."""
    args = list(args if args is not None else [])
    if args:
        base = args[0].replace("\\", "/").rsplit("/", 1)[-1].lower().removesuffix(".exe")
        if base in COMPILERS or args[0][:1] in ("/", "\\"):
            args = args[1:]
    out, skip = [], False
    for a in args:
        if skip:
            skip = False
        elif a == "-o":
            skip = True
        elif a != "-c" and (a.startswith("-") or not a.lower().endswith(SOURCES)):
            out.append(a)
    return out


def absolute_includes(args: list[str], directory: str | None) -> list[str]:
    """Arguments with relative include paths set against ``directory``."""
    here = directory or "/"
    fix = lambda p: p if p.startswith("/") else posixpath.normpath(posixpath.join(here, p))
    out, wants = [], False
    for a in args:
        flag = next((f for f in INCLUDE_FLAGS if a.startswith(f)), None)
        if wants:
            out.append(fix(a))
            wants = False
        elif flag and len(a) > len(flag):
            out.append(flag + fix(a[len(flag) :].strip()))
        else:
            wants = flag is not None
            out.append(a)
    return out


def _at(args: list[str], i: int, sequence: list[str]) -> list[str] | None:
    """What the ``<arg>`` slots of ``sequence`` hold at ``i``, or None if it does not stand there."""
    here = args[i : i + len(sequence)]
    if len(here) < len(sequence) or len(sequence) < 2 or any(w not in ("<arg>", x) for w, x in zip(sequence, here)):
        return None
    return [x for w, x in zip(sequence, here) if w == "<arg>"]


def _value_after(args: list[str], i: int) -> int:
    return int(i < len(args) and not args[i].startswith("-"))


#: How many arguments a rule of each type removes at a place; 0 for none.
RULES: dict[str, Callable[[list[str], int, dict], int]] = {
    "exact_match": lambda a, i, r: int(a[i] in r.get("patterns", [])),
    "prefix_match": lambda a, i, r: int(a[i].startswith(tuple(r.get("patterns", [])))),
    "flag_with_optional_value": lambda a, i, r: (1 + _value_after(a, i + 1)) if a[i] == r.get("pattern") else 0,
    "xclang_sequence": lambda a, i, r: len(r["sequence"]) if a[i] == "-Xclang" and _at(a, i, r.get("sequence", [])) is not None else 0,
    "xclang_conditional_sequence": lambda a, i, r: _conditional(a, i, r),
    "xclang_option_with_value": lambda a, i, r: (2 + _value_after(a, i + 2)) if a[i] == "-Xclang" and a[i + 1 : i + 2] and a[i + 1] in r.get("patterns", []) else 0,
}


def _conditional(args: list[str], i: int, rule: dict) -> int:
    slots, cond = _at(args, i, rule.get("sequence", [])) if args[i] == "-Xclang" else None, rule.get("condition", {})
    k = cond.get("arg_index")
    if slots is None or k is None or k >= len(slots):
        return 0
    return len(rule["sequence"]) if any(p in slots[k].lower() for p in cond.get("contains", [])) else 0


def sanitized(args: list[str], rules: list[dict]) -> list[str]:
    """Arguments without those that a rule removes; the first rule that fits decides."""
    out, i = [], 0
    while i < len(args):
        n = next((n for r in rules if r.get("type") in RULES and (n := RULES[r["type"]](args, i, r))), 0)
        if not n:
            out.append(args[i])
        i += n or 1
    return out


def clean_arguments(args: Column, directory: Column, rules: list[dict] | None = None) -> Column:
    """``useful``, ``absolute_includes`` and ``sanitized`` of a column of argument lists."""
    told = rules or []

    @F.pandas_udf("array<string>")
    def run(a: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sanitized(absolute_includes(useful(x), y), told) if x is not None else None for x, y in zip(a, d)])

    return run(args, directory)


def command_words(command: Column) -> Column:
    """The arguments of a command written as text (as in p7); null for null and blank texts."""

    @F.pandas_udf("array<string>")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: rule_values(t, "command") if isinstance(t, str) and t.strip() else None)

    return run(command)


def arguments_hash(args: Column, sort: bool = False) -> Column:
    """SHA-256 of the arguments joined by ``|``; with ``sort`` their order does not matter."""
    return F.sha2(F.array_join(F.array_sort(args) if sort else args, "|"), 256)


def project_hash(root: Column, config: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of root and configuration."""
    return F.substring(F.sha2(F.concat_ws("|", root, config), 256), 1, 16)
