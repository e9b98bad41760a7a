"""Name patterns: what kind a pattern is, the Column that matches it, and its safety.

A pattern is typed once on the driver and becomes one Catalyst expression, so the
scan stays inside generated code and plain comparisons reach the Parquet reader.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that make a pattern a regular expression.
META = set(".*+?[]{}()|\\^$")
#: Limits of a safe regular expression.
MAX_LENGTH, MAX_COMPLEXITY = 1000, 10
#: C++ type words that betray a signature.
TYPE_WORDS = "void bool int float double char const struct class auto typename unsigned long short".split()
#: Words that stand before a declared name and are no names themselves.
SPECIFIERS = "static virtual inline extern volatile mutable explicit template constexpr friend".split()
_NAME_TOKEN = re.compile(r"(?:[^\W\d]\w*::)*[^\W\d]\w*", re.ASCII)


def is_pattern(text: str) -> bool:
    return any(c in META for c in text)


def pattern_type(p: str) -> str:
    """'exact', 'regex', 'suffix' or 'unqualified'."""
    if p.startswith("::"):
        return "exact"
    if is_pattern(p):
        return "regex"
    return "suffix" if "::" in p else "unqualified"


def tidy(c: Column | str) -> Column:
    """A name without blanks around ``*`` and ``&``."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), r"\s*([*&])\s*", "$1")


def tidy_text(s: str) -> str:
    return re.sub(r"\s*([*&])\s*", r"\1", s)


def java_regex(p: str) -> str | None:
    """``p``, an expression as Python reads it, as Java reads it; None if Python or Java finds it invalid.

    Named groups lose their names (back references to them become numbers) and ``\\Z`` is
    the very end; all else that both know means the same in both.
    """
    try:
        names = re.compile(p).groupindex
    except (re.error, OverflowError, RecursionError):
        return None
    out, i, in_class = [], 0, False
    while i < len(p):
        two = p[i : i + 2]
        if two[:1] == "\\":
            out.append(r"\z" if two == r"\Z" and not in_class else two)
            i += 2
            continue
        if not in_class and p.startswith("(?P", i):
            if p.startswith("(?P<", i):
                out.append("(")
                i = p.index(">", i) + 1
            else:  # (?P=name)
                end = p.index(")", i)
                out.append(f"(?:\\{names[p[i + 4 : end]]})")
                i = end + 1
            continue
        if in_class:
            out.append("\\[" if p[i] == "[" else r"\&" if two == "&&" else p[i])
            if p[i] == "]" and i > first:
                in_class = False
        else:
            if p[i] == "[":
                in_class, first = True, i + (2 if two == "[^" else 1)
                if p[first : first + 1] == "]":  # a bracket that stands first is a member
                    out.append(p[i:first] + "\\]")
                    i = first + 1
                    continue
            out.append(p[i])
        i += 1
    text = rf"(?iu)\A(?:{''.join(out)})\z"
    return text if _java_accepts(text) else None


def _java_accepts(text: str) -> bool:
    """Asks the JVM of the running session, if there is one."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        return True
    try:
        sc._jvm.java.util.regex.Pattern.compile(text)
    except Exception:
        return False
    return True


def full_regex(c: Column, p: str) -> Column:
    """Whole-text match, ignoring case as Unicode does; False where ``p`` is no valid expression."""
    text = java_regex(p)
    return F.lit(False) if text is None else c.rlike(text)


def last_component(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def matches_qualified(c: Column, p: str) -> Column:
    """Does the qualified name ``c`` match ``p``? Empty matches all; ``::X`` is exact and case counts;
    a regular expression must match as a whole; else the last components must be equal in any case."""
    if not p:
        return F.lit(True)
    kind, c = pattern_type(p), tidy(c)
    if kind == "exact":
        return c == F.lit(tidy_text(p[2:]))
    if kind == "regex":
        return full_regex(c, p)
    low = F.lower(c)
    q = tidy_text(p).lower()
    if kind == "unqualified":
        return last_component(low) == F.lit(q)
    return (low == F.lit(q)) | low.endswith("::" + q)


def matches_simple(c: Column, p: str) -> Column:
    """The same for simple names: empty matches all, a regular expression as a whole, else in any case."""
    if not p:
        return F.lit(True)
    return full_regex(c, p) if is_pattern(p) else F.lower(c) == F.lit(p.lower())


def in_namespace(ns: Column, wanted: str | None) -> Column:
    """None: anywhere; '': global only; else that namespace or one that ends in it (case counts)."""
    if wanted is None:
        return F.lit(True)
    if wanted == "":
        return F.coalesce(ns, F.lit("")) == ""
    return F.coalesce((ns == F.lit(wanted)) | ns.endswith("::" + wanted), F.lit(False))


def glob_regex(glob: str) -> str:
    """A shell glob as a Java expression; ``*`` crosses slashes, as file name matching does."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "]") else i + 1)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def matches_glob(file: Column, glob: str, root: str = "") -> Column:
    """The glob on the whole path, anywhere below a directory, or on the path below ``root``."""
    below = F.when(file.startswith(root + "/"), F.substring(file, F.lit(len(root) + 2), F.length(file))) if root else file
    return file.rlike(glob_regex(glob)) | file.rlike(glob_regex("*/" + glob)) | F.coalesce(below.rlike(glob_regex(glob)), F.lit(False))


def at_path(file: Column, path: str, boundary: bool = True) -> Column:
    """Equal to ``path`` or ending in it; with ``boundary`` only at a slash."""
    return (file == F.lit(path)) | file.endswith(("/" if boundary and not path.startswith("/") else "") + path)


# --- safety of regular expressions ----------------------------------------


def _repeats(p: str) -> tuple[int, bool, bool]:
    """(depth of groups, a repeated group repeats inside, a repeated group has alternatives) of an expression.

    One pass with a stack: each open group remembers whether a quantifier or a ``|`` stood
    in it or in a group inside it; what follows its end tells whether it repeats.
    """
    stack: list[list[bool]] = []
    deepest, inner, either = 0, False, False
    i, n = 0, len(p)
    while i < n:
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = _class_end(p, i)
            continue
        if c == "(":
            stack.append([False, False])
            deepest = max(deepest, len(stack))
            if p[i + 1 : i + 2] == "?":  # the mark of a special group is no quantifier
                i += 1
        elif c == ")" and stack:
            repeats, choice = stack.pop()
            again = p[i + 1 : i + 2] in ("+", "*", "{") and i + 1 < n
            inner |= again and repeats
            either |= again and choice
            if stack:
                stack[-1][0] |= repeats or again
                stack[-1][1] |= choice
        elif stack and c in "+*{":
            stack[-1][0] = True
        elif stack and c == "|":
            stack[-1][1] = True
        i += 1
    return deepest, inner, either


def _class_end(p: str, i: int) -> int:
    """The place after the character class that begins at ``i``."""
    j = i + 2 if p[i + 1 : i + 2] == "^" else i + 1
    j += p[j : j + 1] == "]"
    while j < len(p) and p[j] != "]":
        j += 2 if p[j] == "\\" else 1
    return j + 1


def complexity(p: str) -> int:
    """Twice the depth of groups, plus quantifiers and alternatives, plus fines (fixed values 50 and 30) for what explodes."""
    depth, inner, either = _repeats(p)
    return 2 * depth + sum(map(p.count, "+*{|")) + (50 if inner else 0) + (30 if either else 0)


def unsafe_because(p: str) -> str | None:
    """Why a regular expression must not run, or None."""
    if len(p) > MAX_LENGTH:
        return f"longer than {MAX_LENGTH} characters"
    _, inner, either = _repeats(p)
    if inner:
        return "a quantifier on a quantified group"
    if either:
        return "a quantifier on alternatives"
    if (n := complexity(p)) > MAX_COMPLEXITY:
        return f"complexity {n} is over {MAX_COMPLEXITY}"
    try:
        re.compile(p)
    except re.error as e:
        return f"not an expression: {e}"
    return None


def safe(p: str) -> str:
    """``p`` if it may run, else ``p`` taken literally."""
    return p if unsafe_because(p) is None else re.escape(p)


def complexity_column(c: Column) -> Column:
    """``complexity`` of a column of patterns."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(complexity, na_action="ignore").astype("Int64")

    return run(c)


# --- what a pattern looks like --------------------------------------------

def looks_like_signature(p: str) -> bool:
    """Parentheses, or a type word among at least two words."""
    if "(" in p or len(p.split()) < 2:
        return "(" in p
    return any(re.search(rf"\b{w}\b" + (r"\s" if w in ("struct", "class") else ""), p) for w in TYPE_WORDS)


def looks_like_signature_column(c: Column) -> Column:
    plain = "|".join(w for w in TYPE_WORDS if w not in ("struct", "class"))
    return F.instr(c, "(").cast("boolean") | (c.rlike(rf"\b(?:{plain})\b|\b(?:struct|class)\b\s") & (F.size(F.split(F.trim(c), r"\s+")) >= 2))


def identifier_of(p: str) -> str | None:
    """The name a signature is about: the last one before ``(``, else the longest that is no type word."""
    head, paren, _ = p.partition("(")
    if paren and (before := _NAME_TOKEN.findall(head)):
        return before[-1]
    tokens = _NAME_TOKEN.findall(p)
    own = [t for t in tokens if t.lower() not in TYPE_WORDS and t.lower() not in SPECIFIERS]
    return max(own or tokens, key=len, default=None)


_META_RX = r"[.*+?\[\]{}()|\\^$]"


def _two_names_before_parenthesis(c: Column) -> Column:
    """A type and a name, each a plain or qualified identifier, and then ``(``."""
    head = F.split(F.trim(F.substring_index(c, "(", 1)), r"\s+")
    return c.contains("(") & (F.size(head) == 2) & F.forall(head, lambda w: w.rlike(r"\A[A-Za-z_][A-Za-z0-9_:]*\z"))


def pattern_class(c: Column) -> Column:
    """signature_like, prototype_like, qualified_name, regex or plain_name."""
    meta = c.rlike(_META_RX)
    return (
        F.when(looks_like_signature_column(c), "signature_like")
        .when(_two_names_before_parenthesis(c), "prototype_like")
        .when(c.contains("::") & ~meta, "qualified_name")
        .when(meta, "regex")
        .otherwise("plain_name")
    )


def pattern_features(c: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\b(\w+)\b"))
    return {
        "has_parens": c.contains("("),
        "has_spaces": c.contains(" "),
        "has_colons": c.contains("::"),
        "has_regex_meta": c.rlike(_META_RX),
        "has_type_keywords": F.arrays_overlap(words, F.array(*[F.lit(w) for w in TYPE_WORDS])),
    }


def has_double_escapes(p: str) -> bool:
    """A doubled backslash; or an escaped dot, where no escaped dot repeats."""
    twice, dot, dots = "\\" * 2, r"\.", r"\.*"
    return twice in p or (dot in p and dots not in p)


def has_anchors(p: str) -> bool:
    """An anchor that a match of the whole text does not need; with a negated class around a caret tells nothing."""
    return p.endswith("$") or ("^" in p and "[^" not in p)


def without_anchors(p: str) -> str:
    return p.removeprefix("^").removesuffix("$")


#: One thing that an expression wants to see: a class, or a character that means itself.
_ATOM = re.compile(r"\[[^\]\n]*\]|[^][.*+?{}()|\\^$]")
#: A short expression has at most so many atoms and characters.
SHORT_ATOMS, SHORT_LENGTH = 3, 10


def is_short_regex(p: str) -> bool:
    """A short expression, such as ``I[A-Z]``, that probably wants an open end."""
    return len(p) <= SHORT_LENGTH and len(_ATOM.findall(p)) <= SHORT_ATOMS


def pattern_lint(c: Column) -> dict[str, Column]:
    """The same three predicates on a column of patterns, inside the JVM."""
    return {
        "double_escapes": c.contains("\\" * 2) | (c.contains(r"\.") & ~c.contains(r"\.*")),
        "anchors": c.endswith("$") | (c.contains("^") & ~c.contains("[^")),
        "short": (F.length(c) <= SHORT_LENGTH) & (F.size(F.regexp_extract_all(c, F.lit(_ATOM.pattern.replace("[^][", "[^\\]\\[")), F.lit(0))) <= SHORT_ATOMS),
    }
