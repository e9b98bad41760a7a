"""A small generalised LL recogniser with a graph-structured stack.

Ambiguous and left-recursive grammars are fine: every (slot, stack node, position)
is worked off once, stack nodes are shared, and what a stack node has returned
already is replayed to those who come later. ``extract`` walks one derivation.
"""

from __future__ import annotations

Grammar = dict[str, list[tuple[str, ...]]]


class Parse:
    """All completed spans of ``start`` from position ``at`` over token categories."""

    def __init__(self, grammar: Grammar, tokens: list[str], start: str, at: int = 0):
        self.grammar, self.tokens = grammar, tokens
        self.ends: dict[tuple[str, int], set[int]] = {}
        callers: dict[tuple[str, int], set] = {}
        todo: list[tuple] = []
        seen: set[tuple] = set()

        def add(*d) -> None:
            if d not in seen:
                seen.add(d)
                todo.append(d)

        def call(name: str, i: int, back: tuple | None) -> None:
            node = (name, i)
            fresh = node not in callers
            known = callers.setdefault(node, set())
            if back is not None and back not in known:
                known.add(back)
                for j in self.ends.get(node, ()):
                    add(*back, j)
            if fresh:
                for alt in range(len(grammar[name])):
                    add(name, alt, 0, i, i)

        call(start, at, None)
        while todo:
            # a slot: nonterminal, alternative, dot; where it began; where it is
            name, alt, dot, began, i = todo.pop()
            rule = grammar[name][alt]
            while dot < len(rule) and rule[dot] not in grammar:
                if i < len(tokens) and tokens[i] == rule[dot]:
                    dot, i = dot + 1, i + 1
                else:
                    dot = -1
                    break
            if dot < 0:
                continue
            if dot < len(rule):
                call(rule[dot], i, (name, alt, dot + 1, began))
            else:
                node = (name, began)
                if i not in (got := self.ends.setdefault(node, set())):
                    got.add(i)
                    for back in callers.get(node, ()):
                        add(*back, i)
        self.start, self.at = start, at

    def accepted(self) -> list[int]:
        return sorted(self.ends.get((self.start, self.at), ()))

    def extract(self, name: str, i: int, j: int, wanted: frozenset[str]) -> list[tuple[str, int, int]]:
        """(nonterminal, from, to) of the wanted ones in one derivation, in order of the text."""
        done: dict[tuple, list | None] = {}

        def rule_spans(rule: tuple[str, ...], k: int, i: int, j: int) -> list | None:
            key = (rule, k, i, j)
            if key in done:
                return done[key]
            done[key] = None  # a loop through here gives nothing new
            out = None
            if k == len(rule):
                out = [] if i == j else None
            elif rule[k] not in self.grammar:
                if i < j and self.tokens[i] == rule[k]:
                    out = rule_spans(rule, k + 1, i + 1, j)
            else:
                for m in sorted(self.ends.get((rule[k], i), ()), reverse=True):
                    if m <= j:
                        rest = rule_spans(rule, k + 1, m, j)
                        if rest is not None:
                            own = node_spans(rule[k], i, m)
                            if own is not None:
                                out = own + rest
                                break
            done[key] = out
            return out

        def node_spans(name: str, i: int, j: int) -> list | None:
            for rule in self.grammar[name]:
                got = rule_spans(rule, 0, i, j)
                if got is not None:
                    return ([(name, i, j)] if name in wanted else []) + got
            return None

        return node_spans(name, i, j) or []
