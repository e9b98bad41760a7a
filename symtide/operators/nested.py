"""Deeply nested semi-structured records to related flat tables.

Method: Merkle subtree identities. Every object is canonicalised and hashed bottom
up (its children stand in it as their hashes), identical objects are stored once - a
genInfo and the tools it names as well, which are objects of their own levels -
and every occurrence is kept as a bridge row from parent to child with its ordinal
and path.

Defined results: of each conversation the readable record with the greatest
(loaded_at, record_id) counts, null loaded_at being the oldest; null conv_ids,
unreadable texts and texts that are no JSON object give nothing; elements of lists
that are no objects take a position but give no row; a lone object stands for a
list of one; all other values where a list is usual give no rows. Both kinds of plain
value stay in the canonical object as they are, so objects that differ in them differ.
"""

from __future__ import annotations

import hashlib
import json
import json.decoder
import json.scanner
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOLS_KEY = "llm.prediction.tools"
NODE_SCHEMA = "conv_id long, node_level string, node_path string, parent_path string, ordinal int, node_hash string, parent_hash string, body string"
#: The levels of the flat tables; beside them the bridge has 'conversation' and 'gen_info'.
LEVELS = ("message", "version", "step", "content", "tool")


def _deep_decoder() -> json.JSONDecoder:
    """A decoder without the depth limit of the C scanner: it recurses in Python only."""
    d = json.JSONDecoder()
    d.parse_object, d.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
    d.scan_once = json.scanner.py_make_scanner(d)
    return d


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 4 * len(text) + 1000))
        try:
            return _deep_decoder().decode(text)
        finally:
            sys.setrecursionlimit(limit)


def canonical(x: object) -> str:
    """JSON with sorted keys and no blanks, of any depth."""
    try:
        return json.dumps(x, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        out, todo = [], [(False, x)]
        while todo:
            ready, y = todo.pop()
            if ready:
                out.append(y)
            elif isinstance(y, dict) and y:
                parts = [p for k in sorted(y) for p in ((True, ","), (True, json.dumps(k) + ":"), (False, y[k]))][1:]
                todo += reversed([(True, "{"), *parts, (True, "}")])
            elif isinstance(y, list) and y:
                parts = [p for v in y for p in ((True, ","), (False, v))][1:]
                todo += reversed([(True, "["), *parts, (True, "]")])
            else:
                out.append(json.dumps(y))
        return "".join(out)


def read_object(text: str | None) -> dict | None:
    """The JSON object of an exported text, however deep and however often wrapped as a JSON string, or None if it cannot be read."""
    got: object = text
    while isinstance(got, str):
        t = got.strip()
        while t.startswith("\ufeff"):
            t = t[1:].lstrip()
        try:
            got = _loads(t)
        except ValueError:
            return None
    return got if isinstance(got, dict) else None


def _list(x: object) -> list:
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def _get(x: object, key: str) -> object:
    return x.get(key) if isinstance(x, dict) else None


def _digest(x: object) -> str:
    return hashlib.sha256(canonical(x).encode()).hexdigest()[:32]


class Flattener:
    """The nodes of one conversation, hashed bottom up."""

    def __init__(self, with_bodies: bool):
        self.with_bodies, self.rows = with_bodies, []

    def node(self, level: str, path: str, above: str, at: int, obj: dict, hashes: dict[str, list]) -> str:
        """Emit ``obj``, where ``hashes`` stand for the objects of child lists, and give its identity.

        In ``#field`` an object's hash is a text and a plain element a list of that one element; a
        field that is neither list nor object stays in place.
        """
        lists = {k: v for k, v in hashes.items() if isinstance(obj.get(k), list | dict)}
        small, names = {k: v for k, v in obj.items() if k not in lists}, []
        for k, v in lists.items():
            name = f"#{k}"
            while name in small:  # a field of the object itself
                name = f"#{name}"
            small[name] = v
            names.append(name)
        own = _digest([level, small, names])
        self.rows.append((level, path, above, at, own, canonical(small) if self.with_bodies else None))
        return own

    def many(self, xs: list, level: str, above: str, fill) -> list:
        """Hashes of the elements in order; those that are no objects as lists of themselves."""
        out = []
        for i, x in enumerate(xs):
            out.append(fill(x, f"{above}/{i}" if above else str(i), above, i) if isinstance(x, dict) else [x])
        return out

    def content(self, x, path, above, i):
        return self.node("content", path, above, i, x, {})

    def step(self, x, path, above, i):
        hashes = {"content": self.many(_list(x.get("content")), "content", path, self.content)}
        if isinstance(x.get("genInfo"), dict):
            hashes["genInfo"] = [self.gen_info(x["genInfo"], path)]
        return self.node("step", path, above, i, x, hashes)

    def gen_info(self, x: dict, path: str) -> str:
        """A genInfo with the tools it names as objects of their own; its path is that of the step and ``g``."""
        own, config = f"{path}/g", x.get("predictionConfig")
        fields = _list(_get(config, "fields"))
        for f, field in enumerate(fields):
            value = _get(field, "value")
            if _get(field, "key") == TOOLS_KEY and isinstance(_get(value, "tools"), list | dict):
                found = [self.node("tool", f"{path}/{f}/{t}", own, t, tool, {}) if isinstance(tool, dict) else [tool] for t, tool in enumerate(_list(value["tools"]))]
                fields = [*fields[:f], field | {"value": {k: v for k, v in value.items() if k != "tools"} | {"#tools": [found, "#tools" in value and value["#tools"]]}}, *fields[f + 1 :]]
        small = x | {"predictionConfig": config | {"fields": fields}} if fields else x
        return self.node("gen_info", own, path, 0, small, {})

    def version(self, x, path, above, i):
        hashes = {"steps": self.many(_list(x.get("steps")), "step", path, self.step)}
        own = self.many(_list(x.get("content")), "content", f"{path}/-", self.content)
        return self.node("version", path, above, i, x, hashes | {"content": own})

    def message(self, x, path, above, i):
        return self.node("message", path, above, i, x, {"versions": self.many(_list(x.get("versions")), "version", path, self.version)})

    def conversation(self, x: dict) -> list[tuple]:
        hashes = self.many(_list(x.get("messages")), "message", "", self.message)
        self.node("conversation", "", None, 0, x, {"messages": hashes})
        return self.rows


@F.pandas_udf(T.BooleanType())
def _readable(s: pd.Series) -> pd.Series:
    return s.map(lambda t: read_object(t) is not None)


def latest_readable(conversations: DataFrame) -> DataFrame:
    """(conv_id, raw_json): the text that counts for each conversation."""
    ok = conversations.filter(F.col("conv_id").isNotNull() & F.col("raw_json").isNotNull()).filter(_readable("raw_json"))
    return ok.groupBy("conv_id").agg(F.max_by("raw_json", F.struct("loaded_at", "record_id")).alias("raw_json"))


def nodes(conversations: DataFrame, with_bodies: bool = True) -> DataFrame:
    """Every object of every conversation as a bridge row, see ``NODE_SCHEMA``.

    ``body`` is the canonical object with its children as hashes; ``with_bodies=False``
    leaves it null, the identities stay.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["conv_id", "node_level", "node_path", "parent_path", "ordinal", "node_hash", "parent_hash", "body"]
        for b in batches:
            out = []
            for conv, text in zip(b["conv_id"], b["raw_json"]):
                rows = Flattener(with_bodies).conversation(read_object(text))
                by_path = {r[1]: r[4] for r in rows}
                for level, path, above, at, own, body in rows:
                    up = above[:-2] if above and above.endswith("/-") else above
                    out.append((conv, level, path, up, at, own, by_path.get(up), body))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
            yield pd.DataFrame(out, columns=cols)

    return latest_readable(conversations).mapInPandas(flatten, NODE_SCHEMA)


def objects(bridge: DataFrame) -> DataFrame:
    """The identical objects of ``nodes`` once each: (node_hash, node_level, body, n_occurrences)."""
    return bridge.groupBy("node_hash", "node_level").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))
