"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: every pre-token starts as a doubly linked list of bytes; a priority queue
holds the merge ranks of adjacent pairs, stale entries are skipped when they come
up, and each merge relinks its neighbours in O(log n). Decoding concatenates the
vocabulary's byte strings.

Pre-tokens repeat heavily, so each worker keeps the ids of those it has met in a
table of bounded size (it is emptied when full; results never depend on it).

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; repeated rows are encoded each; other columns are left
alone. Unpaired surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
VOCABULARIES = os.environ.get("SYMTIDE_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that the byte-level BPE vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens one worker remembers.
REMEMBERED = 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = REMEMBERED):
        self.ranks, self.split, self.known, self.remembered = ranks, regex.compile(pattern), {}, remembered
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.words = {i: t for t, i in ranks.items()}

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        end = list(range(1, n + 1))  # a symbol is raw[i:end[i]] of its first byte i
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue = []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, to = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue  # one of the two symbols has changed since: a stale entry
            end[i], alive[j] = to, False
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                r = ranks.get(raw[i : end[k]])
                if r is not None:
                    heapq.heappush(queue, (r, i, end[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get(raw[h:to])
                if r is not None:
                    heapq.heappush(queue, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for m in self.split.findall(text):
            ids = known.get(m)
            if ids is None:
                ids = self.piece(m.encode("utf-8"))
                if len(known) >= self.remembered:
                    known.clear()
                if len(m) <= 64:
                    known[m] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


def _file(name: str, folder: str | None) -> bytes:
    with open(os.path.join(folder or VOCABULARIES, name), "rb") as f:
        return f.read()


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text. The vocabulary (below 1 MB) is broadcast as read."""
    told = documents.sparkSession.sparkContext.broadcast(_file(vocabulary, folder))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = BytePairEncoder(read_ranks(told.value))
        for b in batches:
            # Small slices, so the ids of long texts never pile up.
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"key": part["key"], "ids": [bpe.encode(t if isinstance(t, str) else None) for t in part["text"]]})

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, text): the texts of ``encode``; null texts come back empty."""
    told = encoded.sparkSession.sparkContext.broadcast(_file(vocabulary, folder))
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = {i: t for t, i in read_ranks(told.value).items()}
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "text": [b"".join(words[i] for i in x).decode("utf-8", "replace") for x in b["ids"]]})

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)
