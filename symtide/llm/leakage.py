"""Evaluation texts that leak into a training corpus.

Method: every item-sized word window is embedded by the CGK random walk, which
turns edit distance into Hamming distance; repeated bit-sampling LSH over the
embeddings proposes pairs of windows and an exact check decides. Equal windows
always embed alike, so with ``max_edits=0`` the recall is 1 by construction. With
edits the tables alone miss pairs, so every item window is also cut into
``max_edits + 1`` seeds, one of which any near copy holds unedited; looking all seeds
up makes the recall 1 there as well.

The items are a stated query set: they are taken in blocks of bounded size, and
each block is broadcast and run against all documents. Words that no item has are
told apart at once, so only stretches of item words are embedded at all.

Defined results: words are runs of letters or digits after lower-casing, with
invisible characters removed; null, empty and short texts leak nothing; items with
fewer words than a window cannot leak; items with equal windows are all named;
repeated rows of a document or an item give one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak.
WINDOW = 12
#: LSH tables and the positions of the embedding that each one samples.
TABLES, SAMPLED = 6, 10
#: Words of the items that one broadcast block holds at most.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def _invisible() -> re.Pattern:
    """Format characters and the other characters that show nothing and part no words."""
    odd = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
    cs = [chr(c) for c in range(0x20, 0xE0200) if c in odd or unicodedata.category(chr(c)) == "Cf"]
    cs += [chr(c) for c in range(0x20) if c not in (9, 10, 11, 12, 13, 28, 29, 30, 31)] + [chr(0x7F)]
    return re.compile("[" + "".join(map(re.escape, cs)) + "]+")


_INVISIBLE = _invisible()
_ASCII_INVISIBLE = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text as they count here."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    else:
        text = _ASCII_INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


class Embedding:
    """CGK random walk over word ids, and the sampled positions of each LSH table."""

    def __init__(self, window: int, tables: int = TABLES, sampled: int = SAMPLED, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window, self.length = window, 3 * window
        self.steps = rng.integers(1, 2**63, size=self.length, dtype=np.uint64) | np.uint64(1)
        self.samples = [np.sort(rng.choice(self.length, size=min(sampled, self.length), replace=False)) for _ in range(tables)]
        self.mix = rng.integers(1, 2**63, size=self.length, dtype=np.uint64) | np.uint64(1)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` (n windows x words) to (n x 3 * words); 0 pads what the walk leaves over."""
        n, w = ids.shape
        padded = np.concatenate([ids, np.zeros((n, 1), dtype=ids.dtype)], axis=1).astype(np.uint64)
        at = np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        out = np.empty((n, self.length), dtype=np.uint64)
        for j in range(self.length):
            x = padded[rows, at]
            out[:, j] = x
            bit = ((x + np.uint64(0x9E3779B97F4A7C15)) * self.steps[j]) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), w)
        return out

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """(tables x n) bucket keys of windows."""
        e = self.embed(ids)
        out = np.empty((len(self.samples), len(ids)), dtype=np.uint64)
        for t, s in enumerate(self.samples):
            k = np.full(len(ids), t + 1, dtype=np.uint64)
            for p in s:
                k = (k ^ (e[:, p] + self.mix[p])) * np.uint64(0x100000001B3)
                k ^= k >> np.uint64(29)
            out[t] = k
        return out


def seed_places(window: int, most: int) -> list[tuple[int, int, list[int]]]:
    """(start, length, starts in a copy) of the ``most + 1`` seeds of a window.

    Both windows are equally long, so each shift is undone within the window and costs
    two edits: an unedited seed stands at most ``most // 2`` words off its place.
    """
    cuts = [window * i // (most + 1) for i in range(most + 2)]
    return [(a, b - a, [at for at in range(a - most // 2, a + most // 2 + 1) if 0 <= at <= window - (b - a)]) for a, b in zip(cuts, cuts[1:])]


def seed_keys(words: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of word ids."""
    k = np.full(len(words), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for j in range(words.shape[1]):
        k = (k ^ (words[:, j].astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(31)
    return k


def within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (n x words) are at most ``most`` edits apart; only places up to ``most // 2`` off the diagonal can be."""
    n, w = a.shape
    band, far = most // 2, np.full(len(a), most + 1, dtype=np.int8)
    row = {j: np.full(n, j, dtype=np.int8) for j in range(band + 1)}
    for i in range(1, w + 1):
        new: dict[int, np.ndarray] = {}
        for j in range(max(0, i - band), min(w, i + band) + 1):
            if j == 0:
                new[0] = np.full(n, i, dtype=np.int8)
                continue
            best = row[j - 1] + (a[:, i - 1] != b[:, j - 1])
            best = np.minimum(best, np.minimum(row.get(j, far), new.get(j - 1, far)) + 1)
            new[j] = np.minimum(best, far).astype(np.int8)
        row = new
    return row[w] <= most


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two windows, or ``most + 1`` if it is larger."""
    if most == 0:
        return int(not np.array_equal(a, b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


class Index:
    """One block of items: their vocabulary, windows and LSH tables."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, max_edits: int):
        self.window, self.max_edits = window, max_edits
        self.vocabulary: dict[str, int] = {}
        ids, owners = [], []
        for item, words in items:
            nums = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(len(nums) - window + 1):
                ids.append(nums[i : i + window])
                owners.append(item)
        self.empty = not ids
        if self.empty:
            return
        self.embedding = Embedding(window)
        # Windows that several items share are kept once, with all their owners.
        self.windows, inverse = np.unique(np.array(ids, dtype=np.int32), axis=0, return_inverse=True)
        self.owners: list[set[int]] = [set() for _ in self.windows]
        for w, item in zip(inverse.ravel().tolist(), owners):
            self.owners[w].add(item)
        keys = self.embedding.keys(self.windows)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.seeds: list[tuple[int, list[int], np.ndarray, np.ndarray]] = []
        for a, n, places in seed_places(window, max_edits) if max_edits else []:
            k = seed_keys(self.windows[:, a : a + n])
            by = np.argsort(k, kind="stable")
            self.seeds.append((n, places, k[by], by))

    def stretches(self, nums: np.ndarray) -> np.ndarray:
        """Starts of the windows of a document that hold enough item words to match."""
        if len(nums) < self.window:
            return np.empty(0, dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(nums > 0)])
        return np.flatnonzero(known[self.window :] - known[: -self.window] >= self.window - self.max_edits)

    def leaked(self, own: np.ndarray, docs: np.ndarray) -> set[tuple[int, int]]:
        """(doc, item) of the windows ``own``, each of a document ``docs``, that copy an item's window up to ``max_edits``."""
        if self.max_edits:
            return self.near(own, docs)
        keys = self.embedding.keys(own)
        found: set[tuple[int, int]] = set()
        tried: set[tuple[int, int]] = set()
        for t in range(len(keys)):
            lo = np.searchsorted(self.keys[t], keys[t], side="left")
            hi = np.searchsorted(self.keys[t], keys[t], side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                for k in self.order[t, lo[i] : hi[i]].tolist():
                    if (i, k) not in tried:
                        tried.add((i, k))
                        if edits(own[i], self.windows[k], self.max_edits) <= self.max_edits:
                            found.update((int(docs[i]), item) for item in self.owners[k])
        return found


    def near(self, own: np.ndarray, docs: np.ndarray) -> set[tuple[int, int]]:
        """``leaked`` with edits: the tables and all seeds propose, ``within`` decides."""
        asked = [(k, self.keys[t], self.order[t]) for t, k in enumerate(self.embedding.keys(own))]
        asked += [(seed_keys(own[:, at : at + n]), k, by) for n, places, k, by in self.seeds for at in places]
        found: set[tuple[int, int]] = set()
        for mine, keys, order in asked:
            lo, hi = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
            ends = np.cumsum(hi - lo)
            total = int(ends[-1]) if len(ends) else 0
            for first in range(0, total, PAIRS_AT_ONCE):
                at = np.arange(first, min(first + PAIRS_AT_ONCE, total))
                i = np.searchsorted(ends, at, side="right")
                k = order[hi[i] - ends[i] + at]
                ok = np.flatnonzero(within(own[i], self.windows[k], self.max_edits))
                hits = np.unique(np.stack([docs[i[ok]], k[ok]], axis=1), axis=0)
                found.update((doc, item) for doc, w in hits.tolist() for item in self.owners[w])
        return found


#: Pairs of windows that are compared at a time.
PAIRS_AT_ONCE = 200_000
#: Windows that are embedded at a time.
WINDOWS_AT_ONCE = 50_000


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of bounded size, one at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = words_of(r[1])
        block.append((r[0], words))
        size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, max_edits: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a window of an item."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    out = None
    for block in _blocks(items.select("item_id", "item_text").filter(F.col("item_text").isNotNull()).distinct(), block_words):
        index = Index(block, window, max_edits)
        if index.empty:
            continue
        told = spark.sparkContext.broadcast(cloudpickle.dumps(index))  # as bytes, so no executor needs this module

        def probe(batches: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
            ix = cloudpickle.loads(told.value)
            known = ix.vocabulary.get
            own, docs, size = [], [], 0

            def flush() -> pd.DataFrame:
                hits = sorted(ix.leaked(np.concatenate(own), np.concatenate(docs)))
                own.clear()
                docs.clear()
                return pd.DataFrame(hits, columns=["doc_id", "item_id"], dtype="int64")

            for b in batches:
                for doc, text in zip(b["doc_id"], b["text"]):
                    ws = words_of(text)
                    nums = np.fromiter((known(w, 0) for w in ws), dtype=np.int32, count=len(ws))
                    starts = ix.stretches(nums)
                    for at in range(0, len(starts), WINDOWS_AT_ONCE):
                        some = starts[at : at + WINDOWS_AT_ONCE]
                        own.append(nums[some[:, None] + np.arange(ix.window)])
                        docs.append(np.full(len(some), doc, dtype=np.int64))
                        size += len(some)
                        if size >= WINDOWS_AT_ONCE:
                            yield flush()
                            size = 0
            if own:
                yield flush()

        got = texts.mapInPandas(probe, "doc_id long, item_id long")
        out = got if out is None else out.unionByName(got)
    return out.distinct() if out is not None else spark.createDataFrame([], "doc_id long, item_id long")
