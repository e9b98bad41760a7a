"""Leaks against brute force over n-grams, and edited windows against edit distance."""

import random

import numpy as np

from symtide.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, item_text string"


def world(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 30, 60])))) for i in range(25)] + [(90, None), (91, ""), (92, "short")]
    items += [(93, items[2][1] + " " + items[3][1]), items[0]]
    docs = []
    for d in range(200):
        words = rng.choices(vocab, k=rng.randrange(5, 60))
        if rng.random() < 0.5:
            src = rng.choice([t for _, t in items if t]).split()
            n = rng.choice([6, 11, 12, 13, 40])
            a = rng.randrange(max(1, len(src) - n))
            cut = [w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", "​", "\n>", "**"]) for w in src[a : a + n]]
            words[3:3] = cut
        docs.append((d, " ".join(words)))
    return docs + [(900, None), (901, ""), (902, " "), (0, docs[0][1])], items


def brute(docs, items, window=12):
    grams = {}
    for i, t in items:
        w = L.words_of(t)
        for k in range(len(w) - window + 1):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    return {(d, i) for d, t in docs for w in [L.words_of(t)] for k in range(len(w) - window + 1) for i in grams.get(tuple(w[k : k + window]), ())}


def test_brute_force(spark, clash):
    docs, items = world()
    want = brute(docs, items)
    a, b = clash(spark.createDataFrame(docs, DOCS)), clash(spark.createDataFrame(items, ITEMS))
    for block in (10**6, 40):  # one block, many blocks
        got = [(r["doc_id"], r["item_id"]) for r in L.leaks(a, b, block_words=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_words():
    assert L.words_of("Foo_bar­baz, É1 x​y\r\nZ") == ["foo", "barbaz", "é1", "xy", "z"] and L.words_of(None) == [] and L.words_of("é") == ["é"]


def test_edits():
    a = np.array([1, 2, 3, 4])
    assert L.edits(a, a, 0) == 0 and L.edits(a, np.array([1, 2, 9, 4]), 0) == 1 and L.edits(a, np.array([2, 3, 4, 5]), 2) == 2 and L.edits(a, np.array([9, 9, 9, 9]), 2) == 3


def test_recall_with_edits():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 5000, size=(400, 16)).astype(np.int32)
    moved = base.copy()
    for row in moved:
        row[rng.integers(16)] = 0  # one word replaced by one that no item has
    emb = L.Embedding(16)
    a, b = emb.keys(base), emb.keys(moved)
    assert (a == b).any(axis=0).mean() >= 0.8 and (emb.keys(base[:50]) == a[:, :50]).all()


def edited(rng, row, subs, moves):
    """``row`` with ``subs`` words replaced and ``moves`` words taken out, the end filled up."""
    row = row.tolist()
    for at in rng.choice(len(row), size=subs, replace=False):
        row[at] = int(rng.integers(0, 5000))
    for _ in range(moves):
        if rng.random() < 0.5:
            row.pop(int(rng.integers(len(row))))
            row.append(0)
        else:
            row.insert(int(rng.integers(len(row))), 0)
            row.pop()
    return row


def test_every_near_window_is_found():
    rng = np.random.default_rng(6)
    base = rng.integers(1, 5000, size=(300, 16)).astype(np.int32)
    base[100:] = rng.integers(1, 4, size=(200, 16))  # few words, many near pairs
    index = L.Index([(i, [str(x) for x in row]) for i, row in enumerate(base)], 16, 2)
    nums = np.array([[index.vocabulary.get(str(x), 0) for x in row] for row in base], dtype=np.int32)
    for subs, moves in ((1, 0), (2, 0), (0, 1), (1, 1)):
        own = np.array([edited(rng, row, subs, moves) for row in nums], dtype=np.int32)
        pairs = [(d, i) for d in range(300) for i in range(300) if d // 100 == i // 100]
        a, b = own[[d for d, _ in pairs]], nums[[i for _, i in pairs]]
        near = {p for p, x, y in zip(pairs[::7], a[::7], b[::7]) if L.edits(x, y, 2) <= 2}
        assert {p for p, ok in zip(pairs[::7], L.within(a[::7], b[::7], 2)) if ok} == near
        got = index.leaked(own, np.arange(300))
        assert {p for p, ok in zip(pairs, L.within(a, b, 2)) if ok} <= got and (subs + 2 * moves > 2 or {(d, d) for d in range(300)} <= got)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert L.leaks(none, items).count() == 0 and L.leaks(spark.createDataFrame([(1, "a b")], DOCS), items.limit(0)).count() == 0


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x y " * 200_000 + item), (2, item + " ") , (3, (item + " ") * 9000)], DOCS)
    assert {r["doc_id"] for r in L.leaks(docs, spark.createDataFrame([(5, item)], ITEMS)).collect()} == {1, 2, 3}
