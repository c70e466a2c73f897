"""Ranked search over treaps against a plain ranking of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillstream.llm import treaps

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item, rank, doc, score) with every document scored for every item."""
    own = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "3 AS id", "4 AS query")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS copies", "2 AS rank")
    return sorted((tuple(r) for r in treaps.rank(d, b, k).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_rank_of_random_documents(spark, monkeypatch, k):
    monkeypatch.setattr(treaps, "CELLS", 64)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÄÖ", "Straße", "Z9"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(1, 63)]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(400)]
    docs += [(i, docs[i % 7][1]) for i in range(400, 460)]  # copies: ties
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(25)]
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_rank_over_blocks_and_sets_of_queries(spark, monkeypatch):
    monkeypatch.setattr(treaps, "ROWS", 16)
    monkeypatch.setattr(treaps, "QUERY_BYTES", 100)
    rng = random.Random(9)
    docs = [(rng.randint(0, 90), " ".join(f"t{int(rng.expovariate(0.3))}" for _ in range(rng.randint(1, 60)))) for _ in range(200)]
    items = [(i % 8, " ".join(f"T{rng.randint(0, 12)}" for _ in range(6))) for i in range(12)]
    assert found(spark, docs, items, 5) == plain(docs, items, 5)


def test_odd_rows(spark):
    docs = [(0, None), (1, ""), (2, "?!.\n"), (3, "a"), (3, "a"), (3, "A b"), (None, "a b c"), (None, None), (5, "ßa\x1cb_c-d 0x"), (6, "a " * 40_000)]
    items = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "b C"), (4, "nothing of it"), (5, "c ßa 0X a")]
    for k in (1, 2, 50):
        assert found(spark, docs, items, k) == plain(docs, items, k)
    assert found(spark, docs, [], 5) == [] and found(spark, [], items, 5) == [] and found(spark, [(1, None)], items, 5) == []


def test_walks_cut_off_most_of_a_block():
    """Rare strong matches are found without scoring the common weak ones."""
    rng = np.random.default_rng(4)
    n = 16_384
    strong = np.sort(rng.choice(n, 80, replace=False))
    term = np.concatenate([np.zeros(n, int), np.ones(80, int)])
    place, impact = np.concatenate([np.arange(n), strong]), np.concatenate([rng.integers(50, 100, n), rng.integers(4_000, 5_000, 80)])
    held = treaps.Best(50)
    held.block = np.arange(n), np.zeros(n, bool)
    scored = []
    held.add = lambda places, scores, add=held.add: (scored.append(len(places)), add(places, scores))
    treaps.Treaps(term, place, impact, 2).walk(np.array([0, 1]), n - 1, held)
    total = impact[:n] + np.bincount(strong, impact[n:], n).astype(int)
    assert held.scores.tolist() == sorted(total.tolist(), reverse=True)[:50]
    assert sum(scored) < 400


def test_treaps_stay_shallow_where_impacts_rise_with_documents():
    n = 20_000
    own = treaps.Treaps(np.zeros(n, int), np.arange(n), np.linspace(100_000, 900_000, n).astype(int), 1)
    level, depth = own.roots, 0
    while len(level):
        level, depth = np.concatenate([own.left[level], own.right[level]]), depth + 1
        level = level[level != own.none]
    assert depth < 400
