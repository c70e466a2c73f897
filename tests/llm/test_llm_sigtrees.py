"""The Jaccard join by signature trees against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillstream.llm import sigtrees

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs):
    """(id, shingles, smallest reachable id) of each row, by all pairs."""
    own = [shingle_set(t) for _, t in docs]
    head = list(range(len(docs)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and 100 * len(a & own[j]) >= 80 * len(a | own[j]):
                head[top(i)] = top(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(top(i), []).append(d)
    return sorted([(d, len(own[i]), min((x for x in ids[top(i)] if x is not None), default=None) if own[i] else d) for i, (d, _) in enumerate(docs)], key=repr)


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS set", "2 AS n", "3 AS id", "4 AS mark", "5 AS prefix")
    return sorted((tuple(r) for r in sigtrees.jaccard_groups(df).collect()), key=repr)


def families(rng, n, size, length):
    """Texts of random words, with copies that differ in more and more words."""
    out = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(*length))]
        out.append(base)
        for _ in range(rng.randint(0, size)):
            own = list(rng.choice(out[-3:]))
            for _ in range(rng.randint(0, max(1, len(own) // 40)) if own else 0):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            out.append(own[rng.randint(0, 3) :])
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("tree", [4_096, 6])
def test_families_against_all_pairs(spark, monkeypatch, tree):
    monkeypatch.setattr(sigtrees, "TREE", tree)
    monkeypatch.setattr(sigtrees, "STEP", 8)
    rng = random.Random(tree)
    texts = families(rng, 30, 12, (1, 200)) + families(rng, 1, 60, (120, 120))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {t}" for t in families(rng, 20, 0, (5, 60))] + ["one two three", "One two\tthree", "one two three four"]
    docs = [(7 * i % 1_009, t) for i, t in enumerate(texts)]
    want = plain(docs)
    assert len({c for _, _, c in want}) < len(docs) - 60
    assert found(spark, docs) == want


def test_a_similarity_of_exactly_the_threshold_links(spark):
    words = [f"a{i}" for i in range(13)]  # 9 shingles
    more = [*words, "z"]  # 10, of which 9 are the same
    assert found(spark, [(2, " ".join(words[:12])), (1, " ".join(more))]) == [(1, 10, 1), (2, 8, 1)]  # 8 of 10
    assert found(spark, [(2, " ".join(words[:11])), (1, " ".join(more))]) == [(1, 10, 1), (2, 7, 2)]


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a"), (3, "A"), (4, "a b"), (None, "a"), (None, None), (5, long), (6, long + " end"), (7, "é\x1c b c d e f"), (7, "é\x1c B c d e f"), (None, "no other"), (8, "x " * 500)]
    assert found(spark, docs) == plain(docs)
    assert found(spark, docs[:3]) == plain(docs[:3]) and found(spark, []) == []


def test_no_pair_of_nodes_with_a_link_below_is_left_out():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    own = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(200)]
    bits = np.array([sigtrees.bitmap(o) for o in own])
    n = np.array([len(o) for o in own])
    spare = n - np.bitwise_count(bits).sum(axis=1)
    level = sigtrees.Nodes(np.zeros(200, int), n, n, spare, bits, np.arange(200), np.arange(200))
    similar = [(i, j) for i in range(200) for j in range(i) if 9 * len(np.intersect1d(own[i], own[j])) >= 4 * (n[i] + n[j])]
    assert similar
    where = np.arange(200)
    while True:
        i, j = (where[np.array(x)] for x in zip(*similar, strict=True))
        apart = i != j
        assert len(sigtrees.may_link(level, i[apart], level, j[apart])) == apart.sum()
        if len(level.tree) == 1:
            break
        level = level.above()
        where = np.searchsorted(level.first, where, "right") - 1
