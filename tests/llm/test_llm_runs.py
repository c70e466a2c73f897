"""Periodic runs against a plain search of every stretch, at every lag."""

from __future__ import annotations

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest

from quillstream.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words):
    """start, length, period of all runs: each stretch at each period, less those that have a smaller one."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    s, k, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), s, k, q, k and 1000 * k // q, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([0, 5, 12, 60, 300]):
        unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]).encode() for _ in range(rng.randint(1, 40))]
        words += (unit * rng.randint(1, 12))[: rng.randint(1, 200)]
    assert [tuple(r) for r in runs.runs(runs.numbered(words)).tolist()] == plain_runs(words)


@pytest.mark.parametrize("heavy", [True, False])
def test_matches_by_transforms_and_by_pairs_are_exact(heavy, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 64 if heavy else 1 << 40)
    rng = random.Random(3)
    ids = runs.numbered([str(min(int(rng.expovariate(0.4)), 30)).encode() for _ in range(3_000)])
    want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, 1_501)]
    assert runs.matches(ids).tolist() == want


def test_nested_and_neighbouring_runs():
    inner = list("ab") * 8
    words = (inner + list("cdefg")) * 3 + list("xyz") * 5 + ["x"] * 20
    assert [tuple(r) for r in runs.runs(runs.numbered([w.encode() for w in words])).tolist()] == plain_runs(words)


def test_long_texts_of_many_repetitions_take_little_time():
    began = time.perf_counter()
    assert runs.runs(np.zeros(300_000, np.int32)).tolist() == [[0, 300_000, 1]]
    unit = np.arange(1_000)
    assert runs.runs(np.tile(unit, 300)).tolist() == [[0, 300_000, 1_000]]
    two = np.random.default_rng(5).integers(0, 2, 60_000).astype(np.int32)
    runs.runs(two)
    runs.runs(np.random.default_rng(5).zipf(1.3, 300_000).astype(np.int64).clip(max=50_000).astype(np.int32))
    assert time.perf_counter() - began < 30


def test_query_against_the_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 6_000}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert len(short) > 100 and sum(got[i][1] > 0 for i in short) > 10
    for i, text in short.items():
        assert got[i] == plain_row(i, text)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a " * 12, "a " * 11, "a b " * 6, "ä\x1cb ä\x1cb " * 6, "A a " * 9, "w " * 12 + "\x0b v"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 20), (None, None), (4, "a " * 12), (-30, "x y z " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS keep", "3 AS collapsed", "4 AS id")
    found = runs.periodic_runs(df, ["doc_id", "text", "runs", "collapsed"]).toDF("doc_id", "text", "own", "mine", "runs", "collapsed").collect()
    for r in found:
        words = WORD.findall(r["text"] or "")
        assert [tuple(x) for x in r["runs"]] == plain_runs(words)
        assert r["own"] == 1 and r["mine"] == 3
    assert {r["doc_id"]: r["collapsed"] for r in found}[6] == "a b"
    assert runs.periodic_runs(df.limit(0), ["doc_id"]).count() == 0
