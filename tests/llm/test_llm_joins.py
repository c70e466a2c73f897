"""Top-k search, line dedup, licences, decontamination, URL filters and the pipeline against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from against import oracle, spark_rows
from pyspark.sql import functions as F

from quillstream.llm import common, decontaminate, licenses, lines, queries, topk, urls
from quillstream.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    got, want = spark_rows(queries.QUERIES[name](spark, sf_dir)), oracle(ORACLES[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]


# Top-k


def plain_top_k(rows, k):
    """query row to its k best (vec_id, score), with integers of any size; rows are known by their place."""
    whole = [(i, None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) else [64 * int(c) if abs(c) >= 2.0**56 else math.floor(64 * c) for c in v]) for i, v in rows]
    out = []
    for n, (q_id, q) in enumerate(whole):
        if q is not None and q_id is not None and q_id % 20 == 0:
            found = [(-sum(a * b for a, b in zip(q, c, strict=False)), i is None, i or 0) for m, (i, c) in enumerate(whole) if m != n and c is not None]
            out += [(q_id, r, None if none else i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [0.5, 0.5]), (8, []), (20, [0.0, -0.001]), (None, [0.5, 0.5]), (9, [2.0]), (0, [1.0, 0.5]), (20, [1.0, 2.0])]
    rows += [(40, [1.0]), (41, [4e6]), (42, [5e6]), (43, [4e6, 1e30]), (60, [-3e300, 2.5]), (61, [1e300]), (62, [-2e300, -7.0]), (63, [-1e300, 1.0]), (40, [1.0]), (0, [1e17, -1e17])]
    for k in (2, 4, 50):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()]
        assert sorted(got, key=repr) == plain_top_k(rows, k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    assert topk.top_k(df.where("vec_id = 60"), F.lit(True)).count() == 0


def test_top_k_over_several_tiles(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i % 150, [rng.choice([0.0, 0.0, rng.uniform(-2, 2)]) for _ in range(12)]) for i in range(300)]
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "TILE_QUERIES", 1)
    monkeypatch.setattr(topk, "TILE_CANDIDATES", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()), key=repr) == plain_top_k(rows, 7)


def test_top_k_has_a_score_for_sparse_postings():
    import numpy as np

    rng = np.random.default_rng(0)
    c = rng.integers(-64, 64, (500, 16)) * (rng.random((500, 16)) < 0.1)
    q = rng.integers(-64, 64, (5, 16)) * (rng.random((5, 16)) < 0.4)
    for row, total in zip(q, topk.scores(q, c), strict=True):
        assert (total == c @ row).all()


# Lines


def plain_lines(docs):
    """doc_id to kept lines, by comparing every line to all before it."""
    before, out = [], {}
    for i, text in sorted(docs):
        kept = []
        for line in [] if text is None else text.split("\n"):
            words = set(filter(None, re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))))
            if words:
                if any(5 * len(words & w) >= 4 * len(words | w) for w in before):
                    before.append(words)
                    continue
                before.append(words)
            kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    texts = []
    for _ in range(120):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(pool))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.3:
                line.append(rng.choice(words))
            own.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        texts.append("\n".join(own))
    texts += ["", None, "\n\n", "a b c d e\na b c d e", "long " * 30_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, n_chars long, place string")
    got = lines.drop_similar_lines(docs, length="n_chars")
    assert got.columns == docs.columns
    want = plain_lines(rows)
    for r in got.collect():
        assert r["text"] == want[r["doc_id"]], r["doc_id"]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    twice = lines.drop_similar_lines(docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5")))
    assert twice.count() == 10
    assert lines.drop_similar_lines(docs.limit(0)).count() == 0


def test_short_lines_are_deduplicated(spark):
    texts = ["Les.\n\nAnd ornd.\nlong long long long long long", "LES.\n\nornd. and\nlong long\nAnd ornd. too", None, "Les.\n \nunbroken" + "x" * 50, "unbroken" + "x" * 50 + "\na b c d\na b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs).collect()}
    assert got == {0: texts[0], 1: "\nAnd ornd. too", 2: None, 3: " \nunbroken" + "x" * 50, 4: "a b c d"}  # four of five words are a similarity of 0.8
    assert got == plain_lines(list(enumerate(texts)))


def test_texts_and_words_are_split_once(spark, monkeypatch):
    plans, names = [], []

    def seen(df, name, run=lines.saved):
        names.append(name)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return run(df, name)

    monkeypatch.setattr(lines, "saved", seen)
    docs = spark.createDataFrame([(0, "a b c d e\nf g"), (1, "a b c d e x\nh i")], "doc_id long, text string")
    assert [r["text"] for r in lines.drop_similar_lines(docs).orderBy("doc_id").collect()] == ["a b c d e\nf g", "h i"]
    assert "lines-tokens" not in names  # no table of all words is stored
    filters = [line for plan in plans for line in plan.split("\n") if re.match(r"[\s:+-]*Filter ", line)]
    assert filters and not [line for line in filters if "split(text" in line]  # Spark adds such filters to a plain explode


def test_buckets_of_rarity_are_counted_whole_and_in_few_rows(spark, monkeypatch):
    """Rows of ``SIDE`` buckets: 2^16 of them, which Spark's fast map holds."""
    assert lines.BUCKETS // lines.SIDE <= 1 << 16
    rng = random.Random(2)
    texts = [None, "", " \n"] + ["\n".join(" ".join(f"W{rng.randrange(3000)}" for _ in range(20)) for _ in range(5)) for _ in range(60)]
    words = [w for t in texts for w in (t or "").lower().split()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").select("w", F.xxhash64("w").bitwiseAND(F.lit(lines.BUCKETS - 1)).alias("b")).collect()
    bucket, times = {r["w"]: r["b"] for r in hashes}, Counter()
    for w in words:
        times[bucket[w]] += 1
    got = lines.rarity(docs)
    assert {b: x for b, x in enumerate(got) if x} == {b: math.ceil(math.log2(n)) for b, n in times.items() if n > 1}


def test_lines_join_by_hash_tables_where_partitions_are_small(spark, monkeypatch):
    def joins(most):
        monkeypatch.setattr(common, "HASHED", most)
        a, b = (spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias(x)) for x in "ab")
        both = a.join(b.where("b > 4500"), "k")
        with common.hashed_joins(spark):
            both.collect()
        return re.findall(r"ShuffledHashJoin|SortMergeJoin", both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])

    def seen(df, name, run=lines.saved):
        asked[name] = spark.conf.get(common.HASHED_UP_TO)
        return run(df, name)

    before, broadcast = spark.conf.get(common.HASHED_UP_TO), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1b")
    try:
        assert set(joins("64m")) == {"ShuffledHashJoin"}
        assert set(joins("1b")) == {"SortMergeJoin"}  # a larger partition is sorted, which Spark can spill
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)
    monkeypatch.setattr(common, "HASHED", "64m")
    asked = {}
    monkeypatch.setattr(lines, "saved", seen)
    docs = spark.createDataFrame([(0, "a b c d e\nf g"), (1, "a b c d e x\nh i")], "doc_id long, text string")
    assert [r["text"] for r in lines.drop_similar_lines(docs).orderBy("doc_id").collect()] == ["a b c d e\nf g", "h i"]
    assert asked["lines-pairs"] == "64m"
    assert spark.conf.get(common.HASHED_UP_TO) == before


def test_words_differ_by_all_but_the_case_of_ascii(spark):
    words = ["\u00c9A", "\u00e9a", "\u0389B", "\u03a9b", "\u03c9b", "\u00c3\u00a9", "\u00e3\u00a9", "\u00d7", "\u00f7", "\u0130I", "\u0131i", "\u212aK", "kk", "\u20ac", "\u0080", "\u0420", "\U00010420", "\U00020420", "\u8420", "\u00a0", "\u0085"]
    texts = words + ["\u00c9a", "\u212ak", "\u0130i", "KK", "x\t\u00e9A\x0bY\rz", "X y\x0c\u00e9a Z", "X y\x0c\u00c9a Z", "p\u00e9\tq r", "P\u00e9 Q\x0cR"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs).collect()}
    assert got == plain_lines(list(enumerate(texts)))


def test_large_lines_match_brute_force(spark):
    """Sets around the size from which parities are 128, some on each side of it."""
    rng = random.Random(5)
    texts = []
    for f in range(12):
        base = [f"f{f % 4}w{i}" for i in range(rng.randint(lines.LARGE - 14, lines.LARGE + 60))]
        for _ in range(8):
            own = base[rng.randint(0, 12) :]
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs).collect()}
    assert got == plain_lines(list(enumerate(texts)))


@pytest.mark.parametrize("m", [100, 400])
def test_families_of_lines_cost_linear_pairs(spark, monkeypatch, m):
    rng = random.Random(m)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(m):
        own = list(base)
        for k in range(3):
            own[rng.randrange(60)] = f"n{i}x{k}"
        texts.append(" ".join(own))
    seen = []
    monkeypatch.setattr(lines, "_later", lambda pairs, *rest, run=lines._later: (seen.append(pairs.count()), run(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs).collect()}
    assert got == plain_lines(list(enumerate(texts)))
    assert sum(seen) <= 6 * m


def test_lines_joined_in_parts_are_exact(spark, monkeypatch):
    """Each part has its own words, so that no join shuffles the postings of all lines at once."""
    monkeypatch.setattr(lines, "MANY", 0)
    monkeypatch.setattr(lines, "PARTS", 4)
    sizes = []

    def part(posted, k, parts, run=lines._part):
        out = run(posted, k, parts)
        sizes.append((k, out.count(), posted.count()))
        return out

    monkeypatch.setattr(lines, "_part", part)
    rng = random.Random(4)
    texts = []
    for f in range(25):
        base = [f"f{f}w{i}" for i in range(rng.randint(5, 40))]
        for _ in range(4):
            own = list(base)
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_similar_lines(docs).collect()}
    assert got == plain_lines(list(enumerate(texts)))
    assert {k for k, _, _ in sizes} == set(range(4))
    large = [(n, of) for _, n, of in sizes if of >= 100]
    assert large
    assert all(n < of / 2 for n, of in large)


def test_stored_tables_of_few_rows_have_few_files(spark):
    """A file for each partition starts two processes on a local disk, as Hadoop sets its rights by chmod."""
    import glob

    def files(df):
        return len(glob.glob(df.saved_at.removeprefix("file://") + "/part-*"))

    rows = spark.range(1000).repartition(16)
    few, unknown = common.saved(rows, "few", rows=1000), common.saved(rows, "unknown")
    assert files(few) == 1
    assert files(unknown) == 16
    assert few.count() == unknown.count() == 1000
    assert files(common.saved(rows, "many", rows=common.FILE_ROWS * 4)) == 16
    common.discard(few, unknown)


def test_workers_keep_one_thing_and_let_it_go(spark):
    import pyarrow as pa

    from quillstream.llm import bpe

    common.let_go()
    one = common.held("a", list)
    assert common.held("a", list) is one
    common.held("b", list)
    assert list(common._HELD) == ["b"]
    common.let_go()
    assert not common._HELD
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert bpe.token_digests(docs, queries.tokenizer_path(), ["doc_id"]).count() == 40
    seen = common.rowwise(docs, "text", ["doc_id"], lambda: lambda texts: {"n": pa.array([len(common._HELD)] * len(texts), pa.int32())}, "n int")
    assert {r["n"] for r in seen.collect()} == {0}


# Licences


def test_licences_of_headers_and_directories(spark):
    rows = [
        (1, "a/x.txt", "Some prose about nothing.\nLicensed under the Apache License, Version 2.0.\nmore prose here"),
        (2, "a/b/LICENSE", "Released under the MIT License."),
        (3, "a/b/c/y.txt", "no statement here at all"),
        (4, "a/b/c/z.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "q/w.txt", "nothing"), (6, None, "nothing"), (7, "a/b/v.txt", None), (8, "a/b/c/COPYING", "Licensed under CC BY-NC 4.0."), (9, "", ""), (5, "q/w.txt", "nothing"),
    ]
    rows += [(100 + i, f"p/{i}.txt", "the work is of the people and the version of it is released in the world under a form") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["source"]) for r in licenses.licensed(df, ["doc_id"]).collect()}
    assert got[1] == ("Apache-2.0", "header", None)
    assert got[2] == ("MIT", "header", None)
    assert got[3] == ("CC-BY-NC-4.0", "directory", "a/b/c/COPYING")
    assert got[4] == ("GPL-3.0", "header", None)
    assert got[7] == ("MIT", "directory", "a/b/LICENSE")
    assert all(got[i] == (None, None, None) for i in (5, 6, 9, 100))
    assert licenses.licensed(df, ["doc_id"]).count() == len(rows)
    assert licenses.licensed(df.limit(0), ["doc_id"]).count() == 0


def test_the_commonest_licence_is_found(spark):
    prose = "He went to the river and it was under water in the morning."
    rows = [(i, f"s/{i}/LICENSE", "Released under the MIT License.") if i % 3 == 0 else (i, f"s/{i - i % 3}/x{i}.txt", f"{prose} {i}\n{prose[:20]}") for i in range(90)]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.licensed(spark.createDataFrame(rows, "doc_id long, path string, text string"), ["doc_id"]).collect()}
    assert got == {i: ("MIT", "header" if i % 3 == 0 else "directory") for i in range(90)}
    few = [(i, None, "Licensed under CC BY-NC 4.0." if i < 2 else f"line {i} of a table") for i in range(10)]
    got = {r["doc_id"]: r["license"] for r in licenses.licensed(spark.createDataFrame(few, "doc_id long, path string, text string"), ["doc_id"]).collect()}
    assert got == {i: "CC-BY-NC-4.0" if i < 2 else None for i in range(10)}


def plain_statements(files):
    """Best licence of each path by every statement's cosine to every template, in plain arithmetic."""
    split = lambda t: [w.strip(".") for w in re.split("[^a-z0-9.+-]+", t.lower()) if w.strip(".")]
    lines = [split(line) for _, text in files if text is not None for line in text.split("\n")]
    vocabulary = {w for _, t in licenses.TEMPLATES + licenses.TEXTS for w in split(t)}
    df = Counter(w for words in lines for w in set(words) & vocabulary)
    weight = lambda w: math.log((len(lines) + 1) / ((df[w] if w in vocabulary else 1) + 1))
    vector = lambda words: {w: n * weight(w) for w, n in Counter(words).items()}

    def best(words, templates):
        own, found = vector(words), []
        for name, t in templates:
            other = vector(split(t))
            norm = math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in other.values()))
            score = sum(own[w] * other.get(w, 0) for w in own) / norm if norm else 0
            if round(score, 6) >= licenses.LEAST:
                found.append((-round(score, 6), name))
        return found

    out = {}
    for path, text in files:
        found = [x for line in (text or "").split("\n") for x in best(split(line), licenses.TEMPLATES)] if text is not None else []
        if path is not None and text is not None and re.match(licenses.NAMES, path.rsplit("/", 1)[-1]):
            found += best(split(text), licenses.TEXTS)
        out[path] = min(found, default=(None, None))
    return out


def test_licences_match_plain_cosines(spark):
    import textwrap

    rng = random.Random(23)
    words = "the of a software license under permission notice free river morning copy copies rights any person version public".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    files = [(f"r/{i}/LICENSE", "Copyright someone\n\n" + "\n".join(textwrap.wrap(t, 70))) for i, (_, t) in enumerate(licenses.TEXTS)]
    files += [(f"h/{i}.txt", prose(12) + "\n" + t + "\n" + prose(30)) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    files += [(f"every/{i}.txt", "Released under the MIT License.\n" + prose(8)) for i in range(30)]
    # Two licences in one line, a line of common words, a very long line, nulls and nothing.
    files += [("t/1.txt", "Released under the ISC License. Released under the MIT License."), ("t/2.txt", "the of a under the of a"), ("t/3.txt", prose(20_000)), ("t/COPYING", prose(5_000)), ("t/4.txt", None), ("t/NOTICE", ""), ("t/5.txt", "  \n\n")]
    df = spark.createDataFrame([(p, t, 1, 2) for p, t in files], "path string, text string, word int, file int")
    got = {r["path"]: (r["license"], r["score"], r["origin"], r["word"], r["file"]) for r in licenses.licensed(df.withColumn("id", F.lit(1)), ["id", "word", "file"]).collect()}
    for path, (minus, name) in plain_statements(files).items():
        own = got[path][:2] if got[path][2] == "header" else (None, None)
        assert own[0] == name, (path, got[path], minus)
        assert own[1] is None or abs(own[1] + minus) < 2e-6
        assert got[path][3:] == (1, 2)
    for i, (name, _) in enumerate(licenses.TEXTS):
        assert got[f"r/{i}/LICENSE"][0] == name


def plain_inheritance(rows):
    """license, score and source of each path without one of its own: the best licence file of the nearest directory above."""
    files = {}
    for path, (licence, score) in rows.items():
        folder, _, name = path.rpartition("/")
        if licence is not None and re.match(licenses.NAMES, name):
            files[folder] = min(files.get(folder, (9, "", "")), (-score, licence, path))
    out = {}
    for path, (licence, _) in rows.items():
        if licence is None:
            at = path.rpartition("/")[0]
            while at not in files and at:
                at = at.rpartition("/")[0]
            minus, licence, source = files.get(at, (None, None, None))
            out[path] = (licence, None if minus is None else -minus, source)
    return out


def test_licences_of_documents_are_inherited_as_in_a_plain_walk(spark):
    got = queries.QUERIES["op6_licenses"](spark, "/root/testdata/sf0.01").collect()
    own = {r["path"]: (r["license"], r["score"]) if r["origin"] == "header" else (None, None) for r in got}
    want = plain_inheritance(own)
    found = {r["path"]: (r["license"], r["score"], r["source"]) for r in got if r["origin"] != "header"}
    assert found == want
    assert sum(x[0] is not None for x in found.values()) > 100
    assert len({s.count("/") for _, _, s in found.values() if s}) == 2  # from the folder, and from above it


def test_licences_are_inherited_as_in_a_plain_walk(spark):
    rng = random.Random(41)
    tell = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "nothing to see here", "This work is licensed under the GNU General Public License, version 3."]
    paths = {"/".join([rng.choice("abc") for _ in range(rng.randint(0, 4))] + [rng.choice(["LICENSE", "COPYING.md", "x.txt", "y.py", "license_notes", "mylicense"])]) for _ in range(300)}
    files = [(p, rng.choice(tell) if rng.random() < 0.4 else "no statement at all") for p in sorted(paths)]
    got = licenses.licensed(spark.createDataFrame(files, "path string, text string"), []).collect()
    own = {r["path"]: (r["license"], r["score"]) if r["origin"] == "header" else (None, None) for r in got}
    assert {r["path"]: (r["license"], r["score"], r["source"]) for r in got if r["origin"] != "header"} == plain_inheritance(own)


# Decontamination


def plain_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for i, item in items:
        own = split(item)
        n = min(10, len(own))
        for window in {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ():
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    found.add(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["w%d" % i for i in range(9)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, make(25)), (2, make(10)), (3, "Zig, zag!"), (4, ""), (5, None), (10, "solo"), (11, make(12)), (12, "a " * 30)]
    texts = ["", None, "solo", "ZIG-zag and solo é", "a " * 200, "x" * 9_000] + [make(rng.randint(1, 30)) for _ in range(20)]
    texts += [make(5) + " " + " ".join(items[k][1].split()[a : a + rng.randint(9, 14)]) + " " + make(4) for k in (0, 1, 6) for a in range(0, 12, 2)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, "", "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, ["doc_id"]).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:] == plain_hits(texts[r["doc_id"]], items), texts[r["doc_id"]]
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench, ["doc_id"]).count() == 0


# URLs


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_match_brute_force(spark):
    rng = random.Random(13)
    found = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/x?y#z", "http://example.com/en", "x://a.net/es/1", "http://net/fr/", "http://anet/es/", "http://.com/", "a\nb://b.com/\n/x", "http://example.com:80/en/", "://net/es/"]
    found += [f"http://{rng.choice(['', 'm.', 'www.', 'a.b.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(found)] + [(1, "", "x")], "page_id long, url string, host string")
    got = urls.judge(df, urls.rules_frame(spark), ["page_id"]).collect()
    assert len(got) == len(found) + 1
    for r in got:
        assert tuple(r)[1:] == plain_verdict(found[r["page_id"]], urls.RULES), found[r["page_id"]]
    many = [(f"h{i}.org", f"/{'p' * (i % 7)}", "block") for i in range(3_000)]
    got = urls.judge(spark.createDataFrame([(i, f"http://x.h{i}.org/ppp") for i in range(0, 4_000, 50)], "page_id long, url string"), urls.rules_frame(spark, many), ["page_id"]).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 3_000 and r["page_id"] % 7 <= 3) for r in got)
    assert {r["verdict"] for r in urls.judge(df, urls.rules_frame(spark).limit(0), ["page_id"]).collect()} == {"allow"}


def plain_canonical(url):
    if url is None or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    host, path, _, _ = plain_verdict(url, [])
    host = re.sub(r"\.+(?=:|$)", "", re.sub("^.*@", "", host))
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(scheme.lower(), "none"))
    decode = lambda t: re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if re.match("[A-Za-z0-9._~-]", chr(int(m[1], 16))) else m[0].upper(), t)
    done = []
    for x in decode(path).split("/"):
        if x == "..":
            done = done[: max(len(done) - 1, 1)]
        elif x != ".":
            done.append(x)
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    asked = sorted(x for x in decode(query[1] if query else "").split("&") if x and not re.match(urls.TRACKING, x))
    return host + "/".join(done).rstrip("/") + ("?" + "&".join(asked) if asked else "")


def test_canonical_urls_match_a_plain_version(spark):
    found = [None, "", "no scheme", "http://", "HTTP://User:pw@A.Example.COM.:80/a/./b/../c/?b=2&a=1&utm_source=x#top", "https://a.example.com:443", "https://a.example.com:80/", "http://a/%7euser/%2f%C3%a9%4", "http://a/../../b/..", "http://a/b/./", "http://a//b//", "http://a/?ref=1&ref", "http://a?x=%41&&y", "ftp://a:80/x%zz%", "http://a/b?u=http://c/d?e", "http://a/" + "x/../" * 300 + "y", "http://é.org/é"]
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = {r["page_id"]: r["c"] for r in df.select("page_id", urls.canonical(F.col("url")).alias("c")).collect()}
    assert [got[i] for i in range(len(found))] == [plain_canonical(u) for u in found]


def test_listed_urls_are_blocked_unless_a_rule_says_more(spark):
    found = ["http://a.org/x", "https://a.org/x/#y", "http://a.org/x?ref=z", "http://b.com/x", "https://b.com/x", "http://b.net/es/1", "http://b.net/es/1", None, None, "http://c.org", "no", "no"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(found)], "page_id long, url string, key string, row string")
    got = [r["verdict"] for r in urls.judge(df, urls.rules_frame(spark), ["page_id", "key", "row"], listed=urls.repeated(df)).orderBy("page_id").collect()]
    assert got == ["allow", "block", "block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    many = spark.createDataFrame([(f"h{i}.org/p", None) for i in range(0, 30_000, 3)], "url string, keeper long")
    some = spark.createDataFrame([(i, f"http://h{i}.org/p/") for i in range(600)], "page_id long, url string")
    got = urls.judge(some, urls.rules_frame(spark).limit(0), ["page_id"], listed=many).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


# The whole


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from test_llm_text import plain_components, plain_fingerprint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    for f in frames[:-1]:
        assert f.columns == docs.columns
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames]
    lost = rows[0].keys() - rows[1].keys()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(toxic.get(i, 1) == 1 for i in lost)
    assert {i: r["text"] for i, r in rows[2].items()} == plain_lines([(i, r["text"]) for i, r in rows[1].items()])
    ids = sorted(rows[2])
    components = plain_components(ids, [plain_fingerprint(rows[2][i]["text"]) for i in ids])
    assert sorted(rows[3]) == sorted(set(components.values()))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows[4].keys() == {i for i, r in rows[3].items() if not plain_hits(r["text"], items)[4]}
    assert rows[5].keys() == rows[4].keys()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows[5])


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_near_duplicate_stage_matches_brute_force(spark, sf_dir):
    import corpus_pipeline
    from pyspark.sql import Row

    rng = random.Random(17)
    words = ["w%d" % i for i in range(300)]
    common = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(2)]
    texts = ["", None, " \n", "solo", "SOLO", "one two three", "one two four"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own) + (" " + rng.choice(common) if rng.random() < 0.5 else ""))
    # A large group of near copies, and a chain of which only neighbours are similar.
    base = [rng.choice(words) for _ in range(120)]
    texts += [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in range(0, 120, 2)]
    long = [f"c{i}" for i in range(200)]
    texts += [" ".join(long[i : i + 100]) for i in range(0, 100, 5)]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_chars=len(t or ""), set="clash") for i, t in enumerate(texts)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(i) for i in range(len(texts))})
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_long_hosts_cost_as_many_keys_as_rules_have_label_counts(spark):
    import time

    hosts = ["a." * n + "example.com" for n in (0, 1, 5_000)] + ["." * 5_000 + "net", "com", "", "."]
    df = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)] * 20, "page_id long, url string")
    began = time.perf_counter()
    got = {r["page_id"]: r["rule"] for r in urls.judge(df, urls.rules_frame(spark, [*urls.RULES, ("a.a.example.com", "/", "block"), ("", "/", "block")]), ["page_id"]).collect()}
    assert time.perf_counter() - began < 30
    assert got == {0: "example.com/en/", 1: "example.com/en/", 2: "a.a.example.com/", 3: None, 4: "com/", 5: None, 6: "/"}


def test_top_k_queries_are_packed_by_themselves_and_tiles_go_by_size(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([3, 8]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2).withColumn("of", F.lit(1)).withColumn("place", F.lit(2))
    for name, value in (("ROWS", 16), ("CELLS", 100), ("TILE_CELLS", 300), ("TILE_QUERIES", 2)):
        monkeypatch.setattr(topk, name, value)
    blocks = topk.pack(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 20 == 0).alias("query"))).collect()
    asked = [r for r in blocks if r["of"] is not None]
    assert sum(len(r["ids"]) // 8 for r in asked) == 20 and len(asked) <= 2 * 2 * 2  # full but for the last of each task and width
    assert sum(len(r["ids"]) // 8 for r in blocks if r["of"] is None) == 400
    assert all(len(r["ids"]) // 8 <= 12 for r in blocks if r["of"] is None)  # about 100 components
    assert sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 6).collect()), key=repr) == plain_top_k(rows, 6)


def test_near_duplicate_stage_goes_by_simhash_first(spark, monkeypatch):
    import corpus_pipeline
    from quillstream.llm import shingles, simhash
    from test_llm_text import plain_fingerprint

    rng = random.Random(23)
    long = ["w%d" % rng.randrange(500) for _ in range(600)]
    few = ["v%d" % rng.randrange(500) for _ in range(60)]
    # Copies a word apart, which fingerprints reach; short ones, which they may not; one fingerprint over other texts.
    texts = [" ".join(long[:i] + ["x"] + long[i + 1 :]) for i in range(0, 600, 100)] + [" ".join(few), " ".join([*few[:-1], "y"])]
    texts += ["one two three one two three one two three", "one two three one two three one two three one two three", "other words here", "", None]
    prints = [plain_fingerprint(t) for t in texts]
    bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if plain_shingles(texts[i]) != plain_shingles(texts[j])]
    assert any(0 < bits(i, j) <= 3 for i, j in pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *a, **k: seen.append(sorted(r["fp"] for r in distinct.collect())) or real(distinct, *a, **k))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert seen == [sorted({p - (p >> 63 << 64) for p in prints})]  # every different fingerprint, once
    assert {r["doc_id"] for r in kept} == {0, 6, 8, 10, 11}
    rows = shingles.prefixes(simhash.marked(docs, "doc_id"), ["id", "mark"], shingles.commonness(docs)).cache()
    of = {r["set"]: r["id"] for r in rows.collect()}
    got = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in shingles.close(rows).collect()}
    assert got and all(bits(i, j) <= 3 for i, j in got)
    assert {(i, j) for i, j in pairs if 0 < bits(i, j) <= 3 and prints.count(prints[i]) == prints.count(prints[j]) == 1} <= got
