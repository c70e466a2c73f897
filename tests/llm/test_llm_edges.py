"""Every query and the pipeline over tables of odd rows, with extra columns whose names clash, and over empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.llm import queries

#: Names that the operators use for columns of their own, and some of results.
NAMES = "id row own keep kept mark line place word words d n at s1 first doc spans score predicted base runs host path rule verdict key canonical fp component set prefix hashes file license groups of items n_words block wide rank query content boxes blocks page text_ n_tokens held_out again copies own_id own_mark tree terms times node part needed".split()
LONG = "Some words of a very long text. " * 40_000
TEXTS = [None, "", " ", "\n\n\n", "one", "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven", LONG, LONG + "end", "x" * 300_000, "\x00\x1c é ß 𝒳", "a b c d e\na b c d e\na b c d f", "password = hunter2222 AKIA" + "Q7" * 8, "0a" * 20]


def write(spark, folder, rows_of):
    documents = rows_of("documents")
    frames = {
        "documents": spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(rows_of("labels"), "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(rows_of("benchmark"), "item_id long, text string"),
        "pages": spark.createDataFrame(rows_of("pages"), "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame(rows_of("embeddings"), "vec_id long, embedding array<float>"),
    }
    for name, df in frames.items():
        extra = [F.lit(i).alias(c) for i, c in enumerate(NAMES) if c not in df.columns]
        df.select("*", *extra).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd_rows(name):
    nan = float("nan")
    documents = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    documents += [(3, "again three", None, None, 11), (3, "again three", None, None, 11), (3, "three otherwise", None, None, 15), (None, "no id", None, None, None), (None, None, None, None, None)]
    pages = [None, "", "<p>a", "<article><p>x</article>", "<article><p>x</article>", "<div>" * 50_000 + "deep", "<a " * 50_000]
    return {
        "documents": documents,
        "labels": [(0, 1, 1), (1, 0, 0), (5, 1, 1), (5, 1, 0), (7, None, None), (None, 1, 1), (99, 1, 0)] + [(i, 0, i % 2) for i in range(2, 13)],
        "benchmark": [(1, TEXTS[5]), (1, TEXTS[5]), (2, "one"), (3, None), (4, ""), (None, "some words of a very long text some words of a")],
        "pages": [(i, u, h) for i, (u, h) in enumerate(zip(["http://a.com/x", None, "", "http://b.net/es/", "http://c.org/#", "http://c.org", "odd"], pages, strict=True))] + [(None, "http://c.org", None), (3, "http://b.net/es/", "<p>a")],
        "embeddings": [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (20, []), (40, [3e38, -3e38]), (5, [1.0, 2.0]), (6, [1.0, 2.0])],
    }[name]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda _: [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows_all_get_a_result(spark, odd, empty, name):
    got = queries.QUERIES[name](spark, odd).collect()
    if name == "op4_topk":
        # Usable rows: two of id 0, one of none, 5, 6 and 40; each query row ranks all but itself.
        assert sorted((r["query_id"], r["rank"]) for r in got) == sorted([(i, k) for i in (0, 0, 40) for k in range(1, 6)])
    elif name == "op12_treaps":
        # Items 1, twice, and the one without an id find the texts that have their words; 2 finds the texts with "one".
        assert {r["item_id"] for r in got} == {1, 2, None}
        assert sorted(r["rank"] for r in got if r["item_id"] == 1) == sorted(2 * list(range(1, 1 + sum(r["item_id"] == 1 for r in got) // 2)))
    else:
        assert len(got) == len(odd_rows("pages" if name in ("op3_html", "op10_urls") else "documents"))
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_results_of_odd_rows(spark, odd):
    rows = {name: queries.QUERIES[name](spark, odd).collect() for name in ("op2_simhash", "op7_decontaminate", "op8_lines", "op3_html", "op1_toxicity", "op11_sigtrees", "op13_runs")}
    nothing = {i for i, t in enumerate(TEXTS) if not (t or "").split()} - {3}  # other texts have this id too
    groups = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows["op2_simhash"]}
    assert all(groups[i] == ("0" * 16, 0) for i in nothing)
    hit = {r["doc_id"]: (r["n_items"], r["contaminated"]) for r in rows["op7_decontaminate"]}
    assert hit[5] == hit[6] == (2, True) and hit[4] == (1, True) and hit[7] == hit[8] == (0, True) and hit[9] == (0, False)
    gone = {r["doc_id"]: r["n_removed"] for r in rows["op8_lines"] if r["doc_id"] not in (None, 3)}
    assert gone == {i: {6: 1, 8: 1, 11: 1}.get(i, 0) for i in range(len(TEXTS)) if i != 3}
    assert {r["page_id"]: r["text"] for r in rows["op3_html"]}[5] == "deep"
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows["op11_sigtrees"]}
    assert all(linked[i] == (0, i) for i in nothing - {0}) and linked[6] == (7, 5) and linked[8][1] == 7
    repeated = {r["doc_id"]: (r["n_runs"], r["start"], r["period"]) for r in rows["op13_runs"]}
    assert repeated[1] == (0, None, None) and repeated[7] == (1, 0, 7)
    assert all(0 <= r["score"] <= 1 for r in rows["op1_toxicity"])


def test_pipeline_of_odd_rows(spark, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, odd).count() == docs.count()
    assert corpus_pipeline.run(spark, empty).count() == 0
