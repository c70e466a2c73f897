"""Toxicity, SimHash, tokenizing, secrets and HTML against plain versions on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm import bpe, html, queries, secrets, simhash, toxicity
from quillstream.llm.common import table

ODD = ["", " ", "\t\n", None, "one", "one two", "a b c", "A B C", "é ß x\x1c y", "x" * 5_000, "w " * 4_000, "a b c"]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


# SimHash


def plain_fingerprint(text, width=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    near = [t + " tail" for t in base[:20]] + [t.upper() for t in base[:5]]
    texts = ODD + base + near
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components(list(range(len(texts))), prints)
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize(("radius", "parts"), [(3, 2), (7, 4), (2, 4)])
def test_links_are_all_and_once(spark, radius, parts):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for c in centres for _ in range(5)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in flips})
    got = sorted(map(tuple, simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, parts).collect()))
    u = np.array(prints, np.int64).view(np.uint64)
    want = [(a, b) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and int(u[i] ^ u[j]).bit_count() <= radius]
    assert got == sorted(want)


def test_keep_one_keeps_rows_and_columns(spark):
    docs = documents(spark, ["a b c d", "a b c d", "x y z", None, "", "x y z"])
    docs = docs.unionByName(docs.where("doc_id = 2"))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    mixed = spark.createDataFrame([(None, "q r s"), (5, "q r s"), (None, "t u v")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in simhash.keep_one(mixed).collect()))) == ["5", "None"]


def test_keep_one_keeps_a_row_of_every_group(spark):
    rows = [(None, "q r s t"), (None, "t u v w"), (None, "t u v w"), (7, "a b c d"), (7, "k l m n"), (7, "k l m n"), (9, "k l m n")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect())
    assert got == [("7", "a b c d"), ("7", "k l m n"), ("None", "q r s t"), ("None", "t u v w")]


def test_components_of_chains(spark):
    from quillstream.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (5, 5)] + [(200, i) for i in range(201, 230)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {got[i] for i in (100, 101, 102)} == {100}
    assert {got[i] for i in range(200, 230)} == {200}


# Tokenizing


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_library(spark, sf_dir):
    rng = random.Random(1)
    alphabet = "aAbB zé ñ́ éΣσςİI'sdtre<|startoftext|>0½²Ⅷ​\x1c\x85　\n\t 中文𝒳🎉߀_-&#|>"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["x<|endoftext|>Y <|startoftext|>", "AΣ", "'S It's", "ab" * 3_000, "é" * 40]
    texts += [r["text"] for r in table(spark, sf_dir, "documents").limit(60).collect()]
    lib, docs = library(), documents(spark, texts)
    got = {r["doc_id"]: r for r in bpe.token_digests(docs, queries.tokenizer_path(), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode(docs, queries.tokenizer_path(), ["doc_id", "fp"])
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, queries.tokenizer_path(), ["doc_id"]).collect()}
    assert back[4] == lib.decode(lib.encode("one", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.token_digests(docs.limit(0), queries.tokenizer_path(), ["doc_id"]).count() == 0


def test_both_segment_trees_agree():
    b = bpe.Bpe(open(queries.tokenizer_path(), "rb").read())
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 33))) for _ in range(500)})
    assert b.encode_words(words) == [b.encode_word(w) for w in words]


# Toxicity


def test_toxicity_finds_words_of_labelled_documents(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(5)]
        bad = i % 6 == 0
        if bad:
            sentences[rng.randrange(5)] += f" zork{rng.choice(words)} and quuxly"
        texts.append(". ".join(sentences))
        labels.append((i, 1, int(bad)))
    texts += ["", None, "zorkabc quuxly"]
    docs, known = documents(spark, texts), spark.createDataFrame(labels + [(1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model, ["doc_id"]).collect()}
    held = {r[0] for r in docs.where(~toxicity.learnable(F.col("doc_id"))).select("doc_id").collect()}
    assert len(held) > 40
    assert all(got[i]["predicted"] == toxic for i, _, toxic in labels if i in held)
    assert got[400]["score"] == got[401]["score"] == model.empty
    assert got[402]["predicted"] == 1
    spans = {r["doc_id"]: r["spans"] for r in toxicity.offending(docs, model, ["doc_id"]).collect()}
    assert all(("zork" in texts[0][s["start"] : s["end"]]) for s in spans[0])
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 402").count() == 0
    assert toxicity.train(docs, known.limit(0)).weights == {}
    assert toxicity.scores(docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_holds_out_a_fifth(spark, sf_dir):
    import zlib

    got = toxicity.score_documents(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


# Secrets


def plain_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_match_brute_force(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = [*ODD, "PassWord = 'hunter22'", "api_key:abc token=abcdef", "x AKIA" + "Q7" * 8 + " y", "AKIAshort", "𝒳 " + "0a1f" * 8, "ſecret=abcdefg token:  \"" + "z" * 9, f"see {key} here", "a-name-of-some-long-thing_with_parts_2", "password=" + "deadbeef" * 4]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in secrets.secrets(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = plain_secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [want.count(k) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    at = texts.index(f"see {key} here")
    assert got[at]["spans"] == f"random:4:{4 + len(key)}"
    assert "random" not in got[at + 1]["spans"]
    assert secrets.secrets(docs.limit(0), ["doc_id"]).count() == 0


KEYS = {
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "hex": "0123456789abcdef",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
PROSE = "getElementsByTagNameAndClass internationalization_of_names some-long-page-title-with-words com_example_project_module_ClassName2 AbstractSingletonProxyFactoryBean the_quick_brown_fox_jumps_over_the_lazy_dog THIS_IS_A_CONSTANT_NAME_OF_SOMETHING annual-report-2024-final-version-2 donaudampfschifffahrtsgesellschaft anticonstitutionnellement-et-autres".split()


def test_keys_of_all_kinds_are_found_among_names(spark):
    rng = random.Random(6)
    keys = [(kind, "".join(rng.choice(letters) for _ in range(n))) for kind, letters in KEYS.items() for n in ((23, 40) if kind == "hex" else (32, 40)) for _ in range(100)]
    names = [rng.choice(PROSE) + rng.choice(["", "_x", "-and", "Of"]) + rng.choice(PROSE) for _ in range(400)]
    texts = [f"see {k} here" for _, k in keys] + [f"see {n} here" for n in names]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(documents(spark, texts), ["doc_id"]).collect()}
    for kind in KEYS:
        own = [i for i, (k, _) in enumerate(keys) if k == kind]
        assert sum(("random" in got[i] or "hex" in got[i]) for i in own) >= 0.9 * len(own), kind
    found = [i for i in got if "random" in got[i]]
    assert sum(i >= len(keys) for i in found) <= 0.1 * len(found)


@pytest.mark.parametrize(("n_keys", "n_names", "recall"), [(4, 20_000, 0.4), (25, 10_000, 0.6), (150, 2_000, 0.85)])
def test_few_keys_are_found_among_many_names(n_keys, n_names, recall):
    """At several shares of keys; p-values go on falling below what was drawn."""
    rng = random.Random(n_keys)
    kinds = {k: (KEYS[k], n) for k, n in (("hex", 32), ("base32", 40), ("letters", 40), ("base64", 32))}
    runs = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in kinds.values() for _ in range(n_keys)]
    n_keys = len(runs)
    runs += [rng.choice(PROSE) + rng.choice(["", "_x", "-and", "Of"]) + rng.choice(PROSE) for _ in range(n_names)]
    tested = [c for r in runs for c in [secrets.candidates(r)] for c in c or [None]]
    histogram: dict = {}
    for c in filter(None, tested):
        histogram[c[2], c[3]] = histogram.get((c[2], c[3]), 0) + 1
    cut = secrets.discoveries(histogram)
    found = [i for i, r in enumerate(runs) if any(c[2] in cut and c[3] >= cut[c[2]] for c in secrets.candidates(r))]
    assert sum(i < n_keys for i in found) >= recall * n_keys
    assert sum(i >= n_keys for i in found) <= 0.1 * len(found)


def test_tail_probabilities_follow_the_law_of_the_tail():
    rng = np.random.default_rng(3)
    drawn = np.sort(rng.chisquare(6, 20_000))  # near zero the probability goes as the third power
    exact = lambda s: (s / 2) ** 3 / 6
    for s in (0.2, 0.1, 0.05, 0.01):
        assert 0.2 < secrets.tail_probability(s, drawn) / exact(s) < 5
    assert secrets.tail_probability(0.01, drawn) < 1e-7
    falling = [secrets.tail_probability(s, drawn) for s in np.linspace(0, 8, 200)]
    assert falling == sorted(falling)


def test_battery_tells_draws_from_other_sequences():
    rng = np.random.default_rng(8)
    for size in (16, 32, 64):
        for n in (20, 40, 100):
            drawn = secrets.battery(rng.integers(0, size, (2_000, n)), size)
            assert np.quantile(drawn, 0.99) < 25  # three squared standard scores, nearly
            skewed = secrets.battery(rng.integers(0, size // 4, (200, n)), size)
            order = secrets.battery(np.sort(rng.integers(0, size, (200, n)), axis=1), size)
            assert np.median(skewed) > np.quantile(drawn, 0.95) and np.median(order) > np.quantile(drawn, 0.95)
    assert np.isfinite(secrets.battery(np.zeros((1, 30), int), 16)).all()


def test_discoveries_are_those_of_benjamini_and_hochberg():
    rng = random.Random(12)
    for _ in range(50):
        bins = [(rng.choice([5, 6]), rng.choice([0, 0, 0, rng.randrange(60)])) for _ in range(rng.randint(1, 60))]
        got = secrets.discoveries({k: bins.count(k) for k in set(bins)}, 0.05)
        for length in {k for k, _ in bins}:
            p = sorted(10 ** (-b / 10) for k, b in bins if k == length)
            most = max((i + 1 for i, x in enumerate(p) if x * len(p) <= 0.05 * (i + 1)), default=0)
            found = [b for k, b in bins if k == length and length in got and b >= got[length]]
            assert len(found) == most
    assert secrets.discoveries({}) == {}


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 line<br>more<p>Second &lt;p&gt; &nbsp; end</p><div class="comments"><p>Nice!</p></div><ul><li>one<li>two</ul></article>
<aside>Side</aside><form>Send</form><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    pages = [PAGE, "", None, "<p>plain", "<div><p>open", "<b>" * 3_000 + "deep", "a < b & c > d", "<article></article>", PAGE]
    df = spark.createDataFrame([(i, f"http://h.com/{i}", p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.main_text(df, ["page_id", "url"]).collect()}
    assert got[0]["text"] == "A & B\nFirst bold line more\nSecond <p> end\none\ntwo"
    assert got[8]["text"] == got[0]["text"]
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["", "", "plain", "open", "deep", "a < b & c > d", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_templates_go_by_host(spark):
    def page(i, box):
        return f"<body><div><p>Box of links</p>{box}</div><div><p>Own text {i}</p></div></body>"

    rows = [(i, "http://a.com/x", page(i, "")) for i in range(12)] + [(99, "http://b.com/x", page(99, ""))]
    rows += [(100 + i, "http://c.com/x", f"<article><p>Often said.</p><p>Own {i}</p><section><p>Read also</p></section></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[3] == "Own text 3"
    assert got[99] == "Box of links\nOwn text 99"
    assert got[103] == "Often said.\nOwn 3"


def test_html_templates_of_a_few_pages_of_a_large_host(spark):
    box = "<div><ul><li>Site links<li>More</ul></div>"
    rows = [(i, "http://hot.com/x", f"<body>{box if i % 20 == 0 else ''}<div class='byline'>By {i}</div><div><p>Often said.</p><p>Own {i}</p></div></body>") for i in range(200)]
    # Copies of one page are no template; four different pages are too few, five are enough.
    rows += [(300 + i, "http://copies.com/x", "<body><div><section><p>All</p></section><section><p>of it</p></section></div></body>") for i in range(9)]
    rows += [(400 + i, "http://four.com/x", f"<body><section><p>Box</p></section><p>{i}</p></body>") for i in range(4)]
    rows += [(500 + i, "http://five.com/x", f"<body><section><p>Box</p></section><p>{i}</p></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df, ["page_id"]).collect()}
    assert all(got[i] == f"By {i}\nOften said.\nOwn {i}" for i in range(200))
    assert all(got[300 + i] == "All\nof it" for i in range(9))
    assert all(got[400 + i] == f"Box\n{i}" for i in range(4))
    assert all(got[500 + i] == str(i) for i in range(5))


def test_html_keeps_what_the_article_says(spark):
    page = "<article><p class='byline'>By A</p><p class='teaser'>In short</p><div class='related-work'>Others</div><div class='share'>S</div><div id='comments'>No</div><div role='alert'>No</div></article>"
    df = spark.createDataFrame([(1, "u", page, 7, 8, 9)], "page_id long, url string, html string, host int, row int, page int")
    got = html.main_text(df, ["page_id", "host", "row", "page"]).collect()[0]
    assert got["text"] == "By A\nIn short\nOthers\nS"
    assert (got["host"], got["row"], got["page"]) == (7, 8, 9)


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="row with-sidebar"', 'div class="site has-header-image"', 'div class="post no-comments"', 'div class="no-sidebar content-area"', 'div id="header-and-footer-menu"', 'div class="sidebar"', 'section class="navWrapper"', 'form id="aspnetForm"', 'div class="ad-container" role="banner"'])
def test_html_a_wrapper_of_the_article_may_have_any_name(wrapper):
    tag = wrapper.split()[0]
    inside = "<h1>Title</h1><p>The article's own text, of some length.</p>"
    for page in (f"<body><{wrapper}><article>{inside}</article></{tag}></body>", f"<body><nav>x</nav><{wrapper}><div><main>{inside}</main></div><div class='comments'>no</div></{tag}></body>", f"<body><div class='menu'>Menu</div><{wrapper}>{inside}</{tag}></body>"):
        assert [t for t, _ in html.blocks(page)[0]] == ["Title", "The article's own text, of some length."], page


def test_html_names_say_what_an_element_is():
    kept = ["div id='notice-period'", "div id='login-flow'", "div class='ad-free-reading'", "div class='has-comments'", "div class='shadow advance header2text'", "h2 id='comments'", "h2 class='section-header'", "p id='footer'", "span id='menu'", "div class='nonsense sidebar-story'"]
    gone = ["div class='reader-replies'", "div class='responses'", "div class='site-header'", "div class='x mainNav'", "div class='ad-slot'", "div class='ads'", "div id='comments-section'", "ul class='comment-list'", "div class='cookie-bar'", "div class='sidebar-widgets'", "div class='newsletter-signup-box'", "section class='post_comments'", "p class='advert'", "div hidden", "div style='Display: none'", "div aria-hidden='TRUE'"]
    page = lambda e: f"<body><article><p>Text of the article that goes on</p><{e}>part</{e.split()[0]}></article></body>"
    assert [e for e in kept if len(html.blocks(page(e))[0]) != 2] == []
    assert [e for e in gone if len(html.blocks(page(e))[0]) != 1] == []


def test_html_comments_go_where_they_outweigh_the_article():
    comments = "<div id='comments'>" + "".join(f"<article><p>Comment {i}, which has more to say than the article itself has.</p></article>" for i in range(9)) + "</div>"
    page = f"<body><article><h1>T</h1><p>Short.</p></article>{comments}<aside><article>Teaser</article></aside></body>"
    assert [t for t, _ in html.blocks(page)[0]] == ["T", "Short."]
    page = f"<body><div><h1>T</h1><p>Short.</p></div>{comments.replace('article', 'div')}</body>"
    assert [t for t, _ in html.blocks(page)[0]] == ["T", "Short."]


def test_html_menus_that_differ_are_one_template(spark):
    """Pages without an article, whose boxes say nothing: menus of other links on each page, a page's own list of links to read."""

    def page(i, host):
        menu = "".join(f"<li><a href='/{i}-{k}'>Link {host} {i} {k}</a></li>" for k in range(3 + i % 3))
        more = "<table><tr><td>Our <a href='/x'>own</a> list of <a href='/y'>works</a>, told at length</td></tr></table>" if i == 2 else ""
        return f"<body><div><ul>{menu}</ul></div><div><h1>Title {i}</h1><p>Text {i} with a <a href='/z'>link</a> and <a href='/w'>one more</a> in it.</p>{more}</div></body>"

    rows = [(i, "http://a.com/x", page(i, "a")) for i in range(8)] + [(100 + i, "http://b.com/x", page(i, "b")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[1] == "Title 1\nText 1 with a link and one more in it."
    assert got[2] == "Title 2\nText 2 with a link and one more in it.\nOur own list of works, told at length"
    assert got[100].startswith("Link b 0 0\nLink b 0 1")  # four pages are too few


@pytest.mark.parametrize("part", ["<a ", "</x>", "<div>a", "<div>", "<li>", "<!--", "<!", '<a "', "<a ='>", "<script", "<p><object><div>", "<td>x", "<b></i>", "&amp", "<p>x</p>", "<div class=a b c d>", "</script", "<script></scrip>", "x <"])
def test_html_is_read_in_proportion_to_its_length(part):
    import time

    times = []
    for n in (100_000, 400_000):
        page = "<p>begin</p>" + part * (n // len(part))
        began = time.perf_counter()
        found, _ = html.blocks(page)
        times.append(time.perf_counter() - began)
        assert found[0][0].startswith("begin")
    assert times[1] < max(12 * times[0], 1.0)


def plain_text_blocks(page):
    """An independent reading by the standard library's parser: every block's text, for pages without anything to leave out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now = [], []

        def flush(self, *_):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.now.append(" ") if tag == "br" else self.flush() if tag in html.BLOCK else None

        def handle_endtag(self, tag):
            self.flush() if tag in html.BLOCK else None

        def handle_data(self, data):
            self.now.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    r.flush()
    return r.out


def test_html_blocks_match_another_parser():
    rng = random.Random(31)

    def inner(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["a b", "x &amp; y", " \n", "c&nbsp;d", "<br>", "é &lt;p&gt;"])
        tag = rng.choice(["div", "p", "b", "section", "ul", "span", "i", "table", "blockquote"])
        if tag == "p":
            return f"<p>{rng.choice(['t', 'u <b>v</b> w'])}</p>"
        return f"<{tag} class='k'>{''.join(inner(depth - 1) for _ in range(rng.randint(0, 4)))}</{tag}>"

    for _ in range(300):
        page = "<body>" + "".join(inner(4) for _ in range(4)) + "</body>"
        assert [t for t, _ in html.blocks(page)[0]] == plain_text_blocks(page), page


def test_html_of_the_tables_is_the_article(spark, sf_dir):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in html.page_texts(spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(filter(None, parts))


def test_rowwise_schema_is_kept(spark):
    docs = documents(spark, ["a"])
    assert simhash.with_fingerprints(docs.drop("fp"), ["doc_id", "lang"]).schema["doc_id"].dataType == T.LongType()


# Toxicity: the fit and the scores by themselves


def plain_loss(weights, labels, bags):
    """Minus the log-likelihood of labels under the noisy-or of all sentences, and the pull of the weights, per document."""
    import math

    bias = math.log(toxicity.PRIOR / (1 - toxicity.PRIOR))
    total = toxicity.L2 * sum(w * w for w in weights) / 2
    for y, bag in zip(labels, bags, strict=True):
        harmless = 1 - toxicity.PRIOR
        for sentence in bag:
            harmless *= 1 - 1 / (1 + math.exp(-(bias + sum(weights[f] for f in sentence))))
        total -= math.log(1 - harmless) if y else math.log(harmless)
    return total / len(labels)


@pytest.mark.parametrize("seed", range(4))
def test_toxicity_fit_is_where_the_plain_loss_is_least(seed):
    rng = random.Random(seed)
    n = 5
    bags, labels = [], []
    for _ in range(80):
        bag = [sorted(rng.sample(range(n), rng.randint(1, 3))) for _ in range(rng.randint(0, 4))]
        bags.append(bag)
        labels.append(float(rng.random() < (0.9 if any(0 in s or {1, 2} <= set(s) for s in bag) else 0.1)))
    model = toxicity.fit(np.array(labels), bags, [str(f) for f in range(n)], rounds=4_000)
    fitted = [model.weights.get(str(f), 0.0) for f in range(n)]
    least = plain_loss(fitted, labels, bags)
    for f in range(n):
        for step in (-0.2, -0.05, 0.05, 0.2):
            moved = [w + (step if k == f else 0) for k, w in enumerate(fitted)]
            assert plain_loss(moved, labels, bags) >= least - 1e-5
    for _ in range(30):
        assert plain_loss([w + rng.gauss(0, 1) for w in fitted], labels, bags) > least
    assert fitted[0] == max(fitted)  # the feature that makes a sentence offend


def test_toxicity_score_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model(-4.0, {"bad": 3.0, "worse": 6.0, "^wor": 1.0}, 0.001)
    text = "A bad day. It is worse! Nothing here.\nbad worse bad? ok"
    sentences = [["bad"], ["worse", "^wor"], ["bad", "worse", "^wor"]]
    harmless = 1 - 0.001
    for s in sentences:
        harmless *= 1 - 1 / (1 + np.exp(4.0 - sum({"bad": 3.0, "worse": 6.0, "^wor": 1.0}[f] for f in s)))
    assert abs(model.score(text) - (1 - harmless)) < 1e-12
    assert [text[a:b].strip() for a, b, _ in model.sentences(text)] == ["A bad day", "It is worse", "bad worse bad"]
    assert model.score("") == model.score(None) == model.score("nothing known") == pytest.approx(0.001)


def test_toxicity_of_documents_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect() if r["toxic"] is not None}
    got = [(r["score"], labels[r["doc_id"]]) for r in queries.QUERIES["op1_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, y in got if y], [s for s, y in got if not y]
    assert len(toxic) > 20 and len(clean) > 200
    ranked = sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert ranked > 0.95
    assert sum(t >= 0.5 for t in toxic) >= 0.85 * len(toxic) and sum(c >= 0.5 for c in clean) <= 0.02 * len(clean)
