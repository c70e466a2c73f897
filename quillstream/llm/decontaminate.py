"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the smallest hash of its ``gram``-word sequences is the fingerprint: a shared
span of ``window`` words has the same one in both texts, so every such span is found. Documents' fingerprints meet the
benchmark's first in a blocked Bloom filter, inside the scan, then in an exact join that extends a hit to the words of
its window and compares them. Overlapping hit windows extend to the whole shared span. Items shorter than a window
are one window of their own length, whose fingerprint is the hash of all its words.

Edge cases: null has no words and hits nothing, nor does an item without words; repeated rows of documents give one
output row each, benchmark rows of one id are one item, and one without an id hits but is not listed; the same window in several items is looked up once and counts
for all of them; texts of any length are read whole; tables without rows hit nothing and give none; columns of any name
can be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import ascii_lower, saved, table

WINDOW, GRAM = 10, 3
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many benchmark windows of so many bytes are broadcast; more are joined by a shuffle that Spark may split.
MAX_BROADCAST, MAX_BYTES = 50_000, 16_000_000


def _with_words(df: DataFrame, text: str, to: str) -> DataFrame:
    """Words of a text, lower-cased in A-Z; none for null."""
    df = df.withColumn(to, F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), NO_WORD, -1))
    w = F.col(to)
    head = F.when(F.get(w, 0) == "", 1).otherwise(0)
    tail = F.when((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == ""), 1).otherwise(0)
    return df.withColumn(to, F.slice(w, head + 1, F.size(w) - head - tail))


def _slide(df: DataFrame, column: str, far: int, combine) -> DataFrame:
    """Every value of the array combined with the one ``far`` places on; the last ones have none and go."""
    v = F.col(column)
    return df.withColumn(column, F.transform(F.slice(v, 1, F.greatest(F.size(v) - far, F.lit(0))), lambda h, i: combine(h, F.get(v, i + far))))


def _with_fingerprints(df: DataFrame, words: str, length: int) -> DataFrame:
    """Column ``__f``: the fingerprint of every window of ``length`` words, in order.

    Wide sequences are made of narrower ones, so a place costs a step for each doubling and not for each word.
    """
    df = df.withColumn("__f", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    gram = min(GRAM, length) if length >= WINDOW else length
    for combine, width in ((F.xxhash64, gram), (F.least, length - gram + 1)):
        done = 1
        while done < width:  # overlapping halves do for the smallest hash; a sequence's hash takes its words in order
            far = min(done, width - done)
            df = _slide(df, "__f", far, combine)
            done += far
    return df


def windows(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the benchmark: length, f (fingerprint), span (its words), items (sorted), g (which says what items)."""
    base = _with_words(items.select(F.col(id_col).alias("item"), F.col(text).alias("__text")), "__text", "__w").where("size(__w) > 0")
    base = saved(base.select("item", "__w"), "decontaminate-items")
    parts = []
    for length in [WINDOW, *range(1, WINDOW)]:
        own = base.where(F.size("__w") >= length if length == WINDOW else F.size("__w") == length)
        # Outer, since Spark would push a test of the array's size below every step that makes it, copying them all.
        own = _with_fingerprints(own, "__w", length).select("item", "__w", F.posexplode_outer("__f").alias("at", "f")).where("f is not null")
        parts.append(own.select(F.lit(length).alias("length"), "f", F.array_join(F.slice("__w", F.col("at") + 1, length), " ").alias("span"), "item"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("length", "f", "span").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return found.withColumn("g", F.xxhash64("items", F.size("items")))


def hits(docs: DataFrame, listed: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_words, spans (array of start and end words, merged), groups (sorted, of what windows stand for) for each row.

    ``listed`` are the stored ``windows``.
    """
    listed = listed.drop("items")
    sizes = listed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("span")).alias("bytes")).collect()  # a row for each length
    lengths = {r["length"]: r["n"] for r in sizes}
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep")  # whatever the names, they clash with none here
    rows = _with_words(docs.select(kept, F.col(f"`{text}`").alias("__text"), F.monotonically_increasing_id().alias("__row")), "__text", "__w").drop("__text")
    found: list[str] = []
    for length in sorted(lengths):
        bloom = BlockedBloom(listed.where(F.col("length") == length), "f", lengths[length], inside=True)
        rows = _with_fingerprints(rows, "__w", length)
        places = F.transform(F.col("__f"), lambda f, i: F.when(bloom.may_hold(f), F.struct(i.alias("at"), f.alias("f"))))  # noqa: B023
        rows = rows.withColumn("__p", F.filter(places, lambda p: p.isNotNull()))
        spans = F.transform(F.col("__p"), lambda p: F.struct(F.lit(length).alias("length"), p["f"].alias("f"), p["at"].alias("at"), F.array_join(F.slice("__w", p["at"] + 1, length), " ").alias("span")))  # noqa: B023
        rows = rows.withColumn(f"__hits{length}", spans).drop("__f", "__p")
        found.append(f"__hits{length}")
    n_words = F.size("__w").cast("long").alias("n_words")
    if not found:
        return rows.select("__keep.*", n_words, F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast("array<bigint>").alias("groups"))
    possible = rows.select("__keep", "__row", n_words, F.explode_outer(F.concat(*found)).alias("__hit"))
    possible = possible.select("*", F.col("__hit.length").alias("length"), F.col("__hit.f").alias("f"), F.col("__hit.span").alias("span"), F.col("__hit.at").alias("at")).drop("__hit")
    small = sum(lengths.values()) <= MAX_BROADCAST and sum(r["bytes"] for r in sizes) <= MAX_BYTES
    right = F.broadcast(listed) if small else listed
    joined = possible.join(right, ["length", "f", "span"], "left")
    place = F.when(F.col("g").isNotNull(), F.struct(F.col("at").alias("s"), (F.col("at") + F.col("length")).alias("e")))
    rest = [F.first(c).alias(c) for c in ("__keep", "n_words")]  # the same in all rows of a document
    merged = joined.groupBy("__row").agg(*rest, F.array_sort(F.collect_set(place)).alias("__s"), F.array_sort(F.collect_set("g")).alias("groups"))
    start = F.array().cast("array<struct<s:int,e:int>>")

    def extend(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= last["e"]), wider).otherwise(F.concat(done, F.array(x)))

    return merged.select("__keep.*", "n_words", F.aggregate("__s", start, extend).alias("spans"), "groups")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Which items a document's groups of windows stand for is worked out once for all documents with the same groups.
    """
    listed = saved(windows(benchmark), "decontaminate-windows")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    found = saved(hits(docs.select(kept, "text"), listed, ["kept"]), "decontaminate-hits")
    different = found.where(F.size("groups") > 0).select(F.col("groups").alias("of")).distinct()
    items = listed.groupBy("g").agg(F.first("items").alias("items"))
    of = different.select("of", F.explode("of").alias("g")).join(items, "g").select("of", F.explode_outer("items").alias("item")).distinct()
    of = saved(of.groupBy("of").agg(F.array_sort(F.collect_list("item")).alias("items")), "decontaminate-items-of")
    # Clean documents all have the same groups, none, and don't meet under them.
    clean = found.where(F.size("groups") == 0).withColumn("items", F.array().cast("array<string>"))
    joined = found.join(of, found["groups"] == of["of"]).drop("of").unionByName(clean)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["e"] - x["s"]))
    return joined.select("kept.*", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; columns are unchanged.

    Only ids and a hash of the text go through the search; texts are read again, without the few that were hit.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), mark.alias("mark"), "text")
    listed = saved(windows(benchmark), "decontaminate-windows")
    hit = saved(hits(slim, listed, ["id", "mark"]).where("size(spans) > 0").select("id", "mark").distinct(), "decontaminate-hit")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), mark.alias("own_mark"))
    return rows.join(hit, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")), "left_anti").select("row.*")


def contaminated_documents(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
