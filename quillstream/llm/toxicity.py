"""Toxicity by multiple-instance learning: a document is a bag of sentences, and its label is known, theirs are not.

A sentence's score is a logistic function of the features of its words; a document's is the noisy-or of its sentences', the
probability that not all of them are harmless. The weights are learned from document labels through the noisy-or, so
the model finds out by itself which sentences offend, and can point at them.

Features are whole words and how they begin and end, so that inflected insults are known too. Those that fall most
unevenly on labels are chosen, at most ``MAX_FEATURES``, and the model is fitted on at most ``MAX_LABELLED`` labelled documents, those with the smallest hashes of id. All documents
are scored, over their whole texts, and get the spans of the sentences that offend by themselves.

Edge cases: null and empty texts have no sentence and score the bias of an empty bag; labels and ids of null are left
out; of an id labelled twice the toxic label counts; repeated rows are scored alike, and learned from once; features
of equal gain are taken in the order of their length and letters; a text of any length is scored whole, sentence by
sentence; without labels of both kinds all score the prior; tables without rows give none; columns of any name can be
kept.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, rowwise, saved, small_batches, table

#: Bounds of the fit: labelled documents, features of the model; words that a scorer remembers.
MAX_LABELLED, MAX_FEATURES, SEEN = 6_000, 4_096, 100_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n…。！？]+")
#: A sentence's score is no larger, so that the noisy-or of it stays a number.
MOST = 1 - 1e-12
#: A prior share of offending sentences and the pull of a weight towards zero.
PRIOR, L2 = 1e-4, 0.02
#: How much, in nats, a feature must stand out beyond what chance brings among so many.
MARGIN = 7.0


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its endings of 3 to 5, each marked as what it is."""
    return [word, *["^" + word[:k] for k in range(3, min(7, len(word)))], *[word[-k:] + "$" for k in range(3, min(6, len(word)))]]


class Model:
    """Log-odds of a sentence without known features, and what each known feature adds."""

    def __init__(self, bias: float, weights: dict[str, float], empty: float) -> None:
        self.bias, self.weights = bias, weights
        #: The score of a document without sentences.
        self.empty = empty
        self._seen: dict[str, tuple[str, ...]] = {}

    def known(self, words: list[str]) -> set[str]:
        """The model's features of some words. What a word has is remembered, for a bounded number of words."""
        seen, out = self._seen, set()
        for w in set(words):
            if (x := seen.get(w)) is None:
                if len(seen) >= SEEN:
                    seen.clear()
                x = tuple(f for f in features(w) if f in self.weights)
                if len(w) <= 32:
                    seen[w] = x
            if x:
                out.update(x)
        return out

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and score of every sentence with a known feature."""
        out, at = [], 0
        text = text or ""
        if not self.known(WORD.findall(text.lower())):
            return out
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if found := self.known(WORD.findall(text[at:end].lower())):
                out.append((at, end, _sigmoid(self.log_odds(found))))
            at = m.end() if m else end
        return out

    def log_odds(self, found: set[str]) -> float:
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None, sentences: list[tuple[int, int, float]] | None = None) -> float:
        """The noisy-or over all sentences; those without known features, and no sentence, together count as one."""
        found = self.sentences(text) if sentences is None else sentences
        harmless = -float(np.log1p(-self.empty)) - sum(float(np.log1p(-min(s, MOST))) for _, _, s in found)
        return -float(np.expm1(-harmless))


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def learnable(doc_id: Column) -> Column:
    """Whether labels of this row may be learned from: a fifth of all ids is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def choose(labels: np.ndarray, words: list[str]) -> list[str]:
    """Features that stand out among toxic documents, ``words`` being the distinct words of each in one string.

    A feature's gain is its count there times the log of how much larger its share is there than among others. The
    one with the largest gain is taken; the words that have it then count no more for others, and so on, so that of
    many features of the same words one is left. A gain must exceed the log of the number of features by a margin,
    else chance alone would bring some forward.
    """
    toxic = [own.split() for y, own in zip(labels, words, strict=True) if y]
    count: dict[str, int] = {}
    for own in toxic:
        for f in {f for w in own for f in features(w)}:
            count[f] = count.get(f, 0) + 1
    neg = dict.fromkeys((f for f, c in count.items() if c >= 3), 0)
    for y, own in zip(labels, words, strict=True):
        if not y:
            for f in {f for w in own.split() for f in features(w)} & neg.keys():
                neg[f] += 1
    n1, n0 = len(toxic), len(labels) - len(toxic)

    def gain(f: str, c: int) -> float:
        return c * float(np.log((c + 0.5) / (n1 + 1)) - np.log((neg[f] + 0.5) / (n0 + 1)))

    least = np.log(max(1, len(neg))) + MARGIN
    open_ = {f for f in neg if gain(f, count[f]) >= least}
    where: dict[str, dict[int, set[str]]] = {f: {} for f in open_}  # the words with a feature in each toxic document
    for d, own in enumerate(toxic):
        for w in own:
            for f in features(w):
                if f in open_:
                    where[f].setdefault(d, set()).add(w)
    heap = [(-gain(f, len(x)), -len(f), f) for f, x in where.items()]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap and len(chosen) < MAX_FEATURES:
        value, length, f = heapq.heappop(heap)
        now = gain(f, len(where[f])) if where[f] else 0.0
        if now < least:
            continue
        if now < -value:  # it has lost words since
            heapq.heappush(heap, (-now, length, f))
            continue
        chosen.append(f)
        for d, own in list(where[f].items()):
            for w in list(own):
                for g in features(w):
                    if g in open_ and (x := where[g].get(d)) is not None:
                        x.discard(w)
                        if not x:
                            del where[g][d]
    return chosen


def fit(labels: np.ndarray, bags: list[list[list[int]]], names: list[str], rounds: int = 200) -> Model:
    """Weights by gradient descent through the noisy-or. ``bags``: for each document, the features of its sentences.

    Every document also has one sentence with the prior's log-odds, for all sentences of which nothing is known, so
    that long clean documents don't gather toxicity.
    """
    bias = float(np.log(PRIOR / (1 - PRIOR)))
    doc_of = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    flat = [s for bag in bags for s in bag]
    feature_of = np.array([f for s in flat for f in s], np.int64)
    sentence_of = np.repeat(np.arange(len(flat)), [len(s) for s in flat]).astype(np.int64)
    w, m, v = np.full(len(names), 1.0), np.zeros(len(names)), np.zeros(len(names))
    base = -np.log1p(-PRIOR)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, w[feature_of], len(flat))
        harmless = base + np.bincount(doc_of, np.logaddexp(0, z), len(labels))
        # d loss / d harmless: the loss is harmless itself for clean documents, -log(1 - exp(-harmless)) for toxic ones.
        slope = np.where(labels > 0, -1 / np.expm1(np.clip(harmless, 1e-9, 500)), 1.0)
        by_sentence = slope[doc_of] / (1 + np.exp(-z))
        grad = np.bincount(feature_of, by_sentence[sentence_of], len(names)) / len(labels) + L2 * w / len(labels)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(bias, {f: float(round(x, 6)) for f, x in zip(names, w, strict=True) if abs(x) > 0.05}, PRIOR)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents outside the held-out fifth: all of them, or those ``most`` with the smallest hash.

    Executors make of each text first its distinct words, then the chosen features of its sentences; the driver sees
    only these lists, for at most ``most`` documents.
    """
    known = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    sample = saved(found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")), "toxicity-sample")

    def distinct(texts: pa.Array) -> dict:
        return {"words": pa.array([" ".join(sorted(set(WORD.findall((t or "").lower())))) for t in texts.to_pylist()], pa.string())}

    rows = rowwise(sample, "text", ["doc_id", "label"], lambda: distinct, "words string").toPandas().sort_values("doc_id")
    y = rows["label"].to_numpy(float)
    names = choose(y, rows["words"].tolist()) if len(y) and y.min() < y.max() else []
    if not names:
        return Model(float(np.log(PRIOR / (1 - PRIOR))), {}, PRIOR)
    finder = Model(0.0, dict.fromkeys(names, 1.0), 0.0)
    index = {f: i for i, f in enumerate(names)}

    def bags(texts: pa.Array) -> dict:
        own = [[sorted(index[f] for f in found) for s in SENTENCE.split((t or "").lower()) if (found := finder.known(WORD.findall(s)))] for t in texts.to_pylist()]
        return {"bag": pa.array(own, pa.list_(pa.list_(pa.int32())))}

    rows = rowwise(sample, "text", ["doc_id", "label"], lambda: bags, "bag array<array<int>>").toPandas().sort_values("doc_id")
    return fit(rows["label"].to_numpy(float), [[list(s) for s in bag] for bag in rows["bag"]], names)


SPANS = "spans array<struct<start:bigint,end:bigint,score:double>>"


def _spans(found: list[list[tuple[int, int, float]]], least: float) -> pa.Array:
    rows = [[{"start": a, "end": b, "score": s} for a, b, s in own if s >= least] for own in found]
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))


def _scored(docs: DataFrame, model: Model, keep: list[str], text: str, least: float = 0.5) -> DataFrame:
    """``keep`` (a struct), score, predicted and spans (start, end and score of each sentence that offends by itself)."""

    def work(texts: pa.Array) -> dict:
        own = texts.to_pylist()
        found = [model.sentences(t) for t in own]
        score = np.array([model.score(t, s) for t, s in zip(own, found, strict=True)], float)
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)), "spans": _spans(found, least)}

    return boxed(docs, text, keep, lambda: work, f"score double, predicted int, {SPANS}")


def scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, score and predicted for each row."""
    return _scored(docs, model, keep, text).select("keep.*", "score", "predicted")


def offending(docs: DataFrame, model: Model, keep: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """``keep`` and ``spans``: start, end and score of each sentence that scores ``least`` or more by itself."""

    return _scored(docs, model, keep, text, least).select("keep.*", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model, learned from ``labels``, doesn't call toxic; columns are unchanged."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    columns = docs.columns
    return _scored(docs, model, columns, "text").where("predicted = 0").select("keep.*")


def score_documents(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = ~learnable(F.col("doc_id"))
    scored = _scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"], "text").select("keep.doc_id", "score", "predicted", "spans")
    located = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", located.alias("offending"))
