"""Secret scans: three patterns, and a battery of randomness tests for what no pattern names.

The battery takes every run of 20 or more letters, digits and ``+/_-``, infers its encoding (hexadecimal, base 32,
base 64) and tests it three ways against a uniform draw from that alphabet: chi-squared over the alphabet, a runs test
of its kinds of characters (lower case, upper case, digits, signs), lag-1 serial correlation. The three scores are
combined into one, the sum of their squares, which is small for a random key and large for a word, a name or a number.

How small is small depends on the length: in 20 characters a name can look random, in 60 it can't. So the combined score
is turned into a p-value, the probability that a name of this length and alphabet scores as low; that is found by
drawing names from a fixed family of models (letters as in prose, some names with few changes of kind, some with many),
always with the same seed, so no approximation for long runs is asked of short ones. Below the lowest hundredth of what
was drawn p-values follow the power law that it has, so that they go on falling where counting would end: a few keys among
very many names need p-values far below one in as many as can be drawn. Which p-values count is settled by Benjamini and
Hochberg over the whole corpus, for each class of lengths by itself, from a histogram of fixed size, so that many short
words don't hide long keys and don't pass as some.

Edge cases: null is the empty text and has no span; repeated rows are scanned alike, and each counts; a text is scanned
whole, and a run of any length is one run; a run whose characters fit no encoding isn't tested; equal p-values are
found together or not at all; a table without rows gives none; columns of any name can be kept.
Positions are code points, ends exclusive. Spans of the patterns are those of the whole match.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, saved, table

#: The patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: The shortest run that is tested, and the share of false ones among those found.
SHORTEST, FALSE_DISCOVERY = 20, 0.05
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: Bins of the histogram: a bin is a tenth of a power of ten.
BINS = 400
#: Names drawn for each p-value; the lengths for which they are drawn (a run is held against the next shorter one).
DRAWN, LENGTHS = 20_000, (20, 22, 24, 26, 28, 32, 36, 40, 48, 56, 64, 80, 96, 128)
#: P-values below that of so many of the drawn names follow the power law that these names do.
TAIL = 200
#: How often letters occur in prose, in hundredths of a percent, from a to z; between which shares names lie
#: in how often neighbours are of one kind of character, and how often each kind follows a change.
LETTERS = [817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7]
STAY, FOLLOW = (0.5, 0.95), {"lower": 0.5, "upper": 0.2, "digit": 0.2, "sign": 0.1}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind (its place in KINDS) and end of what the patterns find."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding_of(run: str) -> str | None:
    """The first alphabet that has all the run's characters."""
    chars = set(run)
    return next((k for k, letters in ALPHABETS.items() if chars <= set(letters)), None)


def battery(x: np.ndarray, size: int, kinds: np.ndarray | None = None) -> np.ndarray:
    """The combined score of each row of places in an alphabet of ``size``: squares of three standard scores.

    ``kinds`` says of each place what kind of character it is, and runs are of one kind; without it the alphabet has two
    halves.
    """
    kinds = (np.arange(size) >= size / 2).astype(np.int64) if kinds is None else kinds
    rows, n = x.shape
    counts = np.bincount((x + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    chi, df = (counts.astype(float) ** 2).sum(axis=1) * size / n - n, size - 1
    z_chi = (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    # Of two neighbours in a uniform draw, and of three, how likely all are of one kind: moments of the number of runs.
    share = np.bincount(kinds) / size
    two, three = (share**2).sum(), (share**3).sum()
    spread = (n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two**2)
    changes = (kinds[x[:, 1:]] != kinds[x[:, :-1]]).sum(axis=1)
    z_runs = (changes - (n - 1) * (1 - two)) / math.sqrt(spread)
    d = x - x.mean(axis=1, keepdims=True)
    squares = (d * d).sum(axis=1)
    lag = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(squares > 0, squares, 1)
    z_serial = np.where(squares > 0, (lag + 1 / n) * math.sqrt(n), math.sqrt(n))
    return np.maximum(z_chi, 0) ** 2 + z_runs**2 + z_serial**2


def names(alphabet: str, n: int) -> np.ndarray:
    """Places in the alphabet of ``DRAWN`` names of ``n`` characters."""
    rng = np.random.default_rng([n, len(alphabet)])
    kinds = {"lower": str.islower, "upper": str.isupper, "digit": str.isdigit, "sign": lambda c: not c.isalnum()}
    members = {k: [i for i, c in enumerate(alphabet) if test(c)] for k, test in kinds.items()}
    present = [k for k, own in members.items() if own]
    follow = np.cumsum([FOLLOW[k] for k in present]) / sum(FOLLOW[k] for k in present)
    weights = [[LETTERS[ord(alphabet[i].lower()) - ord("a")] if alphabet[i].isalpha() else 1 for i in members[k]] for k in present]
    kind, stay = np.empty((DRAWN, n), np.int64), rng.uniform(*STAY, DRAWN)
    for at in range(n):
        new = np.searchsorted(follow, rng.random(DRAWN), side="right")
        kind[:, at] = new if at == 0 else np.where(rng.random(DRAWN) < stay, kind[:, at - 1], new)
    out = np.empty((DRAWN, n), np.int64)
    for k, (name, w) in enumerate(zip(present, weights, strict=True)):
        where = kind == k
        drawn = np.searchsorted(np.cumsum(w) / sum(w), rng.random(int(where.sum())), side="right")
        out[where] = np.array(members[name])[drawn]
    return out


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Battery:
    """P-values of runs; what the model's names score is drawn once for each alphabet and length."""

    def __init__(self) -> None:
        self._scores: dict[tuple[str, int], np.ndarray] = {}
        self._kinds = {k: np.array([kind_of(c) for c in letters]) for k, letters in ALPHABETS.items()}
        self._places = {k: {c: i for i, c in enumerate(letters)} for k, letters in ALPHABETS.items()}

    def p_value(self, run: str, encoding: str) -> float:
        """How likely a name of the run's length scores as low as the run, or lower."""
        place, size, kinds = self._places[encoding], len(ALPHABETS[encoding]), self._kinds[encoding]
        own = float(battery(np.array([[place[c] for c in run]]), size, kinds)[0])
        n = max(x for x in LENGTHS if x <= len(run))
        if (encoding, n) not in self._scores:
            self._scores[encoding, n] = np.sort(battery(names(ALPHABETS[encoding], n), size, kinds))
        return tail_probability(own, self._scores[encoding, n])

    def candidates(self, text: str) -> list[tuple[int, int, int, int]]:
        """Start, end, class of length and bin of the p-value of every run that has an encoding."""
        out = []
        for m in RUN.finditer(text):
            run = m[0].rstrip("=")
            if (name := encoding_of(run)) is not None:
                p = self.p_value(run, name)
                out.append((m.start(), m.end(), int(math.log2(len(run)) * 2), min(BINS - 1, int(-10 * math.log10(p)))))
        return out


def tail_probability(score: float, drawn: np.ndarray) -> float:
    """How likely a score is as low as this one, by scores that were drawn, sorted.

    Counting them says nothing below one in as many as there are. A sum of squares goes to zero as some power of it, so the
    lowest ``TAIL`` scores give that power (Hill's estimate), and it is followed further down.
    """
    edge = float(drawn[TAIL])
    if score >= edge:
        return float(np.searchsorted(drawn, score, side="right") + 1) / (len(drawn) + 1)
    least = edge / 1000  # lower scores are as good as this one
    power = TAIL / float(np.log(edge / np.maximum(drawn[:TAIL], least)).sum())
    return (TAIL + 1) / (len(drawn) + 1) * (max(score, least) / edge) ** power


#: A worker's own, so that what it has drawn serves all its tasks.
BATTERY = Battery()


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    return BATTERY.candidates(text)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` (a struct of these columns), base (array of start, kind, end) and runs (array of start, end, class, bin)."""

    def work(texts: pa.Array) -> dict:
        found = [t or "" for t in texts.to_pylist()]
        base = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in base_spans(t)] for t in found]
        runs = [[dict(zip(("start", "end", "length", "bin"), s, strict=True)) for s in candidates(t)] for t in found]
        return {
            "base": pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
            "runs": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("bin", pa.int32())]))),
        }

    return boxed(docs, text, keep, lambda: work, "base array<struct<start:bigint,kind:int,end:bigint>>, runs array<struct<start:bigint,end:bigint,length:int,bin:int>>")


def discoveries(histogram: dict[tuple[int, int], int], level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each class of lengths the smallest bin that counts, by Benjamini and Hochberg; classes without one are left out."""
    out: dict[int, int] = {}
    for length in {k for k, _ in histogram}:
        own = {b: n for (k, b), n in histogram.items() if k == length}
        total, passed = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            passed += own[b]
            if total * 10 ** (-b / 10) <= level * passed:
                out[length] = b
    return out


def secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base_sha256 and spans for each row."""
    found = saved(scan(docs, keep, text), "secrets")
    counted = found.select(F.explode("runs").alias("r")).groupBy("r.length", "r.bin").count().collect()  # a bounded number of bins
    cut = discoveries({(r["length"], r["bin"]): r["count"] for r in counted})
    picked = F.filter("runs", lambda r: _any([(r["length"] == k) & (r["bin"] >= b) for k, b in sorted(cut.items())]))
    random = F.transform(picked, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), r["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    number = [F.size(_of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("keep.*", *number, F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", random))).alias("spans"))


def _of_kind(kind: int):
    return F.filter("base", lambda s: s["kind"] == kind)


def _any(tests: list):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def scan_documents(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), ["doc_id"])
