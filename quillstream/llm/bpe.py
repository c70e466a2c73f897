"""Byte-pair encoding with word ends, and its decoding, from a public tokenizer file.

A word is its UTF-8 bytes as symbols, the last marked as a word end. A segment tree holds the rank of every adjacent
pair; the root is the lowest rank, the leftmost where several have it. Merging it changes three leaves, each in
logarithmic time, until no pair can be merged: a "word" of a million letters costs n log n steps, not n squared.

Each different word of a batch of texts is encoded once, and not again while the cache holds it.

Edge cases: null is the empty text, which has no ids; the special tokens' strings in a text become their ids, as the
library does by default; a text, and a word, of any length is encoded whole; of equal ranks the leftmost pair is merged;
repeated rows give one output row each; a table without rows gives none; columns of any name can be kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import held, rowwise

#: White space as the tokenizer's regular expressions take it; its word pattern is read from the file.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NO_PAIR = 1 << 62
#: Words at which a generation of a worker's cache is full, the most bytes of ids of one that enters it, and the
#: characters of texts encoded together.
CACHE, LONGEST, TOGETHER = 100_000, 64, 2_000_000

#: Ids as little-endian 32-bit integers, and what they decode to.
Coded = tuple[bytes, str]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """The parts of a tokenizer file that encoding and decoding need."""

    def __init__(self, content: bytes | str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or spec.get("decoder"):
            raise ValueError("a BPE file without prefix, unknown token and decoder is expected")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", SPACE.pattern[1:-2]))
        symbols = byte_symbols()
        self.inner = [vocab[c] for c in symbols]
        self.final = [vocab[c + end] for c in symbols]
        #: Pair of ids, as one number, to the merge's rank and the id it makes; the same as sorted arrays.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[self.pair_ranks] = [self.merges[k][1] for k in self.pair_keys.tolist()]
        self.symbol_ids = np.array([self.inner, self.final], np.int64)
        self.recent: dict[str | int, Coded] = {}
        self.old: dict[str | int, Coded] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, by a segment tree over the ranks of its adjacent pairs."""
        data = word.encode()
        n = len(data)
        if not n:
            return []
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        if n == 1:
            return ids
        merges = self.merges
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NO_PAIR] * (2 * size)  # leaf i is the pair that starts at symbol i: rank, then place
        for i in range(n - 1):
            if m := merges.get(ids[i] << 32 | ids[i + 1]):
                tree[size + i] = m[0] << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours that are still there

        def put(leaf: int, value: int) -> None:
            k = size + leaf
            if tree[k] == value:
                return
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low

        while (best := tree[1]) != NO_PAIR:
            left = best & 0xFFFFFFFF
            right = after[left]
            ids[left] = merges[ids[left] << 32 | ids[right]][1]
            ids[right] = -1
            after[left] = nxt = after[right]
            if right < size:
                put(right, NO_PAIR)
            if nxt < n:
                before[nxt] = left
                m = merges.get(ids[left] << 32 | ids[nxt])
                put(left, m[0] << 32 | left if m else NO_PAIR)
            else:
                put(left, NO_PAIR)
            if (prev := before[left]) >= 0:
                m = merges.get(ids[prev] << 32 | ids[left])
                put(prev, m[0] << 32 | prev if m else NO_PAIR)
        return [i for i in ids if i >= 0]

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree values of pairs of ids; a negative id is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at] << 32 | place, NO_PAIR)

    def _encode_rows(self, data: list[bytes], size: int) -> Iterator[list[int]]:
        """As encode_word, for words of at most ``size`` + 1 bytes: one tree to a row, a step merges at the root of each."""
        n = np.array(list(map(len, data)))
        row, raw = np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(data), np.uint8)
        col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.full((len(n), size + 2), -1, np.int64)
        ids[row, col] = self.symbol_ids[(col == n[row] - 1).astype(np.int64), raw]
        tree = np.full((len(n), 2 * size), NO_PAIR, np.int64)
        tree[:, size:] = self._leaves(ids[:, :size], ids[:, 1 : size + 1], np.arange(size))
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, size + 3), (len(n), 1))
        before = np.tile(np.arange(-1, size + 1), (len(n), 1))
        live = np.flatnonzero(tree[:, 1] != NO_PAIR)

        def put(leaf: np.ndarray, value: np.ndarray | int) -> None:
            k = size + leaf
            tree[live, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[live, k] = np.minimum(tree[live, 2 * k], tree[live, 2 * k + 1])

        while len(live):
            best = tree[live, 1]
            left, new = best & 0xFFFFFFFF, self.made[best >> 32]
            right = after[live, left]
            nxt, prev = after[live, right], before[live, left]
            ids[live, left], ids[live, right] = new, -1
            after[live, left], before[live, nxt] = nxt, left
            put(np.minimum(right, size - 1), NO_PAIR)  # the last symbol starts no pair, and a leaf past the end is none anyway
            put(left, self._leaves(new, ids[live, nxt], left))
            has = prev >= 0
            if has.any():
                live, kept = live[has], live
                put(prev[has], self._leaves(ids[live, prev[has]], new[has], prev[has]))
                live = kept
            live = live[tree[live, 1] != NO_PAIR]
        there = ids >= 0
        ends = np.cumsum(there.sum(axis=1)).tolist()
        flat, begin = ids[there].tolist(), 0
        for end in ends:
            yield flat[begin:end]
            begin = end

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many different words; words of like length go through the tree together."""
        out: list[list[int]] = [[]] * len(words)
        data = [w.encode() for w in words]
        at: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            at.setdefault(1 << max(3, (len(d) - 2).bit_length() if len(d) > 2 else 0), []).append(i)
        for size, places in at.items():
            if size > 32 or len(places) < 8:
                for i in places:
                    out[i] = self.encode_word(words[i])
            else:
                for i, ids in zip(places, self._encode_rows([data[i] for i in places], size), strict=True):
                    out[i] = ids
        return out

    def _words(self, text: str) -> list[str | int]:
        """Words and special ids of a text."""
        if self.cut is not None and "<" in text and len(parts := self.cut.split(text)) > 1:
            return [x for k, p in enumerate(parts) for x in ([self.special[p]] if k % 2 else self._words(p))]
        if not text.isascii():
            # Lower case goes character by character there, so a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def learn(self, words: set[str | int]) -> dict[str | int, Coded]:
        """The coded form of every different word, from the cache or new."""
        recent, old = self.recent, self.old
        found = {w: x for w in words if (x := recent.get(w)) is not None or (x := old.get(w)) is not None}
        special = [w for w in words if isinstance(w, int)]
        found |= {i: (i.to_bytes(4, "little"), self.tokens[i]) for i in special}
        new = [w for w in words if w not in found]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            found[w] = (array("I", ids).tobytes(), self.decode(ids))
        if len(recent) >= CACHE:  # the full generation becomes the old one; what is used of that moves on
            self.old, self.recent = recent, {}
        self.recent.update((w, x) for w, x in found.items() if len(x[0]) <= LONGEST)
        return found

    def encode(self, text: str | None) -> list[int]:
        words = self._words(text or "")
        coded = self.learn(set(words))
        ids = array("I")
        ids.frombytes(b"".join([coded[w][0] for w in words]))
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them: such files have no decoder that would join words."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids; SHA-256 of the ids, and of the decoded text."""
        out: list[tuple[int, str, str]] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < TOGETHER:
                size += len(texts[to] or "")
                to += 1
            split = [self._words(t or "") for t in texts[at:to]]
            coded = self.learn(set().union(*split))
            for own in split:
                found = [coded[w] for w in own]
                ids = b"".join([x[0] for x in found])
                decoded = " ".join([x[1] for x in found]).encode()
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            at = to
        return out


def _coder(docs: DataFrame, path: str) -> Callable[[], Bpe]:
    """The file is read on the driver and sent to each executor once; its size doesn't depend on the data."""
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    # A worker's own coder, so that what it has read and learned serves all its tasks.
    return lambda: held(("bpe", sent.value), lambda: Bpe(sent.value))


def token_digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 for each row."""
    make = _coder(docs, path)

    def start():
        coder = make()

        def work(texts: pa.Array) -> dict:
            n, ids, decoded = zip(*coder.digests(texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return work

    return rowwise(docs, text, keep, start, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", holds=True)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array of int) for each row."""
    make = _coder(docs, path)
    return rowwise(docs, text, keep, lambda: lambda texts, c=make(): {"ids": pa.array([c.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))}, "ids array<int>", holds=True)


def decode(rows: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded`` for each row of ``ids``; null ids give the empty text."""
    make = _coder(rows, path)
    return rowwise(rows, ids, keep, lambda: lambda rows, c=make(): {"decoded": pa.array([c.decode(x or []) for x in rows.to_pylist()], pa.string())}, "decoded string", holds=True)
