"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as its byte symbols, the last one with the word's end. The heap
holds adjacent pairs by merge rank and place; the pair popped is merged if both
its symbols still stand, and the count is the symbols at first less the merges.
No identifiers are made. Each distinct word is merged once while a worker
remembers it.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows
are counted one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.llm.common import tokenizer_file

SPECIALS = ("<|startoftext|>", "<|endoftext|>")
#: The tokenizer's own splitting of words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPECIAL = regex.compile("|".join(map(regex.escape, SPECIALS)))
#: Signs that Python's split() takes for white space and the tokenizer doesn't.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


class Counter(dict):
    """Tokens of a stretch without white space."""

    LIMIT = 800_000

    def __init__(self, json_path: str):
        with open(tokenizer_file(json_path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.rank: dict[int, int] = {}
        self.product: list[int] = []
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = i
            self.product.append(vocab[a + b])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = [vocab[sign[b]] for b in range(256)]
        self.last = [vocab[sign[b] + end] for b in range(256)]
        self.words: dict[str, int] = {}

    def __missing__(self, stretch: str) -> int:
        t = stretch
        if not t.isascii():
            t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
        t = t.lower()
        n = 0
        for w in (t,) if t.isalpha() else SPLIT.findall(t):
            k = self.words.get(w)
            if k is None:
                k = self.merged(w.encode())
                if len(w) < 40:
                    self.words[w] = k
            n += k
        if len(stretch) < 40:
            self[stretch] = n
        return n

    def merged(self, word: bytes) -> int:
        """Symbols at first less merges."""
        n = len(word)
        if n == 1:
            return 1
        rank = self.rank.get
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]], -1]
        pairs = [rank(a << 20 | b) for a, b in zip(ids, ids[1:-1])]
        heap = [r << 32 | i for i, r in enumerate(pairs) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = right[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, _ = self.product[r], -1
            count -= 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                m = rank(new << 20 | ids[k])
                if m is not None:
                    heapq.heappush(heap, m << 32 | i)
            h = left[i]
            if h >= 0:
                m = rank(ids[h] << 20 | new)
                if m is not None:
                    heapq.heappush(heap, m << 32 | h)
        return count

    def count(self, text: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        if len(self.words) > self.LIMIT:
            self.words.clear()
        if "<|" in text:
            return len(_SPECIAL.findall(text)) + sum(map(self.plain, _SPECIAL.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> int:
        stretches = regex.findall(r"\S+", text) if _ODD_SPACE.search(text) else text.split()
        return sum(map(self.__getitem__, stretches))


_counters: dict[str, Counter] = {}


def token_count(text: Column, json_path: str) -> Column:
    """The number of tokens of each whole text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if json_path not in _counters:
            _counters[json_path] = Counter(json_path)
        counter = _counters[json_path]
        return pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))
