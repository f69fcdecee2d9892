"""BPE encoding and decoding by a trie of words.

A word's encoding is known by its last token: the tokens before it are the
encoding of what comes before. So every prefix has one state, the last token of its
encoding, and words that begin alike share the states of that beginning. The
distinct words of a batch are inserted into a trie in sorted order, so that its new
nodes come depth first, and each gets its state from its ancestors: the last token is the one vocabulary
entry among the endings of its path that the encoding of the rest can stand beside without being
merged across (``Trie.apart``). An encoding is read off by going back from token to token.

The tokenizer's file gives vocabulary, merges, special strings and the splitting
of texts into words. Texts are split at spaces first, as a word of the byte-level splitting
always begins at a space that comes before another sign; each distinct stretch is split into
words once while a worker remembers it. Words of over ``LONG`` bytes are walked on
a path of their own that isn't kept, at a cost that grows with their length.

Decoding joins the tokens' bytes; bytes that make no character become U+FFFD.

Defined cases: null and empty texts have no tokens; special strings inside texts
become their own token, as is the library's default; null ids of documents stay null and ids of any size exact; repeated rows are encoded
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tallyworks.llm.common import as_text, tokenizer_file, with_id

#: Longer words are encoded without being kept in the trie.
LONG = 256
_SPACES = re.compile(r" \s")
_BREAK = re.compile(r" (?=\S)")


class Trie:
    #: Nodes of the trie and pairs of tokens, and stretches of text, that a worker keeps, each about 200 bytes. Stretches outlive the trie that encoded them.
    LIMIT, STRETCHES = 500_000, 1_000_000

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        path = tokenizer_file(json_path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, splitting = described["model"], described["pre_tokenizer"]
        if described["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or splitting != splitting | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{json_path} isn't a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in described["added_tokens"]):
            raise ValueError(f"special strings of {json_path} take part of the text around them")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        surface = {s: bytes(map(byte_of.__getitem__, s)) for s in model["vocab"] if s not in self.special}
        self.vocab = {b: model["vocab"][s] for s, b in surface.items()}
        self.surface = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._merges([tuple(surface[x] for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]])
        self._endings()
        self.stretches: dict[str, bytes] = {}  # ids of a space and the stretch
        self._forget()

    def _merges(self, merges: list[tuple[bytes, bytes]]) -> None:
        """Ranks of pairs; the rank at which a token is made, and of what."""
        size = max(self.vocab.values()) + 1
        self.pair: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for rank, (a, b) in enumerate(merges):
            x, y, token = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair[x << 20 | y] = rank
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = rank, x, y
        self.never = len(merges)

    def _endings(self) -> None:
        """For the last three bytes of a path, the lengths of the tokens that end so, longest first; of two bytes likewise."""
        lengths: dict[bytes, set[int]] = {}
        for s in self.vocab:
            if len(s) > 1:
                lengths.setdefault(s[-3:], set()).add(len(s))
        for end in [e for e in lengths if len(e) == 3]:
            lengths[end] |= lengths.get(end[1:], set())
        self.lengths = {end: (*sorted(ns, reverse=True), 1) for end, ns in lengths.items()}

    def _forget(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.back = [-1], [0]  # of each node: the last token, and the node before it
        self.known: dict[int, bool] = {}

    def apart(self, x: int, y: int) -> bool:
        """Whether the tokens x and y stay two tokens side by side.

        Both grow by merges of rising rank. While two parts of them touch, a merge of
        these comes about if its rank is below that of the next merge of either;
        of equal ranks the left one is made first, so x's own merge wins and y's doesn't.
        """
        key = x << 20 | y
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._apart(x, y)
        return found

    def _apart(self, x: int, y: int) -> bool:
        made, pair, never = self.made, self.pair, self.never
        until_x = until_y = never  # the ranks at which the parts go into larger ones
        while True:
            rank = pair.get(x << 20 | y, never)
            if rank < until_x and rank <= until_y and rank < never:
                return False
            if made[x] < 0 and made[y] < 0:
                return True
            if made[x] > made[y]:
                until_x, x = made[x], self.right[x]
            else:
                until_y, y = made[y], self.left[y]

    def insert(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Insert words and give every new node its state; the node where each word ends."""
        child, last, back, ends = self.child.get, self.last, self.back, {}
        for word in sorted(words):
            path = [0]
            node = 0
            for byte in word:
                node = child(node << 8 | byte)
                if node is None:
                    break
                path.append(node)
            for depth in range(len(path), len(word) + 1):
                token, length = self.token_before(word, depth, path, last)
                node = self.child[path[-1] << 8 | word[depth - 1]] = len(last)
                last.append(token)
                back.append(path[depth - length])
                path.append(node)
            ends[word] = path[-1]
        return ends

    def token_before(self, word: bytes, end: int, path: list[int] | range, states: list[int]) -> tuple[int, int]:
        """The last token of the encoding of word[:end], and its length; ``states[path[k]]`` is that of word[:k]."""
        vocab, known, lengths = self.vocab.get, self.known.get, self.lengths
        for length in lengths.get(word[end - 3 : end]) or lengths.get(word[end - 2 : end], (1,)) if end > 2 else lengths.get(word[:end], (1,)):
            token = vocab(word[end - length : end]) if length <= end else None
            if token is None:
                continue
            if length == end:
                return token, length
            before = states[path[end - length]]
            apart = known(before << 20 | token)
            if apart or apart is None and self.apart(before, token):
                return token, length
        raise ValueError(f"no token ends at {end} of {word[:40]!r}")

    def walked(self, word: bytes) -> list[int]:
        """The ids of a word on a path of its own."""
        last, back = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            last[end], length = self.token_before(word, end, range(end), last)
            back[end] = end - length
        return _read(last, back, len(word))

    def words(self, text: str) -> list[bytes]:
        """The words of a text, each with the space that it begins with; letters after at most one space are one."""
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text.encode()]
        return [text[a:b].encode() for _, (a, b) in self.split(text)]

    def learn(self, stretches: Iterable[str], space: str = " ") -> dict[str, bytes]:
        """The ids of stretches with ``space`` before each."""
        words = {s: self.words(space + s) for s in stretches}
        ends = self.insert({w for ws in words.values() for w in ws if len(w) <= LONG})
        last, back = self.last, self.back
        ids = {w: array("I", _read(last, back, end)).tobytes() for w, end in ends.items()}
        for w in {w for ws in words.values() for w in ws if len(w) > LONG}:
            ids[w] = array("I", self.walked(w)).tobytes()
        return {s: ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for s, ws in words.items()}

    def parts(self, text: str) -> Iterator[tuple[bytes, str]]:
        """A text between its special strings: the ids of such a string and what comes after it."""
        special = b""
        for k, part in enumerate(self.marks.split(text) if self.marks and "<" in text else (text,)):
            if k % 2:
                special = array("I", [self.special[part]]).tobytes()
            else:
                yield special, part

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        if max(len(self.last), len(self.known)) > self.LIMIT:
            self._forget()
        if len(self.stretches) > self.STRETCHES:
            self.stretches.clear()
        heads: set[str] = set()
        missing: set[str] = set()
        for t in texts:  # texts are split twice, so that only the distinct stretches of a batch are held
            for _, part in self.parts(t) if t else ():
                head, *rest = stretches(part)
                heads.add(head)
                missing.update(set(rest).difference(self.stretches))
        self.stretches |= self.learn(missing)
        first = self.learn(heads, "")
        out = []
        for t in texts:
            ids = []
            for special, part in self.parts(t) if t else ():
                head, *rest = stretches(part)
                ids += [special, first[head], *map(self.stretches.__getitem__, rest)]
            out.append(b"".join(ids))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; those that no token has are left out."""
        return b"".join([self.surface.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _read(last: list[int], back: list[int], node: int) -> list[int]:
    """The tokens on the way back from a node."""
    out = []
    while node:
        out.append(last[node])
        node = back[node]
    return out[::-1]


def stretches(text: str) -> list[str]:
    """What stands before the first space that another sign follows, and then between such spaces."""
    return _BREAK.split(text) if _SPACES.search(text) else text.split(" ")


_tries: dict[str, Trie] = {}


def loaded(json_path: str) -> Trie:
    if json_path not in _tries:
        _tries[json_path] = Trie(json_path)
    return _tries[json_path]


def encode(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id and ``ids``, the tokens of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [list(array("I", ids)) for ids in loaded(json_path).encode_batch(b["text"].tolist())]})

    return with_id(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, ids array<long>"), docs)


def decode(encoded: DataFrame, json_path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids have no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if i is None else loaded(json_path).decode(i) for i in b["ids"]]})

    return with_id(encoded.select(as_text("doc_id"), "ids").mapInPandas(run, "doc_id string, text string"), encoded)


def digest(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text that they decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trie = loaded(json_path)
            ids = trie.encode_batch(b["text"].tolist())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": list(map(sha, ids)), "decoded_sha256": [sha(trie.decode(array("I", i)).encode()) for i in ids]})

    return with_id(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"), docs)
