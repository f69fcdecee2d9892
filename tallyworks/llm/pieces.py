"""SentencePiece encoding and decoding by a batched Viterbi pass.

Distinct words of the same length advance together, position by position: the
hashes of the substrings that end there probe the sorted keys of the pieces,
and the best admissible one is stored as backpointer. The model at hand merges
by rank, so the plain maximum of score sums would not give its pieces; a
substring is therefore admissible only if the pair that it makes with the
prefix's last piece would not be merged across (``Pieces.stands``), which leaves
exactly the model's own segmentation. As one substring at most is admissible at each place, the maximum over lengths only picks it. Characters that no piece has become
their bytes.

Words of over ``CHUNK`` characters are cut into overlapping chunks of that length,
which advance together as words do. Two neighbours are joined at a place where both
have a boundary and the two pieces beside it stay apart: pieces of which all neighbours stay apart are the model's
own, so the joined ones are. Where neighbours have no such place, as in a run whose period the chunks miss, a chunk that begins
at a boundary follows; such chunks repeat and are remembered.

Defined cases: null and empty texts have no pieces; white space is kept as it
is, but a mark (U+2581) in a text decodes to a space, as it does in the model's
library; null ids stay null and ids of any size exact; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyworks.llm.common import as_text, tokenizer_file, with_id

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Longer units are cut where no piece has the two characters side by side.
LONG = 24
#: Longer stretches go through in chunks; a chunk begins so far after the one before, and shares so much with what is joined already.
CHUNK, STRIDE, SHARED = 128, 64, 32
SIEVE = 1 << 21


class Pieces:
    #: Units that a worker remembers, about 200 bytes each.
    LIMIT = 1_500_000

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model_path))
        n = sp.get_piece_size()
        self.surface = [sp.id_to_piece(i) for i in range(n)]
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.byte_of = np.full(n, -1)
        normal = []
        for i, s in enumerate(self.surface):
            if sp.is_byte(i):
                self.byte_ids[int(s[1:-1], 16)], self.byte_of[i] = i, int(s[1:-1], 16)
            elif not self.special[i]:
                normal.append(i)
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.none = n  # a character without a piece
        self.rank = np.full(n + 1, -1, dtype=np.int64)
        for r, i in enumerate(order):
            if len(self.surface[i]) > 1:
                self.rank[i] = r
        self.longest = max(len(self.surface[i]) for i in normal)
        self.bigrams = {s[k : k + 2] for i in normal for s in (self.surface[i],) for k in range(len(s) - 1)}
        hashes = np.zeros(n + 1, dtype="u8")
        for i in normal:
            h = 0
            for c in self.surface[i]:
                h = (h * int(BASE) + ord(c) + 1) % 2**64
            hashes[i] = h
        by = np.array(normal)[np.argsort(hashes[normal])]
        self.keys, self.key_ids = hashes[by], by
        self.sieve = self._sieve(self.keys)
        self._pairs(normal)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(SIEVE, dtype=bool)
        out[(keys >> np.uint64(20)) % np.uint64(SIEVE)] = True
        return out

    def _pairs(self, normal: list[int]) -> None:
        """Ranks of all pairs whose join is a piece, and the last merge of each piece."""
        id_of = {self.surface[i]: i for i in normal}
        n = self.none + 1
        self.left, self.right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        keys, ranks = [], []
        for s, i in id_of.items():
            if len(s) == 1:
                continue
            splits = [(id_of[s[:k]], id_of[s[k:]]) for k in range(1, len(s)) if s[:k] in id_of and s[k:] in id_of]
            for a, b in splits:
                keys.append(a << 20 | b)
                ranks.append(self.rank[i])
            parts = list(s)
            while len(parts) > 2:  # the merges inside this piece
                options = [(self.rank[id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in id_of]
                if not options:
                    break
                k = min(options)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and parts[0] in id_of and parts[1] in id_of:
                self.left[i], self.right[i] = id_of[parts[0]], id_of[parts[1]]
            elif splits:
                self.left[i], self.right[i] = splits[0]
            else:
                self.rank[i] = -1
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]
        self.pair_sieve = np.zeros(SIEVE, dtype=bool)
        self.pair_sieve[self._slot(self.pair_keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * BASE) >> np.uint64(43)).astype(np.int64)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are a piece's, and the pieces."""
        at = np.flatnonzero(self.sieve[(h >> np.uint64(20)) % np.uint64(SIEVE)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.key_ids[k[hit]]

    def stands(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pieces x and y stay apart: undo their merges from the last one on; no pair of parts that stood side by side may have a join of lower rank than what used it up."""
        ok = np.ones(len(x), dtype=bool)
        live = np.flatnonzero((x != self.none) & (y != self.none))
        x, y = x[live], y[live]
        end = np.iinfo(np.int64).max
        x_used, y_used = np.full(len(x), end), np.full(len(x), end)
        while len(live):
            key = x << 20 | y
            maybe = np.flatnonzero(self.pair_sieve[self._slot(key)])
            merged = np.zeros(len(live), dtype=bool)
            if len(maybe):
                k = np.minimum(np.searchsorted(self.pair_keys, key[maybe]), len(self.pair_keys) - 1)
                hit = self.pair_keys[k] == key[maybe]
                maybe, r = maybe[hit], self.pair_ranks[k[hit]]
                merged[maybe] = (r < x_used[maybe]) & (r <= y_used[maybe])
                ok[live[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~merged & ((rx >= 0) | (ry >= 0))
            live, x, y, x_used, y_used, rx, ry = live[go], x[go], y[go], x_used[go], y_used[go], rx[go], ry[go]
            of_x = rx > ry
            x_used, y_used = np.where(of_x, rx, x_used), np.where(of_x, y_used, ry)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return ok

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Pieces of words of one length; ``none`` for a character without a piece."""
        size, count = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(count, size).astype("u8") + np.uint64(1)
        prefix = np.zeros((size + 1, count), dtype="u8")
        for j in range(size):
            prefix[j + 1] = prefix[j] * BASE + codes[:, j]
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest, BASE))), dtype="u8")
        last = np.full((size + 1, count), self.none, dtype=np.int64)
        back = np.zeros((size + 1, count), dtype=np.int64)
        reached = np.zeros((size + 1, count), dtype=bool)
        reached[0] = True
        for j in range(1, size + 1):
            for k in range(1, min(j, self.longest) + 1):
                at, ids = self.found(prefix[j] - prefix[j - k] * power[k])
                if k == 1:
                    piece = np.full(count, self.none, dtype=np.int64)
                    piece[at] = ids
                    at, ids = np.arange(count), piece
                if not len(at):
                    continue
                fits = reached[j - k, at]
                if j > k:
                    fits &= self.stands(last[j - k, at], ids)
                at, ids = at[fits], ids[fits]
                better = k > back[j, at]  # maxima over the lengths
                at, ids = at[better], ids[better]
                last[j, at], back[j, at], reached[j, at] = ids, k, True
        out = []
        last, back = last.T.tolist(), back.T.tolist()
        for ids, lengths in zip(last, back):
            j, path = size, []
            while j:
                path.append(ids[j])
                j -= lengths[j]
            out.append(path[::-1])
        return out

    def parts(self, unit: str) -> list[str]:
        """A long unit cut where no piece can reach across."""
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.bigrams), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, units: Iterable[str]) -> None:
        by_length = defaultdict(list)
        whole = {u: self.parts(u) for u in units if len(u) > LONG}
        simple = {*(u for u in units if len(u) <= LONG), *(p for ps in whole.values() for p in ps if len(p) <= CHUNK)}
        long = {p for ps in whole.values() for p in ps if len(p) > CHUNK} - self.words.keys()
        chunks = {p[k : k + CHUNK] for p in long for k in range(0, len(p), STRIDE)}
        paths: dict[str, list[int]] = {}
        for u in simple | chunks:
            if u not in self.words or u in chunks:
                by_length[len(u)].append(u)
        for same in by_length.values():
            for low in range(0, len(same), 50_000):
                block = same[low : low + 50_000]
                for u, path in zip(block, self.viterbi(block)):
                    if u in chunks:
                        paths[u] = path
                    if u in simple:
                        self.words[u] = self.packed(u, path)
        for p in long:
            self.words[p] = self.packed(p, self.joined(p, paths))
        for u, ps in whole.items():
            self.words[u] = b"".join([self.words[p] for p in ps])

    def joined(self, part: str, paths: dict[str, list[int]]) -> list[int]:
        """The pieces of a long stretch from those of its chunks."""
        ids, ends = [], [0]  # pieces so far, and the places where they end

        def follow(start: int) -> bool:
            """Go on with the chunk at ``start``, from a place where both have a boundary that stands."""
            chunk = part[start : start + CHUNK]
            if chunk not in paths:
                paths[chunk] = self.viterbi([chunk])[0]
            path, at = paths[chunk], start
            low = bisect_left(ends, start)
            place = {e: low + k for k, e in enumerate(ends[low:])}
            meets = []
            for k, i in enumerate(path):
                if at in place:
                    meets.append((place[at], k))
                at += len(self.surface[i]) if i != self.none else 1
            before = np.array([ids[e - 1] if e else self.none for e, _ in meets], dtype=np.int64)
            stand = np.flatnonzero(self.stands(before, np.array([path[k] for _, k in meets], dtype=np.int64)))
            if not len(stand):
                return False
            e, k = meets[stand[len(stand) // 2]]
            del ids[e:], ends[e + 1 :]
            for i in path[k:]:
                ids.append(i)
                ends.append(ends[-1] + (len(self.surface[i]) if i != self.none else 1))
            return True

        follow(0)
        while ends[-1] < len(part):
            near = ends[-1] - SHARED
            if not follow(near // STRIDE * STRIDE) and not follow(ends[bisect_right(ends, near) - 1]):
                return self.viterbi([part])[0]
        return ids

    def packed(self, unit: str, path: list[int]) -> bytes:
        if self.none in path:
            ids, at = [], 0
            for i in path:
                if i == self.none:
                    ids += self.byte_ids[list(unit[at].encode("utf-8", "surrogatepass"))].tolist()
                    at += 1
                else:
                    ids.append(i)
                    at += len(self.surface[i])
            path = ids
        return np.array(path, dtype="<i4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The model's ids of each whole text."""
        if len(self.words) > self.LIMIT:
            self.words.clear()
        missing: set[str] = set()
        for t in texts:  # texts are split twice, so that only the distinct units of a batch are held
            if t:
                missing.update(units(t))
        missing -= self.words.keys()
        if missing:
            self.learn(missing)
        word = self.words.__getitem__
        return [np.frombuffer(b"".join(map(word, units(t))) if t else b"", dtype="<i4") for t in texts]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that make no character become U+FFFD."""
        out, pending = [], bytearray()
        for i in ids:
            if self.byte_of[i] >= 0:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if not self.special[i]:
                out.append(self.surface[i])
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


def units(text: str) -> list[str]:
    """Stretches that no piece crosses: marks, then other characters."""
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return _UNIT.findall(MARK + text.replace(" ", MARK))
    return [MARK + u for u in text.split(" ")]


_loaded: dict[str, Pieces] = {}


def loaded(model_path: str) -> Pieces:
    if model_path not in _loaded:
        _loaded[model_path] = Pieces(model_path)
    return _loaded[model_path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ``ids``, the pieces of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": loaded(model_path).encode_batch(b["text"].tolist())})

    return with_id(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, ids array<int>"), docs)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [loaded(model_path).decode(i if i is not None else ()) for i in b["ids"]]})

    return with_id(encoded.select(as_text("doc_id"), "ids").mapInPandas(run, "doc_id string, text string"), encoded)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the text back, for every document: encoding and decoding in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = loaded(model_path)
            texts = b["text"].tolist()
            ids = p.encode_batch(texts)
            back = [p.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_pieces": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids], "round_trip": back})

    return with_id(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_pieces long, ids_crc32 long, round_trip boolean"), docs)
