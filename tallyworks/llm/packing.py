"""Order-preserving packing of documents into fixed windows.

Each partition packs its documents in their order. Candidate cuts are the ends
of documents and sentences; f(b) = min over a in (b - 2048, b) of
f(a) + padding + penalty(b) is solved with a monotone queue over f(a) + a, as
the padding of (a, b) is 2048 - b + a. Ends of parts of a sentence, and places in
stretches without any mark, are candidates at higher penalties. Blocks of documents are packed one after
another and the last, unfilled window moves on to the next block, so memory is
bounded by a block and its longest document. The cuts are the cheapest within
each block; across blocks only the last window is open, an approximation.

Sequence ids come from the partition's number and a running count, so a task
that runs again gives the same rows.

Defined cases: null and empty texts are one end token; null and repeated ids
are packed one by one and ids of any size stay exact; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyworks.llm.common import as_text, tokenizer_file, with_id

WINDOW = 2048
END_ID = 1
#: Cost, in tokens of padding, of a cut at the end of a sentence, of a part of one, and elsewhere; document ends cost none.
SENTENCE_PENALTY = 4
CLAUSE_PENALTY = 12
BREAK_PENALTY = 40
#: Stretches without a mark get places this far apart.
MAX_GAP = 64
BLOCK_TOKENS = 1_500_000
_SPACES = re.compile(r" \s")
SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])


class Encoder(dict):
    """Token ids, as bytes, of text units that begin with a space; each distinct unit is encoded once while it is remembered."""

    LIMIT = 100_000

    def __init__(self, json_path: str):
        import json

        import tiktoken

        with open(tokenizer_file(json_path), encoding="utf-8") as f:
            described = json.load(f)
        vocab = described["model"]["vocab"]
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in described["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        surface = {bytes(map(byte_of.__getitem__, k)): v for k, v in vocab.items() if k not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=surface, special_tokens={})
        #: 1 for a token that may end a sentence, 2 for one that may end a part of it.
        self.kinds = np.zeros(max(surface.values()) + 2, dtype=np.int8)
        for s, i in surface.items():
            tail = s.rstrip(b"\"') ")[-1:]
            self.kinds[i] = 1 if tail in (b".", b"!", b"?") or b"\n" in s else 2 * (tail in (b",", b";", b":", b"|", b"#", b"%", b"&", b"*", b"$"))

    def __missing__(self, unit: str) -> bytes:
        """The ids of a space and ``unit``."""
        got = array("I", self.coder.encode_ordinary(" " + unit)).tobytes()
        if len(unit) < 40:
            self[unit] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """The ids that the tokenizer's library gives, its special strings included."""
        if len(self) > self.LIMIT:
            self.clear()
        if "<|" in text:
            return np.frombuffer(b"".join(self.special.get(part) or self.encoded(part) for part in self.marks.split(text)), dtype="<u4")
        return np.frombuffer(self.encoded(text), dtype="<u4")

    def encoded(self, text: str) -> bytes:
        """Before a space and a sign that isn't white space a token always ends, so units between such places stand alone."""
        if text[-1:] == " " or _SPACES.search(text):
            return array("I", self.coder.encode_ordinary(text)).tobytes()
        first, *units = text.split(" ")
        head = array("I", self.coder.encode_ordinary(first)).tobytes()
        return head + b"".join(map(self.__getitem__, units))


_encoders: dict[str, Encoder] = {}


def encoder(json_path: str) -> Encoder:
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(json_path)
    return _encoders[json_path]


def cuts(places: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest cut places; ``places`` rise by at most a window and end with the stream's end."""
    at, cost = [0, *places], [0, *costs]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # places whose best + place rises
    for k in range(1, len(at)):
        b = at[k]
        while b - at[queue[0]] > window:
            queue.popleft()
        a = queue[0]
        best[k] = f = best[a] + window - b + at[a] + cost[k]
        back[k] = a
        f += b
        while queue and best[queue[-1]] + at[queue[-1]] >= f:
            queue.pop()
        queue.append(k)
    out, k = [], len(at) - 1
    while k:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def candidates(ids: np.ndarray, document_ends: np.ndarray, kinds: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Places where a window may end, with the cost of each."""
    kind = np.zeros(len(ids) + 1, dtype=np.int16)
    mark = kinds[ids]
    for k, penalty in ((2, CLAUSE_PENALTY), (1, SENTENCE_PENALTY)):
        kind[np.flatnonzero((mark[:-1] == k) & (mark[1:] != k)) + 1] = penalty
    kind[document_ends - 1] = 0  # the end token stays with its document
    kind[0] = 0
    kind[document_ends] = -1
    places = np.flatnonzero(kind)
    gaps = np.diff(places, prepend=0)
    step = min(MAX_GAP, window)
    for k in np.flatnonzero(gaps > step):
        low, high = places[k] - gaps[k], places[k]
        kind[np.arange(low + step, high, step)] = BREAK_PENALTY
    places = np.flatnonzero(kind)
    return places.tolist(), np.maximum(kind[places], 0).tolist()


class Packer:
    """Packs one partition's documents block by block."""

    def __init__(self, coder: Encoder, partition: int, window: int = WINDOW):
        self.coder, self.window, self.sequence = coder, window, partition << 40
        self.pieces: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, all tokens, ids of the rest of a document
        self.tokens = 0

    def add(self, doc_id, text: str | None) -> None:
        ids = np.append(self.coder.ids(text or ""), np.uint32(END_ID)).astype("<u4")
        self.pieces.append((doc_id, 0, len(ids), ids))
        self.tokens += len(ids)

    def emit(self, final: bool) -> list[tuple]:
        """Rows of the block's windows; all but the last one, unless ``final``."""
        if not self.pieces:
            return []
        ids = np.concatenate([p[3] for p in self.pieces])
        ends = np.cumsum([len(p[3]) for p in self.pieces])
        bounds = cuts(*candidates(ids, ends, self.coder.kinds, self.window), self.window)
        if not final:
            bounds = bounds[:-1]
        rows, rest, low = [], deque(self.pieces), 0
        for high in bounds:
            offset = 0
            while low < high:
                doc_id, start, whole, ids = rest.popleft()
                n = min(len(ids), high - low)
                rows.append((doc_id, start, n, zlib.crc32(ids[:n].tobytes()), whole, self.sequence, offset))
                if n < len(ids):
                    rest.appendleft((doc_id, start + n, whole, ids[n:]))
                low += n
                offset += n
            self.sequence += 1
        self.pieces = list(rest)
        self.tokens = sum(len(p[3]) for p in self.pieces)
        return rows


def pack(docs: DataFrame, json_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer = Packer(encoder(json_path), TaskContext.get().partitionId(), window)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                packer.add(doc_id, text)
                if packer.tokens >= BLOCK_TOKENS:
                    yield _frame(packer.emit(False))
        yield _frame(packer.emit(True))

    return with_id(docs.select(as_text("doc_id"), "text").mapInPandas(run, SCHEMA), docs)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=SCHEMA.names)
