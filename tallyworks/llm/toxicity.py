"""Toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded first (compatibility forms, zero-width signs, case, look-alike
letters, accents of Latin letters kept, digit and sign substitutions inside
words and dollar signs at their end), so that ``w0rthle55`` and a Cyrillic
spelling meet the same entry. The lexicon of whole words and word beginnings of
4 to 8 letters is learned from labelled documents, counted once per group of
near copies; an entry must be more frequent in toxic ones by a likelihood-ratio
test, however rare it is, and seed entries stay unless the labels contradict
them. Phrases of an entry and a neighbour that only harmless documents hold are
learned as exceptions. A token takes its heaviest entry, tokens inside an
exception phrase take none, the sum is normalised by the length, and an isotonic
map over score bins, fitted on groups that the lexicon hasn't seen, turns it
into a probability.

Defined cases: a null text counts as empty and gets the score of a text
without hits; without labels of both kinds the seed lexicon is used; repeated
rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import bounded_labels, discard, isotonic, staged, with_labels

#: Letters of other scripts that look like Latin ones, and signs and digits put for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαορεικντυχ", "aeopcyxijsdhkmtbhaopeikvtux"))
SUBSTITUTES = dict(zip("013456789$@!|", "oieasgtbgsaii"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
#: Seed entries and phrases in which an entry is harmless, before those that the labels teach.
SEED = {" idiot": 3.0, " moron": 3.0, " scum ": 3.0, " stupid": 2.0, " pathetic": 2.0, " worthless": 2.0, " disgusting": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser")
#: Lexicon and curve are fitted on about so many labelled documents, which bounds the lexicon by their words.
MAX_FIT_ROWS = 15_000
PREFIXES = range(4, 9)
#: Entries that a task counts before it passes them on.
MAX_COUNTED = 150_000
#: An entry's likelihood ratio against an equal share in both kinds, about the square of four standard deviations.
MIN_RATIO = 16.0
#: Harmless groups that a phrase must stand in, and no toxic one, to be an exception.
MIN_PHRASE = 5
#: One group of so many only calibrates.
INNER_FOLDS = 5
BINS = 16.0

_TABLE = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE))
_SIGNS = str.maketrans(SUBSTITUTES)
_RUN = re.compile(r"[0-9$@!|]{1,4}(?=[^\W\d_])|(?<=[^\W\d_])(?:[0-9]{1,2}|\$+)(?!\w)")
_TOKEN = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> list[str]:
    """The folded tokens of a text."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower().translate(_TABLE)
    return _TOKEN.findall(_RUN.sub(lambda m: m[0].translate(_SIGNS), t))


@dataclass
class Model:
    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.02), (0.25, 0.6), (1.0, 0.95)])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "matcher"}

    @cached_property
    def matcher(self):
        """The automaton of entries and exceptions, built once in each worker that uses the model."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for phrase in self.exceptions:
            auto.add_word(f" {phrase} ", (f" {phrase} ", None))
        for entry, weight in self.entries.items():
            auto.add_word(entry, (entry, weight))
        if len(auto):
            auto.make_automaton()
        return auto

    def hits(self, tokens: list[str]) -> dict[int, float]:
        """Weight by place, in the tokens joined by spaces, of each token that an entry meets and no exception covers."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if tokens and len(self.matcher):
            for end, (entry, weight) in self.matcher.iter(f" {' '.join(tokens)} "):
                start = end - len(entry) + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    best[start] = max(best.get(start, 0.0), weight)
        if spared:  # one sweep over both in order
            spared.sort()
            kept, i, covered = {}, 0, -1
            for k in sorted(best):
                while i < len(spared) and spared[i][0] <= k:
                    covered = max(covered, spared[i][1])
                    i += 1
                if k >= covered:
                    kept[k] = best[k]
            best = kept
        return best

    def raw(self, text: str | None) -> float:
        """Weight of the hits over a length term that grows by the logarithm of the words."""
        tokens = folded(text)
        return sum(self.hits(tokens).values()) / (3.0 + math.log1p(len(tokens))) if tokens else 0.0

    def probability(self, raw: float) -> float:
        x, y = zip(*self.curve)
        return float(min(0.999, max(0.001, np.interp(raw, x, y))))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of documents, by label, for each whole word and word beginning."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            found = set()
            for w in set(folded(text)):
                found.add(f" {w} ")
                found.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
                found.update(e for e in SEED if f" {w} ".startswith(e))
            seen[int(y > 0)].update(found)
        if sum(map(len, seen)) > MAX_COUNTED:
            yield _rows(seen)
            seen = (Counter(), Counter())
    yield _rows(seen)


def _rows(seen: tuple[Counter, Counter]) -> pd.DataFrame:
    keys = list(seen[0] | seen[1])
    return pd.DataFrame({"entry": keys, "neg": [seen[0][k] for k in keys], "pos": [seen[1][k] for k in keys]}).astype({"entry": object, "neg": "int64", "pos": "int64"})


def grouped(labelled: DataFrame) -> DataFrame:
    """Adds ``group``, the smallest hash of the words in fours, which near copies share."""

    @F.pandas_udf("long")
    def least(texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for t in texts:
            w = folded(t)
            out.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 4])) >> 1 for i in range(max(1, len(w) - 3))), default=0))
        return pd.Series(out, dtype="int64")

    return labelled.withColumn("group", least("text"))


def _phrases(model: Model):
    """(phrase, neg, pos): the pairs of words of which the second or the first is a hit, by label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["y"]):
                tokens = folded(text)
                hit = model.hits(tokens)
                if hit:
                    starts = {}
                    at = 0
                    for i, w in enumerate(tokens):
                        starts[at] = i
                        at += len(w) + 1
                    near = {starts[k] for k in hit if k in starts}
                    pairs = {i for j in near for i in (j - 1, j) if 0 <= i < len(tokens) - 1}
                    seen[int(y > 0)].update({f"{tokens[i]} {tokens[i + 1]}" for i in pairs})
            yield _rows(seen)

    return run


def lexicon(single: DataFrame, n_pos: int, n_neg: int, exceptions: tuple[str, ...]) -> Model:
    """Entries and exceptions from texts (text, y), one of each group, of which ``n_pos`` are toxic."""
    pos, neg = F.col("pos"), F.col("neg")
    share = n_pos / (n_pos + n_neg)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((pos + neg) * p))).otherwise(0.0)
    ratio = 2 * (part(pos, share) + part(neg, 1 - share))
    odds = F.log((pos + 0.25) / (n_pos + 0.5)) - F.log((neg + 0.25) / (n_neg + 0.5))
    sums = [F.sum("neg").alias("neg"), F.sum("pos").alias("pos")]
    counts = single.mapInPandas(_features, "entry string, neg long, pos long").groupBy("entry").agg(*sums)
    counts = counts.withColumns({"weight": odds, "told": (ratio >= MIN_RATIO) & (pos >= 4 * neg) & (odds > 2.5)})
    found = counts.where(F.col("told") | F.col("entry").isin(*SEED)).collect()  # bounded by the words of MAX_FIT_ROWS documents
    entries: dict[str, float] = {}
    sure = [r for r in found if r["told"]]
    pure = [r for r in sure if not r["neg"]]
    for r in sorted(sure, key=lambda r: (r["neg"] > 0, len(r["entry"]), r["entry"])):
        told = any(r["entry"].rstrip()[:k] in entries for k in range(2, len(r["entry"])))  # a shorter beginning says as much
        finer = r["neg"] and any(x["entry"].startswith(r["entry"]) and x["pos"] >= 0.3 * r["pos"] for x in pure)
        if not told and not finer:
            entries[r["entry"]] = float(r["weight"])
    denied = {r["entry"] for r in found if r["neg"] and r["pos"] < 4 * r["neg"]}
    model = Model({k: v for k, v in SEED.items() if k not in denied} | entries, exceptions)
    spared = single.mapInPandas(_phrases(model), "entry string, neg long, pos long").groupBy("entry").agg(*sums)
    spared = spared.where((pos == 0) & (neg >= MIN_PHRASE)).select("entry").collect()
    return Model(model.entries, tuple(sorted({*exceptions, *(r["entry"] for r in spared)})))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn lexicon, exceptions and curve from the labelled documents for which ``train`` holds, about ``max_rows`` at most.

    The curve is fitted on the groups of one fold, scored by the lexicon of the
    others; the lexicon that goes with it is then learned from all groups.
    """
    chosen = bounded_labels(labels, "toxic", train, max_rows)
    labelled = staged(grouped(with_labels(docs.select("doc_id", "text"), chosen, max_rows).repartition(24)), "toxic-fit")
    inner = F.pmod(F.xxhash64("group"), F.lit(INNER_FOLDS)) == 0
    single = staged(labelled.groupBy("group", "y").agg(F.min_by("text", "doc_id").alias("text")).select("text", "y", inner.alias("inner")), "toxic-single")
    totals = Counter({(r["y"], r["inner"]): r["n"] for r in single.groupBy("y", "inner").agg(F.count(F.lit(1)).alias("n")).collect()})
    sizes = lambda y: (totals[y, False], totals[y, True])
    (pos, held_pos), (neg, held_neg) = sizes(1), sizes(0)
    model = Model(dict(SEED))
    if pos and neg:
        outer = lexicon(single.where("not inner").select("text", "y"), pos, neg, exceptions)
        model = lexicon(single.select("text", "y"), pos + held_pos, neg + held_neg, exceptions)
        if held_pos and held_neg:
            bins = labelled.where(inner).select("y", F.ceil(_score(outer, True)("text") * BINS).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
            model.curve = isotonic([(max(r["bin"] - 0.5, 0.0) / BINS, r["n"], r["p"]) for r in bins.collect()])
    discard(labelled, single)
    return model


def _score(model: Model, raw: bool = False):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = [model.raw(t) for t in texts]
        return pd.Series(values if raw else [model.probability(x) for x in values], dtype="float64")

    return score


def score(model: Model, text: str = "text") -> Column:
    """The probability column of a text column."""
    return _score(model)(F.col(text))
