"""Quality classifier: random Fourier features over document statistics.

Statistics of each whole text are standardised and mapped to cosines of random
projections, which approximate a Gaussian kernel; each partition of the
labelled rows sums its part of the normal equations, the driver solves the
ridge system of a fixed size, and an isotonic map over score bins calibrates: it
is fitted on each row's score by the ridge of the other folds.

Defined cases: null and empty texts get the statistics of an empty text; a
table without both labels scores 0.5 everywhere; repeated rows are scored one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import bounded_labels, discard, isotonic, staged, with_labels

STATS = ["log_words", "log_chars", "mean_word", "unique_share", "adjacent_share", "top_share", "symbol_share", "upper_share", "digit_share", "punct_share", "pipe_share", "line_words", "dup_lines", "short_share", "letter_entropy"]
#: The fit uses about so many labelled rows at most.
MAX_FIT_ROWS = 40_000
FEATURES = 256
GAMMA = 0.25
RIDGE = 1e-2
BINS = 200.0
FOLDS = 5


def statistics(text: str | None) -> list[float]:
    t = text or ""
    w = t.split()
    n, chars = max(len(w), 1), max(len(t), 1)
    words = Counter(w)
    letters = Counter(t)
    total = lambda signs: sum(letters[c] for c in signs)
    lines = [x for x in t.split("\n") if x.strip()]
    upper = sum(k for c, k in letters.items() if c.isupper())
    lengths = sum(map(len, w))
    short = sum(k for x, k in words.items() if len(x) <= 3)
    return [
        math.log1p(len(w)), math.log1p(len(t)), lengths / n, len(words) / n ** 0.9, sum(a == b for a, b in zip(w, w[1:])) / n, words.most_common(1)[0][1] / n if w else 0.0,
        total("#*$%&|<>") / chars, upper / chars, total("0123456789") / chars, total(".,;:!?") / chars, letters["|"] / chars,
        math.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), short / n, -sum(k / chars * math.log(k / chars) for k in letters.values()),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of the whole text, staged."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return staged(docs.select("doc_id", stats("text").alias("x")), "statistics")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    curve: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.5)])
    seed: int = 11

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, math.sqrt(2 * GAMMA / len(self.mean)) * 2, (len(self.mean), FEATURES))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ w + rng.uniform(0, 2 * math.pi, FEATURES)), np.ones((len(x), 1)) * 0.3])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def probability(self, raw: np.ndarray) -> np.ndarray:
        x, y = zip(*self.curve)
        return np.clip(np.interp(raw, x, y), 0.001, 0.999)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float).reshape(len(x), len(STATS))


def fit(stats: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit weights and curve on the labelled rows for which ``train`` holds, about ``max_rows`` at most.

    The sums are kept by fold, so that the ridge of all folds but one takes no
    further pass; the weights in the end are those of all rows.
    """
    chosen = bounded_labels(labels, "quality", train, max_rows)
    part = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int")  # equal texts share a fold
    rows = staged(with_labels(stats, chosen, max_rows).withColumn("part", part).repartition(8), "quality-fit")
    got = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(STATS))]).first()
    if not got[0] or got[1] == got[2]:
        discard(rows)
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    model = Model(np.array(got[3 : 3 + len(STATS)], float), np.maximum(np.array(got[3 + len(STATS) :], float), 1e-6))
    sums = rows.mapInPandas(_equations(model), "part int, a binary, b binary").collect()  # FOLDS rows of a fixed size for each of the 8 partitions
    others = [replace(model, weights=solved([r for r in sums if r["part"] != k])) for k in range(FOLDS)]
    model.weights = solved(sums)
    unseen = F.coalesce(*[F.when(F.col("part") == k, _raw(m)("x")) for k, m in enumerate(others)])
    bins = rows.select("y", F.floor(unseen * BINS).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    model.curve = isotonic([((r["bin"] + 0.5) / BINS, r["n"], r["p"]) for r in bins])
    discard(rows)
    return model


def solved(sums: list) -> np.ndarray:
    """The ridge weights from sums of the normal equations."""
    a = sum((np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in sums), np.zeros((FEATURES + 1, FEATURES + 1)))
    b = sum((np.frombuffer(r["b"]) for r in sums), np.zeros(FEATURES + 1))
    return np.linalg.solve(a + RIDGE * np.eye(FEATURES + 1), b)


def _equations(model: Model):
    """Each partition's part of the normal equations, by fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
        for batch in batches:
            z, y, part = model.features(_matrix(batch["x"])), batch["y"].to_numpy(float), batch["part"].to_numpy(int)
            for k in range(FOLDS):
                of = part == k
                a[k] += z[of].T @ z[of]
                b[k] += z[of].T @ y[of]
        yield pd.DataFrame({"part": np.arange(FOLDS, dtype="i4"), "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]})

    return run


def _raw(model: Model):
    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.raw(_matrix(x)), -1, 2))

    return raw


def score(model: Model, x: str = "x") -> Column:
    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.clip(model.raw(_matrix(x)), -1, 2)))

    return probability(F.col(x))
