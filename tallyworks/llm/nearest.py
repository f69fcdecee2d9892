"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors are rotated and dealt to lists by the nearest centres of their two
halves, fitted on a bounded sample; a pair of centres is a list, so a few
hundred centres make as many lists as the rows need, and every vector is
indexed. Within each probed list the rotated vectors are scanned in blocks of
columns: after each block a test on the scaled partial distance,
(D / d) * partial > (1 + EPS / sqrt(d))^2 * bound, abandons the candidates that
are unlikely to be among the nearest, and the survivors get their exact
distance on the original vectors in double precision. As many lists are probed
as hold most true neighbours of some pilot queries among all rows. Lists are
split into parts of bounded size, and the queries that probe a list into slices
of bounded size, so a list with a third of all rows, or of all queries, is
scanned by many tasks.

Defined cases: null and zero vectors and vectors with null or non-finite
components take no part; vectors of different lengths have no distance, so each
length is searched by itself; ties go to the smaller vec_id; repeated rows are
candidates one by one, but a query never finds its own vec_id, and of rows that
share a query's vec_id the least vector asks; fewer candidates than k give all of
them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import staged

#: Centres are fitted on about so many vectors.
FIT_ROWS = 20_000
#: Rows of a list, about, and the most centres of a half: at most a million lists, whose counts (under 40 MB) are known to all tasks.
LIST_ROWS, MAX_CENTRES = 512, 1_024
#: As many lists are probed as hold this share of the true neighbours of so many pilot queries.
PILOT_RECALL, PILOT_QUERIES = 0.95, 128
#: Candidates and queries that meet in one task.
PART_ROWS = SLICE_QUERIES = 4_096
BLOCK = 16
EPS = 2.1


def centres(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Some rounds of Lloyd's method over distinct sampled vectors."""
    x = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(8):
        near = nearest_centres(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centres(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = squared(x, c)
    if k >= len(c):
        return np.argsort(d, axis=1)
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return part if k > 1 else d.argmin(1)[:, None]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances to centres, less the part that all centres share."""
    return (c * c).sum(1)[None, :] - 2 * x @ c.T


class Lists:
    """Pairs of centres of the two halves of rotated vectors."""

    def __init__(self, sample: np.ndarray, rotation: np.ndarray, n: int):
        self.rotation, self.cut = rotation, (sample.shape[1] + 1) // 2
        k = min(MAX_CENTRES, math.ceil(math.sqrt(n / LIST_ROWS)))
        x = sample @ rotation
        self.first, self.second = centres(x[:, : self.cut], k), centres(x[:, self.cut :], k)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        x = x @ self.rotation
        near = lambda part, c: nearest_centres(part, c, 1)[:, 0]
        return near(x[:, : self.cut], self.first) * len(self.second) + near(x[:, self.cut :], self.second)

    def order(self, x: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector, the distances of all lists, infinite for those without ``rows``."""
        x = x @ self.rotation
        a, b = squared(x[:, : self.cut], self.first), squared(x[:, self.cut :], self.second)
        for p, q in zip(a, b):
            yield np.where(rows > 0, (p[:, None] + q[None, :]).ravel(), np.inf)

    def probed(self, distance: np.ndarray, rows: np.ndarray, probes: int, k: int) -> np.ndarray:
        """The ``probes`` nearest lists, more of them if they hold no k rows beside the vector's own."""
        filled = int((rows > 0).sum())
        while True:
            near = np.argpartition(distance, probes - 1)[:probes] if probes < filled else np.flatnonzero(rows > 0)
            if probes >= filled or rows[near].sum() > k:
                return near
            probes *= 2


def usable(embedding: str) -> Column:
    """Whether a vector is there, finite in all components and not zero."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def scan(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rotation: np.ndarray) -> list[tuple]:
    """Up to k (query_id, vec_id, distance) of one list's part for each query."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    rx, rq = (x @ rotation).astype(np.float32), (queries @ rotation).astype(np.float32)
    dims = rx.shape[1]
    blocks = [np.ascontiguousarray(rx[:, a : a + BLOCK]) for a in range(0, dims, BLOCK)]
    head = min(len(ids), 4 * k + 16)
    rows = []
    for q, r, own in zip(queries, rq, query_ids):
        exact = lambda alive: np.sqrt(((x[alive] - q) ** 2).sum(axis=1))
        seen = np.arange(head)
        seen = seen[ids[seen] != own]
        dist = exact(seen)
        alive = np.arange(head, len(ids))
        alive = alive[ids[alive] != own]
        if len(dist) >= k and len(alive):
            bound = np.partition(dist, k - 1)[k - 1] ** 2
            partial = np.zeros(len(alive), dtype=np.float32)
            for b, block in enumerate(blocks):
                d = min((b + 1) * BLOCK, dims)
                part = block[alive] - r[b * BLOCK : d]
                partial += np.einsum("ij,ij->i", part, part)
                if d < dims:
                    stay = partial * (dims / d) <= (1 + EPS / np.sqrt(d)) ** 2 * bound
                    if b == 0 and stay.sum() > 4 * k:  # a tighter bound from the most promising ones
                        best = np.argpartition(partial, k - 1)[:k]
                        bound = min(bound, exact(alive[best]).max() ** 2)
                        stay = partial * (dims / d) <= (1 + EPS / np.sqrt(d)) ** 2 * bound
                else:
                    stay = partial <= bound * 1.0001
                alive, partial = alive[stay], partial[stay]
        seen, dist = np.concatenate((seen, alive)), np.concatenate((dist, exact(alive)))
        top = np.lexsort((ids[seen], dist))[:k]
        rows += zip([own] * len(top), ids[seen[top]].tolist(), dist[top].tolist())
    return rows


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``."""
    clean = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    clean = staged(clean, "clean")
    lengths = [(r[0], r[1]) for r in clean.groupBy(F.size("v")).agg(F.count(F.lit(1))).orderBy(F.size("v")).collect()]
    found = [_nearest(clean.where(F.size("v") == dims), dims, n, every, k) for dims, n in lengths]
    schema = "query_id long, rank int, vec_id long, score double"
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], schema)


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    return np.array(v.tolist(), dtype=float).reshape(len(v), dims)


def probes_needed(base: DataFrame, dims: int, lists: Lists, rows: np.ndarray, asked: list, k: int, recall: float = PILOT_RECALL) -> int:
    """The number of nearest lists that hold ``recall`` of the k nearest of some queries (vec_id, v), which are searched among all rows."""
    ids, q = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked], dtype=float).reshape(-1, dims)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = [(np.empty(0), np.empty(0, int))] * len(q)
        for b in batches:
            x, own, of = _matrix(b["v"], dims), b["vec_id"].to_numpy(), b["list"].to_numpy()
            d = (q * q).sum(1)[:, None] + squared(q, x)
            d[ids[:, None] == own[None, :]] = np.inf
            for i, row in enumerate(d):
                near = np.argpartition(row, k)[:k] if k < len(row) else np.arange(len(row))
                dist, of_near = np.append(top[i][0], row[near]), np.append(top[i][1], of[near])
                first = np.argsort(dist, kind="stable")[:k]
                top[i] = (dist[first], of_near[first])
        out = [(i, d, li) for i, (ds, ls) in enumerate(top) for d, li in zip(ds.tolist(), ls.tolist()) if d < np.inf]
        yield pd.DataFrame(out, columns=["q", "d", "list"]).astype({"q": "i4", "d": "f8", "list": "i4"})

    order = Window.partitionBy("q").orderBy("d", "list")
    near = base.mapInPandas(best, "q int, d double, list int").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).collect()  # k rows a pilot query
    homes: dict[int, list[int]] = {}
    for r in near:
        homes.setdefault(r["q"], []).append(r["list"])
    ranks = []
    for i, distance in enumerate(lists.order(q, rows)):
        for h in homes.get(i, []):
            ranks.append(int((distance < distance[h]).sum()) + 1)
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def _nearest(clean: DataFrame, dims: int, n: int, every: int, k: int) -> DataFrame:
    """The search among ``n`` vectors of one length."""
    spark = clean.sparkSession
    kind = clean.schema["v"].dataType.simpleString()
    some = lambda df, size, of, seed: df.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, size * 1_000_000 // max(of, 1) + 1)).limit(2 * size).collect()  # noqa: E731  # bounded
    sample = np.array([r["v"] for r in some(clean, FIT_ROWS, n, "fit")], dtype=float).reshape(-1, dims)
    if not len(sample):  # a few rows that the hash passed over
        sample = np.array([r["v"] for r in clean.limit(1).collect()], dtype=float)
    lists = Lists(sample, np.linalg.qr(np.random.default_rng(5).normal(size=(dims, dims)))[0], n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list=lists.of(_matrix(b["v"], dims)).astype("i4"))

    base = staged(clean.mapInPandas(assign, f"vec_id long, v {kind}, list int"), "vectors")
    counts = base.groupBy("list").agg(F.count(F.lit(1)).alias("n")).toPandas()  # MAX_CENTRES ** 2 rows at most
    rows = np.zeros(len(lists.first) * len(lists.second), dtype=np.int64)
    rows[counts["list"].to_numpy()] = counts["n"].to_numpy()
    asked = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = probes_needed(base, dims, lists, rows, some(asked, PILOT_QUERIES, asked.count(), "pilot"), k)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = [lists.probed(d, rows, probes, k) for d in lists.order(_matrix(b["v"], dims), rows)]
                yield b.loc[b.index.repeat([len(x) for x in near])].assign(list=np.concatenate(near).astype("i4"))

    asked = asked.mapInPandas(probe, f"vec_id long, v {kind}, list int")
    tiles = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    grid = tiles(base, PART_ROWS, "parts").join(tiles(asked, SLICE_QUERIES, "slices"), "list")
    grid = F.broadcast(staged(grid, "grid"))  # MAX_CENTRES ** 2 rows at most
    one_of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = ["list", "part", "slice"]
    dealt = base.join(grid, "list").withColumn("part", one_of("parts", "part")).withColumn("slice", each("slices")).select("vec_id", "v", *tile)
    asked = asked.join(grid, "list").withColumn("slice", one_of("slices", "slice")).withColumn("part", each("parts")).select("vec_id", "v", *tile)

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = scan(_matrix(q["v"], dims), q["vec_id"].to_numpy(), _matrix(x["v"], dims), x["vec_id"].to_numpy(), k, lists.rotation) if len(q) and len(x) else []
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})

    found = asked.groupBy(*tile).cogroup(dealt.groupBy(*tile)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
