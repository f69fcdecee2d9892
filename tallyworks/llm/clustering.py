"""Clusters around centroids, each vector assigned through a vantage-point tree.

Vectors and centroids have integer components, so that distances and means are
exact. Each round builds a vantage-point tree over the centroids on the driver (a
few dozen rows, the number of clusters is a parameter) and broadcasts it; a task
reads its vectors in batches and searches the tree for each: the node with the
smallest bound goes first, and a node is left only if its bound lies beyond
the best distance so far, so that equally near centroids are all seen and the smaller number
wins. Bounds come from roots in floating point and are widened by more than
their error; distances that decide are integers. All vectors of a batch take their
steps together, each with a queue of its own.

Partitions send one row of sums per centroid and the sums meet in Spark, so the
driver gets one row of them per centroid and component. Vectors are scaled once and kept in the shared folder.

Defined cases: vectors that are null, have another number of components, or a null
or non-finite one, take no part; a null id has no hash, so it starts no centroid,
but is assigned; repeated ids are vectors of their own; fewer vectors than
centroids give as many centroids as there are ids; a table without vectors, or with null ids only, gives an empty result; scaled
components of 2^27 or more would not keep distances within 64 bits and end the job
with a message; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import discard, staged

SIZE, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, "2", 256.0
#: Centroids of a leaf.
LEAF = 3
LARGEST = 1 << 27
#: Vectors that take their steps together.
BATCH = 8192
#: More than the error of a bound, relative to the distances that it is made of.
SLACK = 1e-9


@dataclass
class Node:
    """A centroid, what of the others lies within its radius and what beyond, with the least and largest distance of each; or a leaf's centroids."""

    vantage: int = -1
    inner: int = -1
    outer: int = -1
    reach: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    leaf: tuple[int, ...] = ()


def distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    diff = vectors - centroid
    return np.einsum("ij,ij->i", diff, diff)


class Tree:
    """A vantage-point tree over centroids; the root is node 0."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[Node] = []
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node())
        if len(members) <= LEAF:
            self.nodes[at].leaf = tuple(members)
            return at
        # The member farthest from the first one: a vantage point at the rim parts the others best.
        away = distances(self.centroids[members], self.centroids[members[0]])
        vantage = members[int(away.argmax())]
        rest = [m for m in members if m != vantage]
        d = distances(self.centroids[rest], self.centroids[vantage])
        order = np.argsort(d, kind="stable")
        half = (len(rest) + 1) // 2
        near, far = [rest[k] for k in order[:half]], [rest[k] for k in order[half:]]
        roots = np.sqrt(d[order].astype("f8"))
        node = self.nodes[at]
        node.vantage, node.reach = vantage, (roots[0], roots[half - 1], roots[half], roots[-1])
        node.inner, node.outer = self._build(near), self._build(far)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller number among equals, and its squared distance."""
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)  # each vector's queue: the bounds of nodes that wait in it
        bound[:, 0] = 0.0

        def compare(rows: np.ndarray, d: np.ndarray, centroid: int) -> None:
            better = (d < best[rows]) | (d == best[rows]) & (centroid < number[rows])
            best[rows[better]], number[rows[better]] = d[better], centroid

        live = np.arange(n)
        while len(live):
            queue = bound[live]
            first = queue.argmin(axis=1)
            least = queue[np.arange(len(live)), first]
            on = np.isfinite(least) & (least <= np.sqrt(best[live].astype("f8")) * (1 + SLACK))
            live, first, least = live[on], first[on], least[on]
            bound[live, first] = np.inf
            for at in np.unique(first):
                mine = first == at
                rows, low, node = live[mine], least[mine], self.nodes[at]
                for centroid in node.leaf:
                    compare(rows, distances(vectors[rows], self.centroids[centroid]), centroid)
                if node.vantage >= 0:
                    d = distances(vectors[rows], self.centroids[node.vantage])
                    compare(rows, d, node.vantage)
                    root = np.sqrt(d.astype("f8"))
                    for child, low_reach, high_reach in ((node.inner, *node.reach[:2]), (node.outer, *node.reach[2:])):
                        gap = np.maximum(low_reach - root, root - high_reach) - SLACK * (root + high_reach)
                        bound[rows, child] = np.maximum(np.maximum(gap, low), 0.0)
        return number, best


def scaled(table: DataFrame, size: int = SIZE, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, their components as integers."""
    x = F.col(column)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    small = F.when(F.abs(F.element_at(F.array_sort(F.transform(x, lambda c: -F.abs(c.cast("double")))), 1)) * SCALE < LARGEST, whole)
    checked = F.coalesce(small, F.raise_error(F.lit(f"a component is {LARGEST} or more when scaled")).cast("array<bigint>"))
    return table.where((F.size(x) == size) & F.forall(x, finite)).select("vec_id", checked.alias("v"))


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest hashes; of rows that share an id, the smallest components."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for low in range(0, b.num_rows, BATCH):
            part = b.slice(low, BATCH)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector joins its nearest centroid, and centroids with vectors move to their floored mean."""
    count, size = centroids.shape
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((count, size), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for _, v in _batches(batches, size):
            number, _ = tree.value.nearest(v)
            np.add.at(total, number, v)
            n += np.bincount(number, minlength=count)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64()), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, sums array<long>")
    by_place = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    out = centroids.copy()
    for r in by_place.collect():  # one row per centroid and component
        out[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    tree.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    size = centroids.shape[1]
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _batches(batches, size):
            number, d = tree.value.nearest(v)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(nearest, f"vec_id {kind}, cluster int, distance long")


def clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    vectors = staged(scaled(table, size), "scaled")
    centroids = start(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = staged(assigned(vectors, centroids), "assigned")
    discard(vectors)
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    per = per.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    return found.join(F.broadcast(per), "cluster").join(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int, last: bool) -> str:
    """DuckDB's form of one assignment, and of the move that follows it."""
    near = f"""a{k} AS MATERIALIZED (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT row, cluster, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM long JOIN c{k} USING (place) GROUP BY row, cluster) GROUP BY row)"""
    if last:
        return near
    means = f"SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM long JOIN a{k} USING (row) GROUP BY cluster, place"
    return f"""{near}, c{k + 1} AS MATERIALIZED (SELECT cluster, place, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), y) AS y FROM c{k} LEFT JOIN ({means}) USING (cluster, place))"""


#: The same rounds over one row per vector and component.
SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  long AS MATERIALIZED (SELECT row, place, CAST(floor({SCALE} * CAST(embedding[place] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {SIZE + 1}) g(place)),
  c0 AS MATERIALIZED (SELECT cluster, place, x AS y FROM long JOIN (SELECT row, CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INTEGER) AS cluster FROM kept WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {CENTROIDS}) USING (row)),
  {", ".join(_round_sql(k, k == ROUNDS) for k in range(ROUNDS + 1))}
  SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
  FROM a{ROUNDS} JOIN kept USING (row) JOIN (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY place)) AS h FROM c{ROUNDS} GROUP BY cluster) USING (cluster)"""
