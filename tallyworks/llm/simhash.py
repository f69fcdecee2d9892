"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a variant within half the
radius of both. Every distinct fingerprint emits all its variants within that
distance (2,081 for a radius of 4), equal variants meet in one task, and all
fingerprints that share one are linked as a star, since they lie within the
radius of each other. Dense groups meet at hundreds of variants a member, so an edge of a star is told at one variant only, which
follows from its two ends; the other stars leave it out, and the same fingerprints stay connected. The variant space is cut into cells by parities of its bits, and a fingerprint
travels once to each cell that has variants of it: which these are follows from
the cell and the fingerprint, so blocks of plain fingerprints travel, eight bytes each. Cells go
in slices, so that only one slice's share is on disk at a time; there are more cells and slices where there are more
fingerprints. Components follow by contracting the links in an order that
changes by a hash, so that the rounds grow with the logarithm of a chain; each
round is a written table, and the one before it is deleted.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; equal texts and repeated rows share a fingerprint; null ids take no
part in a component's smallest id; an empty table gives an empty result; other
columns are ignored by ``components`` and kept by ``one_per_group``, which keeps
one row of each group whatever its ids are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import discard, staged

SHINGLE = 4
RADIUS = 4
SEED = 42
#: The least number of slices of the variant space, run one after another.
SLICES = 8
#: Variants that meet in one task, at most about, and tasks a core in a slice.
TASK_VARIANTS, SLICE_TASKS = 500_000, 32
#: The least number of cells, but for few fingerprints: how often one travels then hardly hangs on how many there are.
CELLS = 1024
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half the hashes of the shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    line = b" ".join(w)
    k = min(size, len(w))
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of each whole text as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype="u8").view("i8"))

    return fp(text)


def ball(bits: int) -> np.ndarray:
    """Masks of at most ``bits`` set bits."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)], dtype="u8")


def _cell_of(v: np.ndarray, bits: int) -> np.ndarray:
    """So many parities of random sets of bits: linear, so a variant's cell is that of its fingerprint xor that of its mask."""
    out = np.zeros(v.shape, dtype=np.int64)
    for k, p in enumerate(np.random.default_rng(7).integers(0, 2**64, 40, dtype="u8")[:bits]):
        out |= (np.bitwise_count(v & p).astype(np.int64) & 1) << k
    return out


def _mixed(v: np.ndarray) -> np.ndarray:
    """A one-to-one hash."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(by)
    return v ^ (v >> np.uint64(31))


def told_at(a: np.ndarray, b: np.ndarray, half: int) -> np.ndarray:
    """The variant at which each pair is told, hashed: the first by hash of those between the two that both have.

    One order for all pairs, so that those of a dense group choose the same few variants.
    Stars whose centre is the least fingerprint keep all connected by the edges told where they meet:
    if a pair's variant has a centre below both, this links them by two pairs with a lesser least one, told likewise.
    """
    bits, rest = [], a ^ b
    apart = np.bitwise_count(rest)
    for _ in range(2 * half):
        bits.append(rest & (~rest + np.uint64(1)))
        rest = rest ^ bits[-1]
    first = np.full(a.shape, 2**64 - 1, dtype="u8")
    for k in range(half + 1):
        for some in combinations(bits, k):
            flip = reduce(np.bitwise_or, some, np.zeros_like(a))
            between = (np.bitwise_count(flip) == k) & (apart <= half + k)
            first = np.where(between, np.minimum(first, _mixed(a ^ flip)), first)
    return first


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each range, ``count`` of them, side by side."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def slices_of(variants: int, cores: int) -> int:
    """A power of two: so many slices that each keeps all cores busy for some tasks, between ``SLICES`` and 65,536."""
    return 1 << min(16, max(SLICES - 1, variants // (TASK_VARIANTS * SLICE_TASKS * cores)).bit_length())


class Cells:
    """The variant space in 2^bits cells: a slice, told by the first bits of a cell, and a bucket of it."""

    def __init__(self, masks: np.ndarray, slices: int, bits: int):
        self.slices, self.deep = slices, (slices - 1).bit_length()
        self.bits = max(bits, self.deep)
        cells = _cell_of(masks, self.bits)
        order = np.argsort(cells, kind="stable")
        self.masks, self.cells = masks[order], cells[order]
        # the buckets of each slice that a fingerprint of cell 0 goes to; those of another are these, xor its own bits
        there = np.unique((cells & (slices - 1)) << 32 | cells >> self.deep)
        self.buckets = (there & 0xFFFFFFFF).astype(np.int32)
        self.first = np.searchsorted(there >> 32, np.arange(slices + 1))

    def sent(self, f: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, each once for every bucket of a slice that has variants of it, and these buckets."""
        own = _cell_of(f, self.bits)
        want = part ^ own & (self.slices - 1)
        count = self.first[want + 1] - self.first[want]
        return np.repeat(f, count), self.buckets[_ranges(self.first[want], count)] ^ np.repeat(own >> self.deep, count).astype(np.int32)

    def variants(self, f: np.ndarray, part: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """The variants that fingerprints have in one cell, each with its fingerprint."""
        want = (bucket << self.deep | part) ^ _cell_of(f, self.bits)
        begin = np.searchsorted(self.cells, want)
        count = np.searchsorted(self.cells, want, "right") - begin
        who = np.repeat(f, count)
        return who, who ^ self.masks[_ranges(begin, count)]


def links(fps: DataFrame, n: int, radius: int = RADIUS, slices: int | None = None) -> DataFrame:
    """(a, b): edges that connect all fingerprints linked within ``radius``; ``fps`` has distinct values in ``fp``, ``n`` of them."""
    spark = fps.sparkSession
    masks = ball(radius // 2)
    slices = slices or slices_of(n * len(masks), spark.sparkContext.defaultParallelism)
    cells = Cells(masks, slices, max(min(CELLS - 1, n // 32), n * len(masks) // TASK_VARIANTS).bit_length())
    rows_at_once = max(1, TASK_VARIANTS * slices // len(masks))

    def emit(part: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for low in range(0, len(batch), rows_at_once):
                    who, bucket = cells.sent(batch["fp"].to_numpy()[low : low + rows_at_once].view("u8"), part)
                    order = np.argsort(bucket, kind="stable")
                    who = who[order]
                    names, at = np.unique(bucket[order], return_index=True)
                    yield pd.DataFrame({"bucket": names, "fps": [who[a:b].tobytes() for a, b in zip(at, [*at[1:], len(order)])]})

        return run

    def meet(rows: pd.DataFrame, part: int) -> pd.DataFrame:
        who, v = cells.variants(np.frombuffer(b"".join(rows["fps"]), dtype="u8"), part, int(rows["bucket"].iloc[0]))
        order = np.argsort(v)
        v = v[order]
        same = v[1:] == v[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        nodes, index = np.unique(who[order[shared]], return_inverse=True)
        if not len(nodes):
            return pd.DataFrame({"a": np.array([], "i8"), "b": np.array([], "i8")})
        v = v[shared]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        centre = np.repeat(np.minimum.reduceat(index, starts), np.diff(np.append(starts, len(index))))
        near = (index != centre) & (np.bitwise_count(nodes[index] ^ nodes[centre]) <= radius)  # the colliding pairs, verified
        index, centre, v = index[near], centre[near], v[near]
        here = told_at(nodes[index], nodes[centre], radius // 2) == _mixed(v)
        index, centre = index[here], centre[here]
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            np.minimum.at(new, index, label[centre])
            np.minimum.at(new, centre, label[index])
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[keep].view("i8"), "b": nodes[label[keep]].view("i8")})

    def meet_in(part: int):
        return lambda rows: meet(rows, part)

    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # a slice's shuffle files go when it is written
    try:
        found = []
        for part in range(slices):
            packed = fps.select("fp").mapInPandas(emit(part), "bucket int, fps binary")
            found.append(staged(packed.groupBy("bucket").applyInPandas(meet_in(part), "a long, b long"), f"links-{part}"))
            if len(found) == 64:  # few tables however many slices
                found = [_merged(found)]
        return _merged(found)
    finally:
        spark.conf.set(CLEAN, before)


def _merged(tables: list[DataFrame]) -> DataFrame:
    out = staged(reduce(DataFrame.union, tables).distinct(), "links")
    discard(*tables)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): contract each node into the first of its neighbourhood until no edge is left.

    What comes first is told by a hash that changes every other round: no chain
    is in order for long, and a star contracts in two rounds.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = staged(both.distinct(), "edges")
    roots, turn = None, 0
    while both.limit(1).count():
        key = lambda x: F.struct(F.xxhash64(F.col(x), F.lit(turn // 2)).alias("h"), F.col(x).alias("x"))  # noqa: E731, B023
        step = staged(both.groupBy("a").agg(F.min(key("b")).alias("b")).select("a", F.least(key("a"), "b")["x"].alias("to")), "step")
        to = lambda x: step.select(F.col("a").alias(x), F.col("to").alias(f"{x}_to"))  # noqa: E731, B023
        if roots is None:
            moved = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = roots.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        moved = staged(moved, "roots")
        left = both.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        left = staged(left.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        discard(both, step, roots)
        both, roots, turn = left, moved, turn + 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for rows (doc_id, fp): the fingerprint that stands for the component, and the smallest doc_id in it."""
    first = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    edges = links(first, first.count(), radius)
    roots = connected(edges)
    members = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    members = staged(members, "members")
    least = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    out = staged(members.join(least, "root").select("fp", "root", "component_id"), "groups")
    discard(first, edges, members)
    return out


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = staged(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "marked")
    return marked.join(groups(marked, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group, with all its columns. Null ids come last, and a hash of the row decides between equal ids."""
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    marks = [F.monotonically_increasing_id().alias("place"), F.xxhash64(*plain).alias("hash")]
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", fingerprint(F.col("text")).alias("fp"), *marks), "marked-rows")
    ids = rows.select("doc_id", "fp", "hash", "place")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "place")
    chosen = ids.groupBy("fp").agg(F.min(order).alias("first")).join(groups(ids, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(chosen.select("first.place"), "place", "left_semi").select("row.*")
