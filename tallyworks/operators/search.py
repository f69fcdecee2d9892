"""Search of names by an inverted index.

A name scores 100 if it equals the query, 80 if it begins with it, 60 if it
holds it, and 20 plus the number of the query's characters that it has if there are two (or all of a shorter
query). The last tier hangs on a name's set of characters only. The index
therefore has two tables: names by their parts, for the tiers from 60 up, and the
distinct character sets with their characters and the first names of each; the
hits of a query are counted per set, by its characters, and only the first names of a set are ever
scored. ``k`` names a set are enough for the best ``k``: one of them that a
higher tier takes is in the result already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.text import norm_kana
from tallyworks.operators.lookup import head, runs
from tallyworks.sources.staging import discard, staged


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; each task keeps its own first k before rows meet."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


@dataclass
class Index:
    """Tables over items (category, name, ord); good for up to ``k`` results."""

    parts: DataFrame
    sets: DataFrame
    members: DataFrame
    k: int

    def drop(self) -> None:
        """Delete the tables of an index that was kept."""
        discard(self.parts, self.sets, self.members)


def indexed(items: DataFrame, k: int, keep: bool = False) -> Index:
    """The index of items; names without any character that counts aren't found. One that serves many searches is kept in the shared folder."""
    hold = staged if keep else lambda df, name: df
    rows = items.select("category", "name", "ord", norm_kana(F.col("name")).alias("n")).where("n <> ''")
    parts = hold(rows.select("category", "name", "ord", "n", F.explode(runs(F.col("n"))).alias("part")), "parts")
    signed = rows.withColumn("set", F.array_join(F.array_sort(F.array_distinct(_characters(F.col("n")))), ""))
    members = hold(_first(signed.select("category", "set", "name", "ord"), ["category", "set"], [F.col("ord"), F.col("name")], k).drop("place"), "members")
    sets = hold((members if keep else signed).select("category", "set").distinct().select("category", "set", F.explode(_characters(F.col("set"))).alias("c")), "sets")
    return Index(parts, sets, members, k)


def hits(index: Index, queries: DataFrame) -> DataFrame:
    """(query, category, set, hits) of the character sets that share enough characters with a query."""
    asked = queries.select("query", norm_kana(F.col("query")).alias("q")).where("q <> ''").distinct()
    wanted = asked.select("query", F.length("q").alias("size"), F.explode(_characters(F.col("q"))).alias("c")).groupBy("query", "size", "c").agg(F.count(F.lit(1)).alias("m"))
    counted = wanted.join(index.sets, "c").groupBy("query", "size", "category", "set").agg(F.sum("m").cast("int").alias("hits"))
    return counted.where(F.col("hits") >= F.least(F.lit(2), "size")).drop("size")


def within(index: Index, k: int, categories: list[str] | None) -> Index:
    """The index of some categories, if it is good for ``k`` results."""
    if k > index.k:
        raise ValueError(f"the index is good for {index.k} results")
    some = lambda df: df if categories is None else df.where(F.col("category").isin(categories))
    return Index(some(index.parts), some(index.sets), some(index.members), index.k)


def best(index: Index, queries: DataFrame, k: int | None = None, categories: list[str] | None = None) -> DataFrame:
    """(query, category, name, score, place): the k best of each query and category, ties by ``ord``."""
    k = index.k if k is None else k
    index = within(index, k, categories)
    asked = queries.select("query", norm_kana(F.col("query")).alias("q")).where("q <> ''").distinct()
    n, q = F.col("n"), F.col("q")
    tier = F.when(n == q, 100).when(n.startswith(q), 80).when(n.contains(q), 60)
    near = asked.withColumn("part", head(q)).join(index.parts, "part").withColumn("score", tier).where("score IS NOT NULL").select("query", "category", "name", "ord", "score")
    far = hits(index, queries).join(index.members, ["category", "set"]).select("query", "category", "name", "ord", (F.col("hits") + 20).alias("score"))
    every = near.unionByName(far).groupBy("query", "category", "name", "ord").agg(F.max("score").alias("score"))
    return _first(every, ["query", "category"], [F.desc("score"), F.col("ord"), F.col("name")], k)


def first_of(index: Index, queries: DataFrame, k: int, categories: list[str] | None = None) -> DataFrame:
    """(query, ord, place): the first k items in their own order that score at all under any of the categories.

    An item scores if its characters have hits enough, as one that holds the query
    has all of them; so its sets decide, whatever the tier.
    """
    index = within(index, k, categories)
    found = hits(index, queries).join(index.members, ["category", "set"]).select("query", "ord").distinct()
    return _first(found, ["query"], [F.col("ord")], k)
