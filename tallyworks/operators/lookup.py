"""Lookups by exact name, else by the first fuzzy match in table order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.text import match_score
from tallyworks.sources.staging import discard, staged

#: Dimensions up to so many rows are broadcast to the fuzzy join; larger ones meet by their parts, or by the first characters of the shorter name.
MAX_BROADCAST_ROWS = 20_000
#: Up to so many pairs of names are all compared.
MAX_PAIRS = 5_000_000
#: Names meet by whole parts where the other side's lengths are no more than so many.
MAX_LENGTHS = 48
#: Lengths of those beginnings. A name takes the longest that it has, so that names with a common beginning don't all meet.
HEADS = (1, 2, 3, 6, 10, 14, 18, 24, 32)

#: A trainer with so many crosses, at most, meets them all; so many subjects of a trainer share a salt.
FEW, SALTED = 200, 200_000

both_prefixes = lambda q, n: q.startswith(n) | n.startswith(q)
either_contains = lambda q, n: q.contains(n) | n.contains(q)
query_contains = lambda q, n: q.contains(n)
name_contains = lambda q, n: n.contains(q)
by_score = lambda q, n: match_score(q, n) >= 60

#: What the rules ask of two names as ``norm`` leaves them: the parts of the listed name among which the asked one is, and those of the asked name.
PARTS = {both_prefixes: ("beginnings", "beginnings"), either_contains: ("runs", "runs"), query_contains: (None, "runs"), name_contains: ("runs", None), by_score: ("runs", None)}
#: A score of 60 also comes from so many characters in common.
SCORED_LENGTH = 40


def characters(c: Column) -> Column:
    """The set of a name's characters, on which the score of common ones hangs."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c, ""))), "")


def common(q_key: Column, chars: Column) -> Column:
    """Whether a name scores 60 by its characters that are among ``chars``."""
    return F.size(F.filter(F.split(q_key, ""), lambda c: chars.contains(c))) >= SCORED_LENGTH


def holds(rule: Callable[[Column, Column], Column], q: Column, n: Column, q_key: Column, n_key: Column) -> Column:
    """The rule for two names of which ``norm`` made the keys. Those of ``PARTS`` compare the keys; a blank key is near to none.

    A score isn't worked out where the keys tell.
    """
    near = n_key.contains(q_key) | ((F.length(q_key) >= SCORED_LENGTH) & common(q_key, n_key)) if rule is by_score else rule(q_key, n_key) if rule in PARTS else rule(q, n)
    return (q_key != "") & (n_key != "") & near


def unless_few(df: DataFrame, rows: int, hint: str = "merge") -> DataFrame:
    """A side of a join that may be broadcast only while it has few rows.

    Spark goes by the bytes of staged files, and then holds their names in many times
    those, in pages of 64 MB, in the driver and for every task.
    """
    return df.hint(hint) if rows > MAX_BROADCAST_ROWS // 2 else df


def head(c: Column) -> Column:
    """The longest of the set beginnings that a name has."""
    return F.coalesce(*[F.when(F.length(c) >= k, F.substring(c, 1, k)) for k in reversed(HEADS)])


def runs(c: Column) -> Column:
    """All parts of a name that may be another's beginning."""
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[of(k) for k in HEADS]))


def by_characters(asked: DataFrame, named: DataFrame, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The pairs (``__k``, ``__n``) of names of which a long asked one scores 60 by characters in common, with them as ``__b``."""
    return asked.where(F.length("__k") >= SCORED_LENGTH).join(each(named.withColumn("__b", characters(F.col("__n")))), common(F.col("__k"), F.col("__b")))


def by_head(asked: DataFrame, named: DataFrame, norm: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """All pairs of which one may hold the other as ``norm`` leaves them: a name that holds another holds its beginning as well."""
    q, n = asked.withColumn("__k", norm(F.col("__q"))), named.withColumn("__k", norm(F.col("__name")))
    beginning, part = (lambda df: df.withColumn("__b", head(F.col("__k"))).drop("__k")), (lambda df: df.withColumn("__b", F.explode(runs(F.col("__k")))).drop("__k"))
    holds, held = part(q).join(beginning(n), "__b"), beginning(q).join(part(n), "__b")
    return holds.unionByName(held).drop("__b")


def pieces(c: Column, which: str, lengths: list[int]) -> Column:
    """The parts of a name that have one of the lengths: its beginnings, or all its ``runs``."""
    if not lengths:
        return F.array().cast("array<string>")
    last = (lambda k: F.lit(1)) if which == "beginnings" else (lambda k: F.length(c) - k + 1)
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), last(k)), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[of(k) for k in lengths]))


def _lengths(c: Column) -> Column:
    return F.array_sort(F.collect_set(F.length(c)))


def _met(parts: tuple | None, asked: list[int], named: list[int]) -> bool:
    """Whether names meet by whole parts: the rule is one of ``PARTS``, and the lengths are few."""
    return parts is not None and (parts[0] is None or len(asked) <= MAX_LENGTHS) and (parts[1] is None or len(named) <= MAX_LENGTHS)


def by_parts(asked: DataFrame, named: DataFrame, fuzzy: Callable[[Column, Column], Column], lengths: tuple[list[int], list[int]], each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The pairs for which a rule of ``PARTS`` holds, from equi joins of one side's parts with the other's whole names: no other pairs meet.

    Takes and keeps ``__k`` of both sides as ``__k`` and ``__n``: the names that the rule compares. ``lengths`` are those
    of the asked and of the listed ones. ``each`` may reduce the listed side by (``__b``, what meets) before it meets.
    """
    of_name, of_query = PARTS[fuzzy]
    asked, named = asked.where("__k <> ''"), named.withColumnRenamed("__k", "__n").where("__n <> ''")
    found = []
    if of_name:
        found.append(asked.withColumn("__b", F.col("__k")).join(each(named.withColumn("__b", F.explode(pieces(F.col("__n"), of_name, lengths[0])))), "__b"))
    if of_query:
        found.append(asked.withColumn("__b", F.explode(pieces(F.col("__k"), of_query, lengths[1]))).join(each(named.withColumn("__b", F.col("__n"))), "__b"))
    if fuzzy is by_score and any(k >= SCORED_LENGTH for k in lengths[0]):
        found.append(by_characters(asked, named, each))
    return reduce(lambda a, b: a.unionByName(b), found).drop("__b")


def pairs(asked: DataFrame, named: DataFrame, fuzzy: Callable[[Column, Column], Column], norm: Callable[[Column], Column] = lambda c: c, size: int | None = None) -> DataFrame:
    """The pairs of ``__q`` and ``__name`` for which ``fuzzy`` holds; a pair may stand more than once."""
    q, n = asked.withColumn("__k", norm(F.col("__q"))), named.withColumn("__k", norm(F.col("__name")))
    if fuzzy in PARTS:
        lengths = tuple(df.agg(_lengths(F.col("__k"))).first()[0] for df in (q, n))
        if _met(PARTS[fuzzy], *lengths):
            return by_parts(q, n, fuzzy, lengths).drop("__k", "__n")
    near, n = holds(fuzzy, F.col("__q"), F.col("__name"), F.col("__k"), F.col("__n")), n.withColumnRenamed("__k", "__n")
    if (size if size is not None else named.count()) <= MAX_BROADCAST_ROWS:
        return q.join(F.broadcast(n), near).drop("__k", "__n")
    keyed = by_head(asked, named, norm).withColumns({"__k": norm(F.col("__q")), "__n": norm(F.col("__name"))})
    found = keyed.where(near).drop("__k", "__n")
    return found.unionByName(by_characters(q, n).drop("__k", "__n", "__b")) if fuzzy is by_score else found


@dataclass(frozen=True)
class Listing:
    """Names to look up in: a table, its columns of names and of their order, the values that a match gives, and the rule of a near match.

    ``fuzzy`` is one of ``PARTS``, which compare names as ``norm`` leaves them, or may hold only where one
    name holds the other as ``norm`` leaves them; a name of which nothing is left is near to none.
    An exact match goes before earlier near ones if ``exact_first``, be ``fuzzy`` true of it or not.
    """

    table: DataFrame
    name: str
    order: str
    values: list[str]
    fuzzy: Callable[[Column, Column], Column]
    norm: Callable[[Column], Column] = lambda c: c
    exact_first: bool = True

    def rows(self) -> DataFrame:
        picked = F.struct(F.col(self.name).alias("matched"), *[F.col(v) for v in self.values])
        return self.table.where(F.trim(self.name) != "").select(F.col(self.name).alias("__name"), F.col(self.order).alias("__ord"), picked.alias("__m"))


def matches(asked: DataFrame, dim: DataFrame, name: str, order: str, values: list[str], fuzzy: Callable[[Column, Column], Column], norm: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(__q, m): the match of each distinct query in ``__q`` that has one, ``m`` with ``matched`` and the values; see ``matches_of_kinds``."""
    found = found_of_kinds(asked.select(F.lit("one").alias("kind"), "__q"), {"one": Listing(dim, name, order, values, fuzzy, norm)})
    return found["one"].select("__q", F.col("one").alias("m"))


def found_of_kinds(asked: DataFrame, listings: dict[str, Listing]) -> dict[str, DataFrame]:
    """(__q, and a column of the kind's name) for each kind of ``matches_of_kinds``, to join; those of many names aren't broadcast."""
    out, n = _looked_up(asked, listings)
    # names are unique here, so a task holds few of them however many rows ask for one
    return {k: unless_few(out.where(F.col("kind") == k).select("__q", k), n.get((k, "asked"), 0), "shuffle_hash") for k in listings}


def matches_of_kinds(asked: DataFrame, listings: dict[str, Listing]) -> DataFrame:
    """(kind, __q, and a column for each kind): the match of each distinct (kind, ``__q``) that has one, in the column of its kind.

    The names of all kinds are staged as one table and all sizes come from one
    job. Kinds with few pairs of names go through one join, by exact matches first.
    Of a kind with many, exact matches are an equi join, and only the queries that
    it leaves meet the others: by whole parts, of each of which the first name is kept
    before any query meets it, or by the fuzzy join. Blank queries match nothing.
    """
    return _looked_up(asked, listings)[0]


def _looked_up(asked: DataFrame, listings: dict[str, Listing]) -> tuple[DataFrame, dict]:
    """The matches, and how many names each (kind, side) has."""
    key = lambda kind, name: F.coalesce(*[F.when(F.col(kind) == k, v.norm(F.col(name))) for k, v in listings.items()])
    asked = staged(asked.where(F.trim("__q") != "").distinct().withColumn("__k", key("kind", "__q")), "asked")
    kinds = {k: v.rows() for k, v in listings.items()}
    of = lambda c, k: [(F.col(c) if j == k else F.lit(None).cast(rows.schema[c].dataType)).alias(f"{c}{j}") for j, rows in kinds.items()]
    named = reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("__kind"), "__name", *of("__ord", k), *of("__m", k)) for k, rows in kinds.items()])
    named = staged(named.withColumn("__k", key("__kind", "__name")), "named")
    sized = named.select(F.col("__kind").alias("kind"), F.lit("named").alias("side"), "__k").unionByName(asked.select("kind", F.lit("asked").alias("side"), "__k"))
    sizes = {(r["kind"], r["side"]): r for r in sized.groupBy("kind", "side").agg(F.count(F.lit(1)).alias("n"), _lengths(F.col("__k")).alias("lengths")).collect()}
    n = {k: r["n"] for k, r in sizes.items()}
    small = [k for k in kinds if (names := n.get((k, "named"), 0)) <= MAX_BROADCAST_ROWS and names * n.get((k, "asked"), 0) <= MAX_PAIRS]
    found = []
    if small:
        q, name = F.col("__q"), F.col("__name")
        near_of = lambda v: holds(v.fuzzy, q, name, F.col("__k"), F.col("__n")) | ((q == name) & F.lit(v.exact_first))
        near_name = F.coalesce(*[F.when(F.col("kind") == k, near_of(listings[k])) for k in small])
        few = named.where(F.col("__kind").isin(small)).withColumnRenamed("__k", "__n")
        near = asked.where(F.col("kind").isin(small)).join(F.broadcast(few), (F.col("kind") == F.col("__kind")) & near_name)
        later = (q != name) & F.col("kind").isin(*[k for k in small if listings[k].exact_first])
        first = F.min_by(F.struct(*[F.col(f"__m{k}").alias(k) for k in kinds]), F.struct(later, *[F.col(f"__ord{k}") for k in kinds])).alias("m")
        found.append(near.groupBy("kind", "__q").agg(first).select("kind", "__q", "m.*"))
    for k in (k for k in kinds if k not in small):
        rows = named.where(F.col("__kind") == k).select("__name", "__k", F.col(f"__ord{k}").alias("__ord"), F.col(f"__m{k}").alias("__m"))
        queries, rule = asked.where(F.col("kind") == k).select("__q", "__k"), listings[k].fuzzy
        best = lambda near, by="__q": near.groupBy(by).agg(F.min_by("__m", F.struct("__ord")).alias("__m"), F.min_by("__ord", F.struct("__ord")).alias("__ord"))
        names, queried = n.get((k, "named"), 0), n.get((k, "asked"), 0)
        rows = unless_few(rows, names)
        exact = best(queries.join(rows.drop("__k"), F.col("__q") == F.col("__name")))
        rest = queries.join(unless_few(exact, queried, "shuffle_hash"), "__q", "left_anti") if listings[k].exact_first else queries
        lengths = tuple(sizes[k, side]["lengths"] if (k, side) in sizes else [] for side in ("asked", "named"))
        if _met(PARTS.get(rule), *lengths):
            near = best(by_parts(rest, rows, rule, lengths, lambda df: best(df, "__b")))  # noqa: B023
        else:
            near = best(pairs(rest.select("__q"), rows.drop("__k"), rule, listings[k].norm, n.get((k, "named"), 0)))
        both = exact.unionByName(near) if listings[k].exact_first else near
        found.append(both.select(F.lit(k).alias("kind"), "__q", *[(F.col("__m") if j == k else F.lit(None).cast(r.schema["__m"].dataType)).alias(j) for j, r in kinds.items()]))
    out = staged(reduce(DataFrame.unionByName, found), "found")
    discard(asked, named)
    return out, n


def first_match(subjects: DataFrame, query: str, dim: DataFrame, name: str, order: str, values: list[str], fuzzy: Callable[[Column, Column], Column], prefix: str = "", norm: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Each subject with ``matched`` and the values of its match; null without one. Distinct queries are looked up once.

    ``subjects`` is read twice; stage it where it is costly.
    """
    found = matches(subjects.select(F.col(query).alias("__q")), dim, name, order, values, fuzzy, norm)
    out = subjects.join(found, F.col(query) == F.col("__q"), "left")
    return out.select(*[subjects[c] for c in subjects.columns], *[F.col(f"m.{v}").alias(f"{prefix}{v}") for v in ("matched", *values)])


def first_cross(subjects: DataFrame, dim: DataFrame, order: str, values: list[str], of_trainer: Callable[[Column, Column], Column] = both_prefixes, of_family: Callable[[Column, Column], Column] = either_contains, norm: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Each subject with the values of the cross of its trainer and family, as ``found_crosses`` finds it; null without one."""
    found = found_crosses(subjects, dim, order, values, of_trainer, of_family, norm)
    return subjects.join(found, ["trainer", "family"], "left").select(*[subjects[c] for c in subjects.columns], *[F.col(f"__c.{v}").alias(v) for v in values])


def found_crosses(subjects: DataFrame, dim: DataFrame, order: str, values: list[str], of_trainer: Callable[[Column, Column], Column] = both_prefixes, of_family: Callable[[Column, Column], Column] = either_contains, norm: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(trainer, family, ``__c`` with the values of their cross) for the distinct pairs of names that have one, to join. Blank names match nothing.

    The exact cross, else the first for which both rules hold: by default the
    trainer a prefix either way and the family a part either way. Distinct
    trainers meet first, and a subject without an exact cross then meets those of its trainers. Where a trainer
    has many crosses or many subjects, both keys set what meets, with the same matches: see ``near_crosses``.
    """
    named = lambda df: df.where((F.trim("trainer") != "") & (F.trim("family") != ""))
    table = staged(named(dim).select(F.col("trainer").alias("__name"), F.col("family").alias("__f"), norm(F.col("family")).alias("__fn"), F.struct(*values).alias("__m"), F.col(order).alias("__ord")), "crosses")
    asked = staged(named(subjects).select(F.col("trainer").alias("__q"), "family").distinct().withColumn("__fk", norm(F.col("family"))), "subjects")
    sides = table.groupBy(F.col("__name").alias("t")).agg(F.count(F.lit(1)).alias("d"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("k")).unionByName(asked.groupBy(F.col("__q").alias("t")).agg(F.lit(0).cast("long").alias("d"), F.count(F.lit(1)).alias("a"), F.max(F.length("__fk")).alias("k")))
    most = sides.agg(F.max("d"), F.max("a"), F.sum((F.col("d") > 0).cast("int")), F.sum("d"), F.sum("a"), F.max("k")).first()
    table, asked = unless_few(table, most[3] or 0), unless_few(asked, most[4] or 0)
    trainers = pairs(asked.select("__q").distinct(), table.select("__name").distinct(), of_trainer, norm, most[2] or 0).select("__q", "__name").distinct()
    best = lambda near: near.groupBy("__q", "family").agg(F.min_by("__m", F.struct("__ord")).alias("__c"))
    exact = best(asked.join(table, (F.col("__q") == F.col("__name")) & (F.col("family") == F.col("__f"))))
    rest = asked.join(exact, ["__q", "family"], "left_anti")
    if (most[0] or 0) <= FEW and (most[1] or 0) <= SALTED:
        near = rest.join(trainers, "__q").join(table, "__name").where(holds(of_family, F.col("family"), F.col("__f"), F.col("__fk"), F.col("__fn")))
    else:
        near = near_crosses(rest, table, trainers, of_family, norm, (most[5] or 0) >= SCORED_LENGTH)
    found = exact.unionByName(best(near))
    found = unless_few(staged(found.withColumnRenamed("__q", "trainer"), "found"), most[4] or 0, "shuffle_hash")
    discard(table, asked)
    return found


def near_crosses(asked: DataFrame, table: DataFrame, trainers: DataFrame, of_family: Callable[[Column, Column], Column], norm: Callable[[Column], Column], long: bool = True) -> DataFrame:
    """The pairs of subjects (__q, family) and crosses (__name, __f) whose trainers are a pair of ``trainers`` and whose families are near.

    Pairs meet by trainer and a second key. A trainer with few crosses meets by
    salts: as many as its subjects fill, and its crosses stand under each. One with many meets by blocks of
    the family: the longest set beginning of the name that the rule lets the other hold, which the other holds as well. Scores of
    ``long`` families need no part in common: these meet the sets of characters that a trainer's crosses have, of
    each of which the first cross stands for all.
    """
    asked, table = asked.withColumn("__fk", norm(F.col("family"))), table.withColumn("__fn", norm(F.col("__f")))
    crosses = table.groupBy("__name").agg(F.count(F.lit(1)).alias("__crosses"))
    is_long = F.length("__fk") >= SCORED_LENGTH
    load = trainers.join(asked.groupBy("__q").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(is_long, 1)).alias("__l")), "__q").groupBy("__name").agg(F.sum("__n").alias("__subjects"), F.sum("__l").alias("__long"))
    # a salt of long names holds as many pairs as one of a trainer with few crosses may
    long_salts = (F.floor(F.col("__long") * F.col("__crosses") / (SALTED * FEW)) + 1).cast("int").alias("__long_salts")
    plan = load.join(crosses, "__name").select("__name", (F.col("__crosses") <= FEW).alias("__few"), (F.floor(F.col("__subjects") / SALTED) + 1).cast("int").alias("__salts"), long_salts)
    tagged = lambda tag, blocks: F.transform(blocks, lambda b: F.concat(F.lit(tag), b))
    of_name, of_query = PARTS.get(of_family, ("runs", "runs"))
    held = lambda tag, ways, f: F.concat(*([tagged(tag[0], F.array(head(f)))] if ways[0] else []), *([tagged(tag[1], runs(f))] if ways[1] else []))
    # both explode in tasks of few bytes, which would be put together
    spread = lambda df, *by: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    of = lambda n: F.pmod(F.xxhash64("__q", "family"), F.col(n)).cast("string")
    every = lambda n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: i.cast("string"))
    of_trainers, of_plan = asked.join(trainers, "__q").join(plan, "__name"), table.join(plan, "__name")
    q = spread(of_trainers, "__q", "family").select("__q", "family", "__fk", "__name", F.explode(F.when(F.col("__few"), F.array(of("__salts"))).otherwise(held("<>", (of_name, of_query), F.col("__fk")))).alias("__b"))
    d = spread(of_plan, "__name", "__f").select("__name", "__f", "__fn", "__m", "__ord", F.explode(F.when(F.col("__few"), every("__salts")).otherwise(held("><", (of_query, of_name), F.col("__fn")))).alias("__b"))
    near = q.join(d, ["__name", "__b"]).where(holds(of_family, F.col("family"), F.col("__f"), F.col("__fk"), F.col("__fn")))
    if of_family is not by_score or not long:
        return near
    first = lambda c: F.min_by(c, F.struct("__ord")).alias(c)
    sets = of_plan.where("NOT __few").groupBy("__name", characters(F.col("__fn")).alias("__s"), "__long_salts").agg(*map(first, ("__f", "__fn", "__m", "__ord")))
    d = sets.select("__name", "__s", "__f", "__fn", "__m", "__ord", F.explode(every("__long_salts")).alias("__b"))
    q = of_trainers.where(is_long & ~F.col("__few")).select("__q", "family", "__fk", "__name", of("__long_salts").alias("__b"))
    return near.unionByName(spread(q, "__name", "__b").join(spread(d, "__name", "__b"), ["__name", "__b"]).where(common(F.col("__fk"), F.col("__s"))).drop("__s"))


def required(rows: DataFrame, message: str) -> DataFrame:
    """The one row there must be; without any, the job fails with ``message``."""
    one = rows.limit(1).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*rows.columns)).alias("r"))
    return one.select(F.when(F.col("n") == 0, F.raise_error(F.lit(message))).otherwise(F.col("r")).alias("r")).select("r.*")
