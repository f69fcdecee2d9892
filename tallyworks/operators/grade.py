"""Letter grades by rank, and the rank build: statistics of all kinds of entities from one pass, graded together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.operators.place import RANGED, placed
from tallyworks.operators.stats import with_rates, with_share
from tallyworks.sources.staging import discard_named, staged

GRADES = ((0.15, "S"), (0.40, "A"), (0.75, "B"))
OWN_GRADES = ((0.20, "S"), (0.50, "A"), (0.80, "B"))
SCORES = {"S": 6.0, "A": 4.5, "B": 3.0, "C": 1.5, "U": 2.0}


def _letter(share: Column, steps: tuple) -> Column:
    out = F.lit("C")
    for limit, letter in reversed(steps):
        out = F.when(share <= limit, letter).otherwise(out)
    return out


def _marked(rows: DataFrame, letter: Column) -> DataFrame:
    """Rank, grade, score and percentile of placed rows; rows with too few starts have grade U and no rank."""
    out = rows.withColumn("rank", F.when(F.col("enough"), F.col("place").cast("int"))).withColumn("grade", F.when(F.col("enough"), letter).otherwise("U"))
    score = F.coalesce(*[F.when(F.col("grade") == g, F.lit(s)) for g, s in SCORES.items()])
    out = out.withColumn("score", score).withColumn("percentile", F.when(F.col("enough"), F.round(1 - (F.col("rank") - 0.5) / F.col("of"), 4)))
    return out.drop("enough", "place", "of")


def _share() -> Column:
    return (F.col("place") - 0.5) / F.col("of")


def graded(df: DataFrame, min_starts: int, ties: list[str], by: str = "composite_raw", steps=GRADES, partition: list[str] | None = None) -> DataFrame:
    """Adds rank, grade, score and percentile; rows with too few starts get grade U and no rank. ``df`` is read once."""
    rows = df.withColumn("enough", F.coalesce(F.col("starts") >= min_starts, F.lit(False)))
    return _marked(placed(rows, [*(partition or []), "enough"], [F.desc_nulls_last(by), *map(F.col, ties)]), _letter(_share(), steps))


@dataclass(frozen=True)
class Kind:
    """A kind of entity: its keys, whether only the club's horses count, and how it is graded."""

    keys: tuple[str, ...]
    club_only: bool = True
    min_rows: int = 2
    min_starts: int = 0
    steps: tuple = GRADES


ENTITIES = "entities"
NAMES = ("trainer", "trainer_code", "family", "family_code")
#: ``own``: the overall families that count as the club's own, graded among themselves.
KINDS = {
    "trainer": Kind(("trainer", "trainer_code"), min_starts=20),
    "family": Kind(("family", "family_code"), min_starts=15),
    "overall": Kind(("family", "family_code"), club_only=False, min_rows=1, min_starts=15),
    "cross": Kind(("trainer", "family", "family_code"), min_starts=10),
    "own": Kind(("family", "family_code"), club_only=False, min_rows=1, steps=OWN_GRADES),
}


def tally(horses: DataFrame, ours: Column) -> DataFrame:
    """Counts and sums by family, and the club's by trainer as well: what the statistics of every kind are sums of."""
    club = F.coalesce(ours, F.lit(False))
    strip = lambda c: F.trim(F.coalesce(c, F.lit(""))) if horses.schema[c].dataType.simpleString() == "string" else F.col(c)
    keys = [(F.when(club, strip(c)) if c.startswith("trainer") else strip(c)).alias(c) for c in NAMES]
    return horses.groupBy(*keys, club.alias("club")).agg(F.count(F.lit(1)).alias("n_horses"), *[F.sum(c).alias(c) for c in ("wins", "starts", "prize")])


def entities(counted: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row for each entity of the kinds: every row of a tally goes to each kind that it has the keys of, and one aggregate sums all of them."""
    there = lambda c: F.col(c) != "" if counted.schema[c].dataType.simpleString() == "string" else F.col(c).isNotNull()
    targets = []
    for name in kinds:
        kind = KINDS[name]
        holds = F.col("club") if kind.club_only else F.lit(True)
        for c in kind.keys:
            holds = holds & there(c)
        key = F.struct(F.lit(name).alias("kind"), *[(F.col(c) if c in kind.keys else F.lit(None).cast(counted.schema[c].dataType)).alias(c) for c in NAMES])
        targets.append(F.when(holds, key))
    rows = counted.select("n_horses", "wins", "starts", "prize", "club", F.inline(F.filter(F.array(*targets), lambda k: k.isNotNull())))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = rows.groupBy("kind", *NAMES).agg(*map(total, ("n_horses", "wins", "starts", "prize")), F.coalesce(F.sum(F.when(F.col("club"), F.col("n_horses"))), F.lit(0)).alias("club_horses"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(KINDS[k].min_rows)) for k in kinds])
    return with_rates(sums.where(F.col("n_horses") >= least))


def statistics(horses: DataFrame, ours: Column, kinds: tuple[str, ...] = tuple(KINDS), own_share: float = 0.35) -> DataFrame:
    """The entities of the kinds with their rates and the club's share. The horses are read once.

    Only the club's are read where no kind needs the others, so that ``ours`` reaches
    the scan. Overall families are those that the club has horses of, and ``own`` those of
    them that count as its own; these two read the entities, a small table, again.
    """
    wanted = tuple(k for k in KINDS if k != "own" and (k in kinds or k == "overall" and "own" in kinds))
    if all(KINDS[k].club_only for k in wanted):
        horses = horses.where(ours)
    found = with_share(entities(tally(horses, ours), wanted), least=own_share)
    if "overall" not in wanted:
        return found
    found = staged(found, ENTITIES)
    overall = found.where("kind = 'overall'")
    every = overall.join(overall.where("club_horses > 0").select("family_code").distinct(), "family_code", "left_semi").select(*found.columns)
    copies = F.array(*[F.lit("overall")] * ("overall" in kinds), *[F.when(F.col("club_unique"), F.lit("own"))] * ("own" in kinds))
    every = every.withColumn("kind", F.explode(F.array_compact(copies)))
    return found.where("kind <> 'overall'").unionByName(every)


def rank_build(horses: DataFrame, ours: Column, kinds: tuple[str, ...] = tuple(KINDS), own_share: float = 0.35) -> DataFrame:
    """All kinds graded in one staged table: ``kind``, its keys, ``statistics``, rank, grade, score and percentile. What it is made of is deleted."""
    rows = statistics(horses, ours, kinds, own_share)
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(KINDS[k].min_starts)) for k in kinds])
    rows = rows.withColumn("enough", F.coalesce(F.col("starts") >= least, F.lit(False)))
    order = [F.desc_nulls_last("composite_raw"), F.col("family_code"), F.col("trainer_code"), F.col("trainer"), F.col("family")]
    in_place = placed(rows, ["kind", "enough"], order)
    out = staged(_marked(in_place, F.coalesce(*[F.when(F.col("kind") == k, _letter(_share(), KINDS[k].steps)) for k in kinds])), "ranks")
    discard_named(in_place, RANGED)
    discard_named(rows, ENTITIES)
    return out


def name_index(df: DataFrame, name: str, ties: list[str], values: list[str]) -> DataFrame:
    """One row for each name: the last one in output order (by rank, unranked last) wins; ``first_place`` is where the name first stands in it."""
    place = F.struct(F.col("rank").isNull().alias("unranked"), F.coalesce("rank", F.lit(0)).alias("rank"), (-F.col("composite_raw")).alias("c"), *[F.col(c) for c in ties])
    return df.where(~(F.trim(F.coalesce(F.col(name), F.lit(""))) == "")).groupBy(name).agg(F.max_by(F.struct(*values), place).alias("v"), F.min(place).alias("first_place")).select(name, "v.*", "first_place")
