"""Grouped performance statistics over a horse master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTER_COUNTERS = [f"chuo_gokei_{n}chaku" for n in range(1, 6)] + ["chuo_gokei_chakugai"]


def master(df: DataFrame) -> DataFrame:
    """The working columns of a master whose counters are text: blanks become null, and a row with a blank counter has no starts but keeps its wins."""
    number = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).cast("int")
    starts = sum((number(c) for c in MASTER_COUNTERS[1:]), number(MASTER_COUNTERS[0]))
    return df.select(
        F.trim("chokyoshimei_ryakusho").alias("trainer"), F.trim("chokyoshi_code").alias("trainer_code"), F.trim("ketto6_bamei").alias("family"), F.trim("ketto6_hanshoku_toroku_bango").alias("family_code"),
        F.col("banushi_code").alias("owner"), number(MASTER_COUNTERS[0]).alias("wins"), starts.alias("starts"), number("heichi_honshokin_ruikei").cast("long").alias("prize"),
    )


def entity_stats(df: DataFrame, keys: list[str], min_rows: int = 1, extra: dict[str, Column] | None = None, counted: str | None = None) -> DataFrame:
    """Counts, sums and the derived rates for each key. ``counted`` names a column of row counts where ``df`` is a tally already."""
    total = lambda c, name=None: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name or c)
    n = total(counted, "n_horses") if counted else F.count(F.lit(1)).alias("n_horses")
    sums = df.groupBy(*keys).agg(n, total("wins"), total("starts"), total("prize"), *[c.alias(n) for n, c in (extra or {}).items()])
    return with_rates(sums.where(F.col("n_horses") >= min_rows) if min_rows > 1 else sums)


def with_rates(df: DataFrame) -> DataFrame:
    """Rates of counts and sums. The prize a head is rounded half up from whole hundredths, so that it doesn't hang on how a double falls."""
    wins, starts = F.col("wins").cast("double"), F.col("starts").cast("double")
    smooth = (wins + 1) / (starts + 12)
    per_horse = (F.col("prize") / F.lit(100.0)) / F.greatest(F.col("n_horses"), F.lit(1))
    return df.select(
        "*",
        F.round(F.when(starts > 0, wins / starts).otherwise(0.0), 4).alias("win_rate"),
        F.round(smooth, 4).alias("win_rate_sm"),
        (F.floor(F.col("prize") / F.greatest(F.col("n_horses"), F.lit(1)) + 0.5) / F.lit(100.0)).alias("prize_man_per_horse"),
        F.round(smooth * 100 + 2 * F.log1p(F.greatest(per_horse, F.lit(0.0))), 4).alias("composite_raw"),
    )


def with_share(df: DataFrame, part: str = "club_horses", whole: str = "n_horses", least: float = 0.35, least_rows: int = 3) -> DataFrame:
    """The club's share of a family's horses, and whether the family counts as its own: so many of its horses, and such a share."""
    share = F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return df.withColumn("club_share", F.round(share, 4)).withColumn("club_unique", (F.col(part) >= least_rows) & (share >= least))
