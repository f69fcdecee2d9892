"""Queries on weights: the profiles that trainers and sires stand for, judgements and the sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.operators import scoring
from tallyworks.plans import registry as Q
from tallyworks.plans.horses import read
from tallyworks.plans.registry import query

PROFILES = [("light", 405, 470), ("middle", 420, 480), ("heavy", 430, 500), ("default", 430, 500)]
NAMES = [p for p, _, _ in PROFILES]
_case = lambda key: f"CASE {key} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(NAMES)) + " END"
PROFILES_SQL = "(VALUES " + ", ".join(f"('{p}', {a}, {b})" for p, a, b in PROFILES) + ") AS p(profile, low, high)"
TRAINER_BANDS_SQL = f"SELECT s_name AS name, s_suppkey AS ord, {_case('s_suppkey % 4')} AS profile FROM supplier WHERE s_suppkey % 5 <> 0"
SIRE_BANDS_SQL = f"SELECT name, name AS ord, {_case('length(name) % 4')} AS profile FROM (SELECT DISTINCT p_type AS name FROM part) WHERE length(name) % 5 <> 0"


def _first(asked: str, bands: str) -> str:
    return f"SELECT q, name, profile FROM (SELECT a.q, d.*, row_number() OVER (PARTITION BY a.q ORDER BY d.ord) AS k FROM (SELECT DISTINCT {asked} AS q FROM full_offers WHERE {asked} <> '') a JOIN ({bands}) d ON {Q.NEAR_RULE.format(q='a.q', n='d.name')}) WHERE k = 1"


BANDED_SQL = f"""{Q.FULL_SQL}, t AS ({_first('trainer_q', TRAINER_BANDS_SQL)}), s AS ({_first('sire_q', SIRE_BANDS_SQL)}),
  named AS MATERIALIZED (SELECT o.*, row_number() OVER () AS row, t.name AS t_name, t.profile AS t_profile, s.name AS s_name, s.profile AS s_profile FROM full_offers o LEFT JOIN t ON o.trainer_q = t.q LEFT JOIN s ON o.sire_q = s.q),
  picked AS (SELECT row, p.* FROM named JOIN {PROFILES_SQL} ON p.profile IN (t_profile, s_profile) OR (t_profile IS NULL AND s_profile IS NULL AND p.profile = 'default')),
  limits AS (SELECT row, CAST(max(low) AS INTEGER) AS low, CAST(min(high) AS INTEGER) AS high, string_agg(profile, ',' ORDER BY profile) AS profiles FROM picked GROUP BY row),
  banded AS (SELECT * FROM named JOIN limits USING (row))"""


def profile_of(key):
    return F.element_at(F.array(*map(F.lit, NAMES)), (key % 4).cast("int") + 1)


def trainer_bands(spark, sf_dir):
    return read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"), profile_of(F.col("s_suppkey")).alias("profile"))


def sire_bands(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().where(F.length("name") % 5 != 0)
    return names.select("name", F.col("name").alias("ord"), profile_of(F.length("name")).alias("profile"))


def profiles(spark):
    return spark.createDataFrame(PROFILES, "profile string, low int, high int")


def banded(rows, sf_dir):
    spark = rows.sparkSession
    return scoring.banded(rows, "trainer_q", "sire_q", trainer_bands(spark, sf_dir), sire_bands(spark, sf_dir), profiles(spark), "default")


@query(f"{BANDED_SQL} SELECT id, t_name AS trainer_band, s_name AS sire_band, profiles, low, high FROM banded")
def weight_profiles(spark, sf_dir):
    """The first bands whose names score 60 or more, and what the profiles that they name allow together."""
    rows = banded(Q.asked_offers(spark, sf_dir), sf_dir)
    return rows.select("id", F.col("trainer_band.matched").alias("trainer_band"), F.col("sire_band.matched").alias("sire_band"), "profiles", "low", "high")


BAND_SQL = "CASE WHEN weight > high THEN '上限注意' WHEN weight < low THEN '下限注意' WHEN weight <= 420 OR weight >= 520 THEN '警戒線付近' ELSE 'OK帯' END"


@query(f"{BANDED_SQL}, told AS (SELECT *, {Q.NOTES_SQL} AS notes FROM banded) SELECT id, CASE WHEN weight IS NULL THEN 'no weight' ELSE {BAND_SQL} || ' / ' || low || '-' || high || ' / ' || CASE WHEN weight <= 420 THEN 'light_weight -1' ELSE 'no light alert' END || ' / trainer ' || coalesce(t_name || ' ' || t_profile, 'unassigned') || ' / sire ' || coalesce(s_name || ' ' || s_profile, 'unassigned') || CASE WHEN notes <> '' THEN ' / notes ' || notes ELSE '' END END AS judgement FROM told")
def weight_judgement(spark, sf_dir):
    """A weight's band with the light alert, the bands of trainer and sire, and what to follow up."""
    rows = banded(Q.noted(Q.full_offers(spark, sf_dir)), sf_dir)
    return rows.select("id", scoring.weight_judgement(F.col("weight"), F.col("low"), F.col("high"), F.col("trainer_band"), F.col("sire_band"), F.col("notes")).alias("judgement"))


LISTED_SQL = f"SELECT 'trainer' AS side, name, profile FROM ({TRAINER_BANDS_SQL}) UNION ALL SELECT 'trainer', s_name, 'default' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'sire', name, profile FROM ({SIRE_BANDS_SQL})"


@query(f"{Q.W}, listed AS ({LISTED_SQL}), known AS (SELECT 'trainer' AS side, trainer AS name, max_by(grade, trainer_code) AS badge FROM ({Q.GT}) GROUP BY trainer UNION ALL SELECT 'sire', sire, {Q.TIER_SQL} FROM {Q.SIRES}) SELECT side, l.name, l.profile, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, coalesce(badge, '-') AS badge FROM listed l JOIN {PROFILES_SQL} ON l.profile = p.profile LEFT JOIN known k USING (side, name)")
def weight_sheet(spark, sf_dir):
    """The names of each profile with its limits, and the grade or tier of those that the ranks have by exactly that name."""
    side = lambda df, s: df.select(F.lit(s).alias("side"), "name", "profile")
    rest = read(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_name").alias("name"), F.lit("default").alias("profile"))
    listed = side(trainer_bands(spark, sf_dir), "trainer").unionByName(side(rest, "trainer")).unionByName(side(sire_bands(spark, sf_dir), "sire"))
    trainers = Q.ranks(spark, sf_dir, "trainer").groupBy(F.col("trainer").alias("name")).agg(F.max_by("grade", "trainer_code").alias("badge")).withColumn("side", F.lit("trainer"))
    known = trainers.unionByName(Q.sires(spark, sf_dir).select(F.lit("sire").alias("side"), F.col("sire").alias("name"), R.sire_tier(F.col("sire_score")).alias("badge")))
    rows = listed.join(F.broadcast(profiles(spark)), "profile").join(known, ["side", "name"], "left")
    return rows.select("side", "name", "profile", "low", "high", F.coalesce("badge", F.lit("-")).alias("badge"))
