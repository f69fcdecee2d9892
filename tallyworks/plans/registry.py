"""The reference's queries by name, and the SQL that each is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.functions import text as X
from tallyworks.operators import ledger, lookup, scoring, search
from tallyworks.operators.grade import KINDS, name_index, rank_build, statistics
from tallyworks.operators.place import running_sum
from tallyworks.plans.horses import CLUB, HORSES_SQL, OFFERS_SQL, horses, offers, read
from tallyworks.sources.staging import staged

QUERIES, ORACLE_SQL = {}, {}
STATS = ["n_horses", "wins", "starts", "prize", "win_rate", "win_rate_sm", "prize_man_per_horse", "composite_raw"]
GRADED = ["rank", "grade", "score", "percentile"]
#: The test tables spread a family over 25 owners.
OWN_SHARE = 0.04
T, FAM, X2 = ["trainer", "trainer_code"], ["family", "family_code"], ["trainer", "family", "family_code"]


def query(sql: str | None = None):
    """Registers a query, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rates(keys: str, where: str, having: str = "", extra: str = "", source: str = "horses") -> str:
    return f"""SELECT *, round(CASE WHEN starts > 0 THEN CAST(wins AS DOUBLE) / starts ELSE 0 END, 4) AS win_rate, round((wins + 1e0) / (starts + 12), 4) AS win_rate_sm,
  floor(prize * 1e0 / n_horses + 0.5e0) / 100e0 AS prize_man_per_horse, round((wins + 1e0) / (starts + 12) * 100 + 2 * ln(1 + (prize / 100e0) / n_horses), 4) AS composite_raw
  FROM (SELECT {keys}, CAST(count(*) AS BIGINT) AS n_horses, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(starts) AS BIGINT) AS starts, CAST(sum(prize) AS BIGINT) AS prize{extra} FROM {source} WHERE {where} GROUP BY {keys} {having})"""


def grades(source: str, least: int, ties: str, steps=(0.15, 0.40, 0.75)) -> str:
    a, b, c = steps
    return f"""SELECT *, CASE grade WHEN 'S' THEN 6.0e0 WHEN 'A' THEN 4.5e0 WHEN 'B' THEN 3.0e0 WHEN 'C' THEN 1.5e0 ELSE 2.0e0 END AS score, CASE WHEN rank IS NOT NULL THEN round(1 - (rank - 0.5e0) / n, 4) END AS percentile FROM (
  SELECT *, CASE WHEN rank IS NULL THEN 'U' WHEN (rank - 0.5e0) / n <= {a} THEN 'S' WHEN (rank - 0.5e0) / n <= {b} THEN 'A' WHEN (rank - 0.5e0) / n <= {c} THEN 'B' ELSE 'C' END AS grade FROM (
  SELECT *, CASE WHEN starts >= {least} THEN CAST(row_number() OVER (PARTITION BY starts >= {least} ORDER BY composite_raw DESC, {ties}) AS INTEGER) END AS rank, count(*) OVER (PARTITION BY starts >= {least}) AS n FROM ({source})))"""


CLUB_TRAINERS = rates("trainer, trainer_code", f"owner = {CLUB}", "HAVING count(*) >= 2")
CLUB_FAMILIES = rates("family, family_code", f"owner = {CLUB}", "HAVING count(*) >= 2")
OVERALL = rates("family, family_code", f"family_code IN (SELECT family_code FROM horses WHERE owner = {CLUB})", "", f", CAST(sum(CASE WHEN owner = {CLUB} THEN 1 ELSE 0 END) AS BIGINT) AS club_horses")
SHARED = f"SELECT *, round(CAST(club_horses AS DOUBLE) / n_horses, 4) AS club_share, club_horses >= 3 AND CAST(club_horses AS DOUBLE) / n_horses >= 0.04e0 AS club_unique FROM ({OVERALL})"
CROSS = rates("trainer, family, family_code", f"owner = {CLUB}", "HAVING count(*) >= 2")
GT, GF, GO_, GX = (grades(s, n, t) for s, n, t in ((CLUB_TRAINERS, 20, "trainer_code, trainer"), (CLUB_FAMILIES, 15, "family_code, family"), (SHARED, 15, "family_code, family"), (CROSS, 10, "family_code, trainer, family")))
W, WO = f"WITH {HORSES_SQL} ", f"WITH {HORSES_SQL}, {OFFERS_SQL}"
STATS_SQL = ", ".join(STATS)
ALL_SQL = ", ".join(STATS + GRADED)


def stats(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return statistics(horses(spark, sf_dir), F.col("owner") == CLUB, kinds, OWN_SHARE)


def ranks(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The rank build of some kinds: one pass over the horses for all of them."""
    return rank_build(horses(spark, sf_dir), F.col("owner") == CLUB, kinds, OWN_SHARE)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


def family_index(rows: DataFrame, kind: str, *values: str) -> DataFrame:
    """The last row of each family name of a kind, with where the name first stands."""
    return name_index(of_kind(rows, kind), "family", ["family_code"], list(values))


@query(f"{W} SELECT trainer, trainer_code, {STATS_SQL} FROM ({CLUB_TRAINERS})")
def entity_stats_trainer(spark, sf_dir):
    return stats(spark, sf_dir, "trainer").select(*T, *STATS)


@query(f"{W} SELECT trainer, trainer_code, {ALL_SQL} FROM ({GT})")
def grade_trainer(spark, sf_dir):
    return ranks(spark, sf_dir, "trainer").select(*T, *STATS, *GRADED)


@query(f"{W} SELECT family, family_code, {STATS_SQL} FROM ({CLUB_FAMILIES})")
def entity_stats_family(spark, sf_dir):
    return stats(spark, sf_dir, "family").select(*FAM, *STATS)


@query(f"{W} SELECT family, family_code, {STATS_SQL}, club_horses, club_share, club_unique FROM ({SHARED})")
def family_overall_semijoin(spark, sf_dir):
    return stats(spark, sf_dir, "overall").select(*FAM, *STATS, "club_horses", "club_share", "club_unique")


@query(f"{W} SELECT family, family_code, club_horses, {ALL_SQL} FROM ({GO_})")
def grade_family_overall(spark, sf_dir):
    return ranks(spark, sf_dir, "overall").select(*FAM, "club_horses", *STATS, *GRADED)


OWN = grades(f"SELECT * FROM ({SHARED}) WHERE club_unique", 0, "family_code, family", (0.20, 0.50, 0.80))


@query(f"{W} SELECT a.family, a.family_code, a.club_unique, o.rank AS own_rank, o.grade AS own_grade FROM ({SHARED}) a LEFT JOIN ({OWN}) o ON a.family = o.family AND a.family_code = o.family_code")
def unique_family_grade(spark, sf_dir):
    return own_grades(ranks(spark, sf_dir, "overall", "own"))


def own_grades(rows: DataFrame) -> DataFrame:
    """Overall families with their grade among the club's own: both stand in one table, so one aggregate brings them together."""
    own = lambda c: F.max(F.when(F.col("kind") == "own", F.col(c))).alias(f"own_{c}")
    return rows.where("kind IN ('overall', 'own')").groupBy(*FAM).agg(F.max("club_unique").alias("club_unique"), own("rank"), own("grade"))


@query(f"{W} SELECT trainer || '|' || family AS cross_key, trainer, family, family_code, {ALL_SQL} FROM ({GX})")
def cross_stats_grade(spark, sf_dir):
    return ranks(spark, sf_dir, "cross").select(F.concat_ws("|", "trainer", "family").alias("cross_key"), *X2, *STATS, *GRADED)


INDEX = f"SELECT family, family_code, grade, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY (rank IS NULL) DESC, rank DESC, composite_raw, family_code DESC) AS last FROM ({GF})) WHERE last = 1"


@query(f"{W} {INDEX}")
def name_index_last_wins(spark, sf_dir):
    return family_index(ranks(spark, sf_dir, "family"), "family", "family_code", "grade", "rank", "score").drop("first_place")


@query(f"{W} SELECT CAST(count(*) AS BIGINT) AS n_horses, CAST(sum(CASE WHEN coalesce(active, '0') = '0' THEN 1 ELSE 0 END) AS BIGINT) AS n_active, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(starts) AS BIGINT) AS starts FROM horses WHERE owner = {CLUB}")
def axis_counts(spark, sf_dir):
    active = F.sum((F.coalesce("active", F.lit("0")) == "0").cast("long"))
    return horses(spark, sf_dir).where(F.col("owner") == CLUB).agg(F.count(F.lit(1)).alias("n_horses"), active.alias("n_active"), F.sum("wins").alias("wins"), F.sum("starts").alias("starts"))


@query(f"{W} SELECT trainer, trainer_code, CAST(count(*) AS BIGINT) AS n FROM horses WHERE owner = {CLUB} GROUP BY ALL ORDER BY n DESC, trainer_code LIMIT 30")
def axis_top_trainers(spark, sf_dir):
    return horses(spark, sf_dir).where(F.col("owner") == CLUB).groupBy(*T).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "trainer_code").limit(30)


@query(f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = {CLUB} LIMIT 1")
def owner_point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "nation").where(F.col("n_nationkey") == CLUB).select("n_nationkey", "n_name").limit(1)


@query(f"{W} SELECT dam, family, owner FROM (SELECT *, row_number() OVER (PARTITION BY dam ORDER BY CASE WHEN owner = {CLUB} THEN 0 ELSE 1 END, born DESC NULLS LAST, id, line) AS k FROM horses) WHERE k = 1")
def dam_resolve(spark, sf_dir):
    order = Window.partitionBy("dam").orderBy(F.when(F.col("owner") == CLUB, 0).otherwise(1), F.desc_nulls_last("born"), "id", "line")
    return horses(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k = 1").select("dam", "family", "owner")


@query("SELECT s_suppkey, '　Ｓ' || s_name || 'カナ ' AS raw, trim(replace('　Ｓ' || s_name || 'カナ ', '　', ' ')) AS name, lower(replace('Ｓ' || s_name || 'かな', ' ', '')) AS kana, lower(replace('S' || s_name || 'カナ', ' ', '')) AS width FROM supplier")
def norm_names(spark, sf_dir):
    raw = F.concat(F.lit("　Ｓ"), F.col("s_name"), F.lit("カナ "))
    return read(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"), X.norm_name(raw).alias("name"), X.norm_kana(raw).alias("kana"), X.norm_width(raw).alias("width"))


SEARCHES = ["blue", "red", "small", "metal part", "zz"]
NAMES_SQL = "SELECT DISTINCT lower(replace(p_name, ' ', '')) AS n, p_name FROM part"
SCORE_SQL = """CASE WHEN n = q THEN 100 WHEN starts_with(n, q) THEN 80 WHEN contains(n, q) THEN 60 WHEN h >= least(2, length(q)) THEN 20 + h ELSE 0 END"""
SCORED_SQL = f"SELECT query, p_name AS name, CAST({SCORE_SQL} AS INTEGER) AS score FROM (SELECT query, q, n, p_name, (SELECT count(*) FROM generate_series(1, length(q)) g(i) WHERE contains(n, substr(q, CAST(i AS BIGINT), 1))) AS h FROM (SELECT unnest({SEARCHES!r}) AS query), LATERAL (SELECT lower(replace(query, ' ', '')) AS q), ({NAMES_SQL}))"


def searches(spark, sf_dir):
    queries = spark.createDataFrame([(q,) for q in SEARCHES], "query string")
    items = read(spark, sf_dir, "part").select(F.lit("part").alias("category"), F.col("p_name").alias("name")).distinct().withColumn("ord", F.col("name"))
    return queries, items


@query(SCORED_SQL)
def match_score(spark, sf_dir):
    queries, items = searches(spark, sf_dir)
    return items.join(F.broadcast(queries)).select("query", "name", X.match_score(F.col("query"), F.col("name")).cast("int").alias("score"))


@query(f"SELECT query, name, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS place FROM ({SCORED_SQL}) WHERE score > 0) WHERE place <= 10")
def suggest_topk(spark, sf_dir):
    queries, items = searches(spark, sf_dir)
    return search.best(search.indexed(items, 10), queries).select("query", "name", "score", "place")


MULTI_Q = ["pp", "Supplier#000000001", "old", "7", "blue line", "zq"]
ALIAS_SQL = "(SELECT p_name || ' line' AS alias, min(p_name) AS maps_to, 'S' AS manual FROM part WHERE p_size < 8 GROUP BY 1)"
_scored_sql = lambda items, cols: f"SELECT query, {cols}, CAST({SCORE_SQL} AS INTEGER) AS score FROM (SELECT query, q, n, {cols}, (SELECT count(*) FROM generate_series(1, length(q)) g(i) WHERE contains(n, substr(q, CAST(i AS BIGINT), 1))) AS h FROM (SELECT unnest({MULTI_Q!r}) AS query), LATERAL (SELECT lower(replace(query, ' ', '')) AS q), (SELECT *, lower(replace(name, ' ', '')) AS n FROM ({items})))"
MULTI = f"SELECT 'trainer' AS category, s_name AS name, 0 AS later FROM supplier UNION SELECT 'sire', p_type, 0 FROM part UNION SELECT 'family', p_name, 0 FROM part UNION SELECT 'family', alias, 1 FROM {ALIAS_SQL}"
BY_NAME_SQL = f"SELECT query, category, name, score, CAST(row_number() OVER (PARTITION BY query, category ORDER BY score DESC, later, name) AS INTEGER) AS place FROM ({_scored_sql(MULTI, 'category, name, later')}) WHERE score > 0"
CROSS_ITEMS = f"SELECT trainer, family, rank AS ord FROM ({GX}) WHERE grade <> 'U'"
CROSS_HIT_SQL = " UNION ".join(f"SELECT query, cross_key, ord FROM ({_scored_sql(f'SELECT trainer, family, ord, {side} AS name, trainer || chr(124) || family AS cross_key FROM ({CROSS_ITEMS})', 'cross_key, ord')}) WHERE score > 0" for side in ("trainer", "family"))


@query(f"{W} SELECT query, category, name, score, place FROM ({BY_NAME_SQL}) WHERE place <= 8 UNION ALL SELECT query, 'cross', cross_key, NULL, place FROM (SELECT query, cross_key, CAST(row_number() OVER (PARTITION BY query ORDER BY ord, cross_key) AS INTEGER) AS place FROM ({CROSS_HIT_SQL})) WHERE place <= 8")
def multi_search(spark, sf_dir):
    """The eight best trainers, sires and families, aliases among these, of each query, and the first eight crosses of which either name scores."""
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    queries = spark.createDataFrame([(q,) for q in MULTI_Q], "query string")
    of = lambda df, category, name, later, key=None: df.select(F.lit(category).alias("category"), name.alias("name"), F.struct(F.lit(later).alias("place") if isinstance(later, int) else later.alias("place"), (key if key is not None else name).alias("key")).alias("ord")).distinct()
    crosses = of_kind(ranks(spark, sf_dir, "cross"), "cross").where("grade <> 'U'").select("trainer", "family", "rank")
    key = F.concat_ws("|", "trainer", "family")
    items = [
        of(supplier, "trainer", F.col("s_name"), 0), of(part, "sire", F.col("p_type"), 0), of(part, "family", F.col("p_name"), 0), of(part.where("p_size < 8"), "family", F.concat("p_name", F.lit(" line")), 1),
        of(crosses, "cross trainer", F.col("trainer"), F.col("rank"), key), of(crosses, "cross family", F.col("family"), F.col("rank"), key),
    ]
    index = search.indexed(reduce(DataFrame.unionByName, items), 8)
    by_name = search.best(index, queries, 8, ["trainer", "sire", "family"]).select("query", "category", "name", "score", "place")
    first = search.first_of(index, queries, 8, ["cross trainer", "cross family"])
    return by_name.unionByName(first.select("query", F.lit("cross").alias("category"), F.col("ord.key").alias("name"), F.lit(None).cast("int").alias("score"), "place"))


def prefixes(spark, sf_dir):
    """A dimension of shortened supplier names: some exact, some cut."""
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0")
    name = F.when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).otherwise(F.expr("substring(s_name, 1, length(s_name) - 1)"))
    return s.select(name.alias("name"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 5).cast("double").alias("pts"))


PREFIX_SQL = "dims AS (SELECT CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE substr(s_name, 1, length(s_name) - 1) END AS name, s_suppkey AS ord, CAST(s_suppkey % 5 AS DOUBLE) AS pts FROM supplier WHERE s_suppkey % 3 <> 0)"


@query(f"WITH {PREFIX_SQL} SELECT s_suppkey, matched, coalesce(pts, 2.0e0) AS pts FROM (SELECT s_suppkey, d.name AS matched, d.pts, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN d.name = s_name THEN 0 ELSE 1 END, d.ord) AS k FROM supplier LEFT JOIN dims d ON starts_with(s_name, d.name) OR starts_with(d.name, s_name)) WHERE k = 1")
def lookup_exact_then_prefix(spark, sf_dir):
    found = lookup.first_match(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", prefixes(spark, sf_dir), "name", "ord", ["pts"], lookup.both_prefixes)
    return found.select("s_suppkey", "matched", F.coalesce("pts", F.lit(2.0)).alias("pts"))


@query("WITH dims AS (SELECT p_type AS name, CAST(row_number() OVER (ORDER BY p_type DESC) AS INTEGER) AS ord FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, matched, coalesce(4.0e0 - ord * 0.25e0, 2.0e0) AS score FROM (SELECT p_partkey, d.name AS matched, ord, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS k FROM part LEFT JOIN dims d ON contains(p_type || ' x', d.name)) WHERE k = 1")
def lookup_substring_first(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    dims = part.select(F.col("p_type").alias("name")).distinct().withColumn("ord", F.row_number().over(Window.orderBy(F.desc("name"))))
    asked = part.select("p_partkey", F.concat("p_type", F.lit(" x")).alias("q"))
    found = lookup.first_match(asked, "q", dims, "name", "ord", ["ord"], lookup.query_contains)
    return found.select("p_partkey", "matched", F.coalesce(4.0 - F.col("ord") * 0.25, F.lit(2.0)).alias("score"))


@query("WITH tiers AS (SELECT name, CASE WHEN name < 'M' THEN 'S' ELSE 'A' END AS tier, row_number() OVER (ORDER BY CASE WHEN name < 'M' THEN 0 ELSE 1 END, name) AS ord FROM (SELECT DISTINCT substr(p_name, 1, 4) AS name FROM part WHERE p_size < 20)) SELECT p_partkey, tier FROM (SELECT p_partkey, t.tier, row_number() OVER (PARTITION BY p_partkey ORDER BY t.ord) AS k FROM part LEFT JOIN tiers t ON contains(p_name, t.name) OR contains(t.name, p_name)) WHERE k = 1")
def tier_match_bidirectional(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.where("p_size < 20").select(F.substring("p_name", 1, 4).alias("name")).distinct().withColumn("tier", F.when(F.col("name") < "M", "S").otherwise("A"))
    tiers = names.withColumn("ord", F.row_number().over(Window.orderBy(F.when(F.col("tier") == "S", 0).otherwise(1), "name")))
    return lookup.first_match(part.select("p_partkey", "p_name"), "p_name", tiers, "name", "ord", ["tier"], lookup.either_contains).select("p_partkey", "tier")


@query(f"{WO} SELECT id, text, CAST(weight AS INTEGER) AS min_kg, coalesce(weight <= 420, false) AS light FROM offers")
def weight_extract(spark, sf_dir):
    kg = F.array_min(X.weights(F.col("text")))
    return offers(spark, sf_dir).select("id", "text", kg.alias("min_kg"), F.coalesce(kg <= R.LIGHT_KG, F.lit(False)).alias("light"))


def _has(words) -> str:
    return " + ".join(f"CASE WHEN contains(text, '{k}') THEN {d}e0 ELSE 0e0 END" for k, d in words)


CONDITION_SQL = f"round(least(3e0, greatest(0e0, 2e0 + {_has(R.POSITIVE + R.NEGATIVE)} + CASE WHEN weight <= 420 THEN -0.3e0 ELSE 0e0 END)), 4)"
HITS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(text, '{k}') THEN '{'+' if d > 0 else '-'}{k}' END" for k, d in R.POSITIVE + R.NEGATIVE) + ", CASE WHEN weight <= 420 THEN 'light_weight:' || CAST(weight AS VARCHAR) END)"
_tier = lambda c, tiers, beyond: "CASE " + " ".join(f"WHEN {c} <= {a} THEN {b}" for a, b in tiers) + f" ELSE {beyond} END"
PRICE_SQL = _tier("price", [(a, f"{b}e0") for a, b in R.PRICE_SCORES], "-1e0")
PRICE_PTS_SQL = _tier("price", R.PRICE_POINTS, -2)


def weighed(spark, sf_dir):
    return offers(spark, sf_dir).withColumn("weights", X.weights(F.col("text"))).withColumn("weight", F.array_min("weights"))


@query(f"{WO} SELECT id, {CONDITION_SQL} AS score, {HITS_SQL} AS hits FROM offers")
def keyword_score(spark, sf_dir):
    o, t, w = weighed(spark, sf_dir), F.col("text"), F.col("weight")
    return o.select("id", R.condition_score(t, w).alias("score"), F.array_join(R.hits(t, w), ",").alias("hits"))


@query(f"{WO} SELECT id, price, {PRICE_SQL} AS score, {PRICE_PTS_SQL} AS pts FROM offers")
def price_tier(spark, sf_dir):
    return offers(spark, sf_dir).select("id", "price", R.tiered(F.col("price"), R.PRICE_SCORES, -1.0).alias("score"), R.tiered(F.col("price"), R.PRICE_POINTS, -2).alias("pts"))


SIRES = "(SELECT p_type AS sire, 4.0e0 - 0.4e0 * (row_number() OVER (ORDER BY p_type) - 1) AS sire_score FROM (SELECT DISTINCT p_type FROM part))"
TIER_SQL = "CASE WHEN sire_score >= 3.5 THEN 'top' WHEN sire_score >= 2.8 THEN 'mid' ELSE 'low' END"


def sires(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("sire")).distinct().withColumn("sire_score", 4.0 - 0.4 * (F.row_number().over(Window.orderBy("sire")) - 1))


@query(f"SELECT sire, sire_score, {TIER_SQL} AS tier FROM {SIRES}")
def sire_tier(spark, sf_dir):
    return sires(spark, sf_dir).withColumn("tier", R.sire_tier(F.col("sire_score")))


INDEXED = "SELECT {name}, max_by(packed, pos) AS v, min(pos) AS pos FROM (SELECT *, {{'s': score, 'g': grade, 'r': rank, 'u': {unique}}} AS packed, row_number() OVER (ORDER BY rank IS NULL, rank, composite_raw DESC, {ties}) AS pos FROM ({source})) GROUP BY {name}"
OVER_IDX = f"SELECT family, score, grade, club_unique FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY (rank IS NULL) DESC, rank DESC, composite_raw, family_code DESC) AS last FROM ({GO_})) WHERE last = 1"
OWN_IDX = f"SELECT family, max_by(grade, rank) AS own_grade, max(rank) AS own_rank FROM ({OWN}) GROUP BY family"
TRAINER_SQL = f"SELECT trainer, score, grade FROM ({GT})"
CROSS_IDX = f"SELECT trainer, family, max_by(grade, rank) AS grade, max(rank) AS rank, max_by(win_rate_sm, rank) AS win_rate_sm, max_by(n_horses, rank) AS n_horses, min(rank) AS pos FROM ({GX}) WHERE grade <> 'U' GROUP BY trainer, family"


def index_sql(source: str, name: str, ties: str, unique: str = "false") -> str:
    """An index by name: the values of the last row, and the place of the first."""
    return INDEXED.format(source=source, name=name, ties=ties, unique=unique)


def first_sql(asked: str, q: str, dim: str, name: str, rule: str, values: str, order: str = "pos") -> str:
    """The first match of each distinct name: the exact one, else the first for which the rule holds."""
    return f"SELECT q, {values}, name AS matched FROM (SELECT a.q, d.*, d.{name} AS name, row_number() OVER (PARTITION BY a.q ORDER BY CASE WHEN d.{name} = a.q THEN 0 ELSE 1 END, d.{order}) AS k FROM (SELECT DISTINCT {q} AS q FROM {asked} WHERE {q} <> '') a JOIN ({dim}) d ON d.{name} <> '' AND ({rule.format(q='a.q', n=f'd.{name}')})) WHERE k = 1"


PREFIX_RULE, PART_RULE = "starts_with({q}, {n}) OR starts_with({n}, {q})", "contains({q}, {n}) OR contains({n}, {q})"
#: Names as users type them: full-width spaces, cut or longer names, unknown and blank ones.
ASKED_SQL = """asked AS (SELECT *, trim(replace(CASE WHEN id % 12 = 3 THEN 'nobody' WHEN id % 4 = 1 THEN '　' || trainer || ' ' WHEN id % 4 = 2 THEN substr(trainer, 1, length(trainer) - 1) ELSE trainer END, '　', ' ')) AS trainer_q,
  trim(replace(CASE WHEN id % 10 = 9 THEN 'zz' WHEN id % 5 = 1 THEN family || ' x' WHEN id % 5 = 2 THEN split_part(family, ' ', 1) WHEN id % 5 = 3 THEN '　' ELSE family END, '　', ' ')) AS family_q,
  CASE WHEN id % 6 = 2 THEN 'unknown' WHEN id % 3 = 1 THEN sire || ' II' ELSE sire END AS sire_q, CASE id % 4 WHEN 0 THEN 's ' WHEN 1 THEN 'A' WHEN 2 THEN 'b' END AS label FROM offers)"""
RULES_SQL = f"rules_t AS (WITH {PREFIX_SQL} SELECT name, ord, pts, CASE pts WHEN 4 THEN 'S' WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS grade FROM dims)"
CROSS_RULE = "(starts_with(a.t, d.trainer) OR starts_with(d.trainer, a.t)) AND (contains(a.f, d.family) OR contains(d.family, a.f))"
#: The browser's rule: both names score 60 or more, so each asked name is a part of the listed one.
NEAR_RULE = "contains(lower(replace({n}, ' ', '')), lower(replace({q}, ' ', '')))"
FOUND_RULE = f"(a.t = d.trainer AND a.f = d.family) OR ({NEAR_RULE.format(q='a.t', n='d.trainer')} AND {NEAR_RULE.format(q='a.f', n='d.family')})"


def cross_sql(rule: str) -> str:
    return f"SELECT t, f, grade, rank, win_rate_sm, n_horses FROM (SELECT a.t, a.f, d.grade, d.rank, d.win_rate_sm, d.n_horses, row_number() OVER (PARTITION BY a.t, a.f ORDER BY CASE WHEN a.t = d.trainer AND a.f = d.family THEN 0 ELSE 1 END, d.pos) AS k FROM (SELECT DISTINCT trainer_q AS t, family_q AS f FROM asked WHERE trainer_q <> '' AND family_q <> '') a JOIN ({CROSS_IDX}) d ON {rule}) WHERE k = 1"


CROSS_FOUND = cross_sql(CROSS_RULE)
LABEL_OF = "CASE upper(trim(coalesce(label, ''))) WHEN 'S' THEN 6.0e0 WHEN 'A' THEN 4.5e0 WHEN 'B' THEN 3.0e0 WHEN 'C' THEN 1.5e0 ELSE 2.0e0 END"


def full_sql(of_trainer: str, of_family: str, of_sire: str, of_cross: str) -> str:
    return f"""{WO}, {ASKED_SQL}, {RULES_SQL}, cross_found AS ({cross_sql(of_cross)}), full_offers AS (SELECT o.*, f.v.s AS overall_score, f.v.g AS family_grade, f.v.r AS overall_rank, coalesce(f.v.u, false) AS club_unique, c.score AS club_score, c.grade AS club_grade, c.rank AS club_rank, CASE WHEN f.v.u THEN w.own_grade END AS unique_grade, CASE WHEN f.v.u THEN w.own_rank END AS own_rank,
  CASE WHEN t.v.g <> 'U' THEN t.v.g ELSE coalesce(y.grade, 'C') END AS trainer_grade, CASE WHEN t.v.g <> 'U' THEN t.v.g ELSE coalesce(y.grade, t.v.g, 'U') END AS shown_grade, t.q IS NOT NULL OR y.q IS NOT NULL AS trainer_known, coalesce(t.v.g <> 'U', false) AS trainer_from_ranks,
  CASE WHEN t.v.g <> 'U' THEN t.v.s ELSE coalesce(y.pts, 2.0e0) END AS trainer_pts, x.grade AS cross_grade, x.rank AS cross_rank, x.win_rate_sm AS cross_rate, x.n_horses AS cross_horses, coalesce(s.sire_score, 2.0e0) AS sire_score, s.q IS NOT NULL AS sire_known, CASE WHEN coalesce(s.sire_score, 2.0e0) >= 3.5 THEN 'top' WHEN coalesce(s.sire_score, 2.0e0) >= 2.8 THEN 'mid' ELSE 'low' END AS sire_tier, CASE o.id % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'B' END AS signature_grade
  FROM asked o LEFT JOIN ({first_sql('asked', 'family_q', index_sql(GO_, 'family', 'family_code', 'club_unique'), 'family', of_family, 'v')}) f ON o.family_q = f.q LEFT JOIN ({INDEX}) c ON f.matched = c.family LEFT JOIN ({OWN_IDX}) w ON f.matched = w.family
  LEFT JOIN ({first_sql('asked', 'trainer_q', index_sql(GT, 'trainer', 'trainer_code'), 'trainer', of_trainer, 'v')}) t ON o.trainer_q = t.q LEFT JOIN ({first_sql('asked', 'trainer_q', 'SELECT * FROM rules_t', 'name', of_trainer, 'pts, grade', 'ord')}) y ON o.trainer_q = y.q
  LEFT JOIN cross_found x ON o.trainer_q = x.t AND o.family_q = x.f LEFT JOIN ({first_sql('asked', 'sire_q', f'SELECT *, sire AS pos FROM {SIRES}', 'sire', of_sire, 'sire_score')}) s ON o.sire_q = s.q)"""


FULL_SQL = full_sql(PREFIX_RULE, PART_RULE, "contains({q}, {n})", CROSS_RULE)
BROWSER_SQL = full_sql(NEAR_RULE, NEAR_RULE, NEAR_RULE, FOUND_RULE)
_bonus = lambda g: f"CASE {g} WHEN 'S' THEN 1.5e0 WHEN 'A' THEN 1.0e0 WHEN 'B' THEN 0.5e0 ELSE 0.2e0 END"
FAMILY_SQL = f"CASE WHEN family_q = '' THEN {LABEL_OF} ELSE coalesce(round(CASE WHEN overall_score IS NOT NULL AND club_score IS NOT NULL THEN 0.55e0 * overall_score + 0.45e0 * club_score ELSE coalesce(overall_score, club_score) END + CASE WHEN overall_score IS NOT NULL AND club_unique THEN {_bonus('unique_grade')} ELSE 0e0 END, 2), 0e0) END"
SCORED_OFFERS = f"""SELECT *, floor(10000 / (greatest(price * 10000, 1) / 12)) AS b FROM (SELECT *, round(least(22e0, family_pts + trainer_pts + cross_pts + sire_score + condition_pts + price_pts), 2) AS total, status <> '満口' AND price <= 4.0 AS eligible FROM (
  SELECT *, {FAMILY_SQL} AS family_pts, CASE WHEN cross_grade IS NULL THEN 0e0 ELSE {_bonus('cross_grade')} END AS cross_pts, {CONDITION_SQL} AS condition_pts, {PRICE_SQL} AS price_pts FROM full_offers))"""


def asked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with the names that users typed, staged: the lookups and the scores read them apart."""
    o, c, k = weighed(spark, sf_dir), F.col, F.col("id")
    typed = F.when(k % 12 == 3, "nobody").when(k % 4 == 1, F.concat(F.lit("　"), c("trainer"), F.lit(" "))).when(k % 4 == 2, F.expr("substring(trainer, 1, length(trainer) - 1)")).otherwise(c("trainer"))
    family = F.when(k % 10 == 9, "zz").when(k % 5 == 1, F.concat(c("family"), F.lit(" x"))).when(k % 5 == 2, F.split_part("family", F.lit(" "), F.lit(1))).when(k % 5 == 3, "　").otherwise(c("family"))
    sire = F.when(k % 6 == 2, "unknown").when(k % 3 == 1, F.concat(c("sire"), F.lit(" II"))).otherwise(c("sire"))
    label = F.when(k % 4 == 0, "s ").when(k % 4 == 1, "A").when(k % 4 == 2, "b")
    return staged(o.withColumns({"trainer_q": X.norm_name(typed), "family_q": X.norm_name(family), "sire_q": X.norm_name(sire), "label": label}), "offers")


def cross_index(rows):
    """Graded crosses by their names: the values of the last row, and the rank of the first."""
    return of_kind(rows, "cross").where("grade <> 'U'").groupBy("trainer", "family").agg(F.max_by("grade", "rank").alias("grade"), F.max("rank").alias("rank"), F.min("rank").alias("first"), F.max_by("win_rate_sm", "rank").alias("win_rate_sm"), F.max_by("n_horses", "rank").alias("n_horses"))


def rule_trainers(spark, sf_dir):
    """Trainers of the rule table, for those whom the history doesn't grade."""
    letter = F.when(F.col("pts") == 4, "S").when(F.col("pts") == 3, "A").when(F.col("pts") == 2, "B").otherwise("C")
    return prefixes(spark, sf_dir).withColumn("grade", letter)


def families_of(rows: DataFrame) -> DataFrame:
    """Overall families by name with what the club's and the own table say of that name, from one aggregate: of each kind the last row counts."""
    c = F.col
    place = F.struct(c("rank").isNull(), F.coalesce("rank", F.lit(0)), (-c("composite_raw")), "family_code")
    last = lambda kind, *values: F.max_by(F.when(c("kind") == kind, F.struct(*values)), F.when(c("kind") == kind, place)).alias(kind)
    first = F.min(F.when(c("kind") == "overall", place)).alias("first_place")
    named = rows.where("kind IN ('overall', 'family', 'own')").where(~X.blank(c("family")))
    out = named.groupBy("family").agg(last("overall", "score", "grade", "rank", "club_unique"), last("family", "score", "grade", "rank").alias("club"), last("own", "grade", "rank"), first).where("overall IS NOT NULL")
    return out.select("family", "overall.*", *[c(f"club.{v}").alias(f"club_{v}") for v in ("score", "grade", "rank")], *[c(f"own.{v}").alias(f"own_{v}") for v in ("grade", "rank")], "first_place")


near_score = lookup.by_score


def full_offers(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, browser: bool = False) -> DataFrame:
    """Offers with the grades and scores that the lookups find for their family, trainer, cross and sire.

    Two passes over the horses: one for the offers, one for the rank build that all
    grades derive from (``rows`` where there is one already). All names but those of crosses are looked up together;
    near names are prefixes and parts, or, as the ``browser`` finds them, those that score 60 or more.
    """
    c = F.col
    o, rows = asked_offers(spark, sf_dir), ranks(spark, sf_dir, *KINDS) if rows is None else rows
    over = families_of(rows)
    trainers = name_index(of_kind(rows, "trainer"), "trainer", ["trainer_code"], ["score", "grade"])
    of_trainer, of_family, of_sire = (near_score,) * 3 if browser else (lookup.both_prefixes, lookup.either_contains, lookup.query_contains)
    norm = {"norm": X.norm_kana} if browser else {}
    listings = {
        "f": lookup.Listing(over, "family", "first_place", ["score", "grade", "rank", "club_unique", "club_score", "club_grade", "club_rank", "own_grade", "own_rank"], of_family, **norm),
        "t": lookup.Listing(trainers, "trainer", "first_place", ["score", "grade"], of_trainer, **norm),
        "y": lookup.Listing(rule_trainers(spark, sf_dir), "name", "ord", ["pts", "grade"], of_trainer, **norm),
        "s": lookup.Listing(sires(spark, sf_dir), "sire", "sire", ["sire_score"], of_sire, **norm),
    }
    asked = {"f": "family_q", "t": "trainer_q", "y": "trainer_q", "s": "sire_q"}
    queries = o.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c(q).alias("__q")) for k, q in asked.items()])))
    found = lookup.found_of_kinds(queries, listings)
    rows_of = o
    for k, q in asked.items():
        rows_of = rows_of.join(found[k].select(c("__q").alias(q), k), q, "left")
    names = o.select(c("trainer_q").alias("trainer"), c("family_q").alias("family")).distinct()
    crosses = lookup.found_crosses(names, cross_index(rows), "first", ["grade", "rank", "win_rate_sm", "n_horses"], of_trainer, of_family, *norm.values())
    crosses = crosses.select(c("trainer").alias("trainer_q"), c("family").alias("family_q"), c("__c").alias("cross_record"))
    rows = rows_of.join(crosses, ["trainer_q", "family_q"], "left").withColumns({"overall_score": c("f.score"), "family_grade": c("f.grade"), "overall_rank": c("f.rank"), **{v: c(f"f.{v}") for v in ("club_unique", "club_score", "club_grade", "club_rank", "own_grade", "own_rank")}, "cross_grade": c("cross_record.grade")})
    sure = F.coalesce(c("t.grade") != "U", F.lit(False))
    rows = rows.withColumns(
        {
            "club_unique": F.coalesce("club_unique", F.lit(False)),
            "unique_grade": F.when(c("club_unique"), c("own_grade")),
            "own_rank": F.when(c("club_unique"), c("own_rank")),
            "trainer_from_ranks": sure,
            "trainer_grade": F.when(sure, c("t.grade")).otherwise(F.coalesce("y.grade", F.lit("C"))),
            "shown_grade": F.when(sure, c("t.grade")).otherwise(F.coalesce("y.grade", "t.grade", F.lit("U"))),
            "trainer_known": c("t").isNotNull() | c("y").isNotNull(),
            "trainer_pts": F.when(sure, c("t.score")).otherwise(F.coalesce("y.pts", F.lit(2.0))),
            "sire_known": c("s").isNotNull(),
            "sire_score": F.coalesce("s.sire_score", F.lit(2.0)),
            "signature_grade": F.when(c("id") % 5 == 0, "S").when(c("id") % 5 == 1, "B"),
        }
    )
    looked_up = scoring.family_points(c("overall_score"), c("club_score"), c("club_unique"), c("unique_grade"))
    family_pts = F.when(c("family_q") == "", R.label_score(c("label"))).otherwise(looked_up)
    return rows.withColumns({"sire_tier": R.sire_tier(c("sire_score")), "family_pts": family_pts}).drop("f", "t", "y", "s")


@query(f"{WO}, {ASKED_SQL}, cross_found AS ({CROSS_FOUND}) SELECT id, x.grade, x.rank FROM asked LEFT JOIN cross_found x ON trainer_q = x.t AND family_q = x.f")
def cross_lookup(spark, sf_dir):
    asked = asked_offers(spark, sf_dir).select("id", F.col("trainer_q").alias("trainer"), F.col("family_q").alias("family"))
    return lookup.first_cross(asked, cross_index(ranks(spark, sf_dir, "cross")), "first", ["grade", "rank"]).select("id", "grade", "rank")


@query(f"{WO}, {ASKED_SQL}, cross_found AS ({cross_sql(FOUND_RULE)}) SELECT id, x.grade FROM asked LEFT JOIN cross_found x ON trainer_q = x.t AND family_q = x.f")
def find_cross(spark, sf_dir):
    """The exact cross, else the first of which both names score 60 or more."""
    asked = asked_offers(spark, sf_dir).select("id", F.col("trainer_q").alias("trainer"), F.col("family_q").alias("family"))
    return lookup.first_cross(asked, cross_index(ranks(spark, sf_dir, "cross")), "first", ["grade"], near_score, near_score, X.norm_kana).select("id", "grade")


@query(f"{FULL_SQL} SELECT id, family_q, family_grade, club_unique, unique_grade, {FAMILY_SQL} AS family_pts FROM full_offers")
def family_points(spark, sf_dir):
    return full_offers(spark, sf_dir).select("id", "family_q", "family_grade", "club_unique", "unique_grade", "family_pts")


PARTS = "family_pts, trainer_pts, cross_pts, sire_score, condition_pts, price_pts, total, eligible"


UNITS_SQL = "CASE WHEN total >= 16 THEN least(4, greatest(2, greatest(1, b))) WHEN total >= 13 THEN least(2, greatest(1, b)) ELSE 1 END"
UNITS_TEXT_SQL = f"CASE WHEN {UNITS_SQL} > 1 THEN '1〜' || CAST(CAST({UNITS_SQL} AS INTEGER) AS VARCHAR) || '口' ELSE '1口（様子見）' END"
FLAGS_SQL = "concat_ws(',', CASE WHEN status = '満口' THEN 'status:満口' END, CASE WHEN price > 4.0 THEN 'price_over:' || CAST(price AS VARCHAR) END)"


@query(f"{FULL_SQL} SELECT id, name, {PARTS}, CAST({UNITS_SQL} AS INTEGER) AS units, {UNITS_TEXT_SQL} AS recommend_units, {FLAGS_SQL} AS skip_flags FROM ({SCORED_OFFERS})")
def score_candidates(spark, sf_dir):
    rows = scoring.scored(full_offers(spark, sf_dir))
    return rows.select("id", "name", *PARTS.split(", "), "units", R.units_text(F.col("units")).alias("recommend_units"), F.array_join("skip_flags", ",").alias("skip_flags"))


RECORD = ["b_family", "b_trainer", "b_trainer_grade", "b_trainer_source", "b_cross", "b_sire", "b_condition", "b_price", "f_source", "f_label", "f_unique", "f_unique_grade", "f_unique_rank", "f_overall_grade", "f_overall_rank", "f_club_grade", "f_club_rank"]
_named = "CASE WHEN family_q <> '' THEN {} END"
RECORD_SQL = f"""SELECT id, total, round(family_pts, 2) AS b_family, round(trainer_pts, 2) AS b_trainer, trainer_grade AS b_trainer_grade, CASE WHEN trainer_from_ranks THEN 'db' ELSE 'yaml' END AS b_trainer_source, round(cross_pts, 2) AS b_cross, round(sire_score, 2) AS b_sire, round(condition_pts, 2) AS b_condition, round(price_pts, 2) AS b_price,
  CASE WHEN family_q = '' THEN 'label' WHEN family_grade IS NOT NULL OR club_grade IS NOT NULL THEN 'db' ELSE 'none' END AS f_source, CASE WHEN family_q = '' THEN label END AS f_label, club_unique AND family_q <> '' AS f_unique, {_named.format('unique_grade')} AS f_unique_grade, {_named.format('own_rank')} AS f_unique_rank,
  family_grade AS f_overall_grade, overall_rank AS f_overall_rank, club_grade AS f_club_grade, club_rank AS f_club_rank, cross_grade, cross_rank, cross_rate, cross_horses, {HITS_SQL} AS hits, coalesce(CAST(weight AS VARCHAR), '') AS weights_kg, {UNITS_TEXT_SQL} AS recommend_units FROM ({SCORED_OFFERS})"""


@query(f"{FULL_SQL} {RECORD_SQL}")
def score_records(spark, sf_dir):
    """All that a score is made of: the breakdown and the records of family, cross and condition, as columns."""
    rows = scoring.recorded(scoring.scored(full_offers(spark, sf_dir)))
    parts = [F.col(("breakdown." if c[0] == "b" else "family_record.") + c[2:]).alias(c) for c in RECORD]
    cross = [F.col(f"cross_record.{v}").alias(n) for v, n in (("grade", "cross_grade"), ("rank", "cross_rank"), ("win_rate_sm", "cross_rate"), ("n_horses", "cross_horses"))]
    told = [F.array_join(f"condition_record.{v}", ",").alias(v) for v in ("hits", "weights_kg")]
    return rows.select("id", "total", *parts, *cross, *told, "recommend_units")


@query(f"{FULL_SQL} SELECT pool, name, CAST(k AS INTEGER) AS rank, CASE k WHEN 1 THEN '本命' WHEN 2 THEN '控え' ELSE CAST(k AS VARCHAR) || '位' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY CAST(round(total * 100) AS BIGINT) DESC, name) AS k FROM ({SCORED_OFFERS}) WHERE eligible)")
def rank_eligible(spark, sf_dir):
    """Ranks of the offers without any flag."""
    return scoring.ranked(scoring.scored(full_offers(spark, sf_dir)), only_eligible=True).select("pool", "name", "rank", "label")


@query(f"{FULL_SQL} SELECT pool, name, total, eligible, CAST(k AS INTEGER) AS rank, CASE WHEN NOT eligible THEN '見送り' WHEN k = 1 THEN '本命' WHEN k = 2 THEN '控え' ELSE CAST(k AS VARCHAR) || '位' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY CAST(round(total * 100) AS BIGINT) DESC, name, eligible DESC) AS k FROM ({SCORED_OFFERS}))")
def rank_candidates(spark, sf_dir):
    return scoring.ranked(scoring.scored(full_offers(spark, sf_dir)).select("pool", "name", "total", "eligible")).select("pool", "name", "total", "eligible", "rank", "label")


HARD_SQL = "CASE WHEN status = '満口' THEN '満口' WHEN price > 4.0 THEN '一口4万円超は原則見送り' WHEN " + " OR ".join(f"contains(text, '{k}')" for k in R.HARD) + " THEN '近況に重大リスク語' END"


@query(f"{WO} SELECT id, {HARD_SQL} AS reason FROM offers")
def hard_pass(spark, sf_dir):
    return offers(spark, sf_dir).select("id", R.hard_pass(F.col("status"), F.col("price"), F.col("text")).alias("reason"))


def _points(table: dict, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{g}' THEN {p}" for g, p in table.items()) + f" ELSE {table.get('none', 0)} END"


GRADE_COLS = [("family", "family_grade"), ("unique", "unique_grade"), ("signature", "signature_grade"), ("trainer", "trainer_grade"), ("cross", "cross_grade"), ("sire", "sire_tier")]
_sa = lambda c: f"coalesce({c} IN ('S', 'A'), false)"


def _decide_sql(weak: str, legacy: bool = False, more: str = "") -> str:
    table = R.LEGACY_POINTS if legacy else R.POINTS
    c1, c2, c5 = f"{_sa('unique_grade')} AND {_sa('trainer_grade')}", _sa("cross_grade"), f"price >= 2.5 AND NOT {_sa('cross_grade')} AND NOT {_sa('unique_grade')}"
    c3 = f"{_sa('family_grade')} AND sire_tier = 'top' AND price <= 2.0"
    c4 = _sa("signature_grade") + ("" if legacy else f" AND coalesce(family_grade, 'none') IN ({weak})")
    combos = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN 'C{i}' END" for i, c in enumerate((c1, c2, c3, c4, c5), 1)) + ")"
    if legacy:
        price = "CASE WHEN price > 4.0 THEN 0 WHEN price <= 2.0 THEN 2 WHEN price < 2.5 THEN 1 WHEN price <= 3.5 THEN 0 ELSE -1 END"
        condition = "- CASE WHEN weight <= 420 THEN 1 ELSE 0 END + " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in ((c1, 2), (c2, 2), (c3, 2), (c4, 1), (c5, -2)))
        hard = "CASE WHEN status = '満口' THEN '満口・募集終了' WHEN price > 4.0 THEN '一口4万超は即PASS' END"
    else:
        price, hard = PRICE_PTS_SQL, HARD_SQL
        plus, minus = (" OR ".join(f"contains(text, '{k}')" for k in ks) for ks in ([k for k, _ in R.POSITIVE], R.MILD + [k for k, _ in R.NEGATIVE]))
        condition = f"+ CASE WHEN trim(text) = '' THEN 0 ELSE CASE WHEN {plus} THEN 1 ELSE 0 END - CASE WHEN {minus} THEN 1 ELSE 0 END - CASE WHEN weight <= 420 THEN 1 ELSE 0 END END"
    total = " + ".join(_points(table[k], c) for k, c in GRADE_COLS)
    return f"{FULL_SQL} SELECT id{more}, points, combos, hard, CASE WHEN hard IS NOT NULL THEN 'PASS' WHEN points >= 12 THEN 'GO' WHEN points >= 8 THEN 'HOLD' ELSE 'PASS' END AS verdict FROM (SELECT id{more}, CAST({total} + {price} {condition} AS INTEGER) AS points, {combos} AS combos, {hard} AS hard FROM full_offers)"


def _decide(spark, sf_dir, variant):
    return scoring.decided(full_offers(spark, sf_dir), variant).select("id", "points", F.array_join("combos", ",").alias("combos"), "hard", "verdict")


@query(_decide_sql("'B', 'C', 'none'"))
def decide_canonical(spark, sf_dir):
    return _decide(spark, sf_dir, "canonical")


@query(_decide_sql("'B', 'C', 'none', 'U'"))
def decide_tool(spark, sf_dir):
    return _decide(spark, sf_dir, "tool")


@query(_decide_sql("", True))
def decide_legacy(spark, sf_dir):
    return _decide(spark, sf_dir, "legacy")


@query(f"{WO} SELECT id, low, high, CASE WHEN weight > high THEN '上限注意' WHEN weight < low THEN '下限注意' WHEN weight <= 420 OR weight >= 520 THEN '警戒線付近' ELSE 'OK帯' END AS band FROM (SELECT id, weight, CAST(greatest(405 + trainer_code % 4 * 10, 410 + length(sire) % 3 * 5) AS INTEGER) AS low, CAST(least(470 + trainer_code % 3 * 10, 475 + length(sire) % 2 * 5) AS INTEGER) AS high FROM offers) WHERE weight IS NOT NULL")
def weight_band(spark, sf_dir):
    code, size = F.col("trainer_code"), F.length("sire")
    low = F.greatest(405 + code % 4 * 10, 410 + size % 3 * 5).cast("int")
    high = F.least(470 + code % 3 * 10, 475 + size % 2 * 5).cast("int")
    return weighed(spark, sf_dir).where("weight IS NOT NULL").select("id", low.alias("low"), high.alias("high"), scoring.weight_band(F.col("weight"), low, high).alias("band"))


@query(f"{W}, {PREFIX_SQL}, both_sides AS (SELECT coalesce(d.trainer, y.name) AS trainer, d.grade, d.score, y.pts FROM ({GT}) d FULL JOIN dims y ON d.trainer = y.name) SELECT trainer, CASE WHEN grade <> 'U' THEN grade WHEN pts IS NOT NULL THEN 'Y' ELSE grade END AS effective_grade, CASE WHEN grade <> 'U' THEN 'db' WHEN pts IS NOT NULL THEN 'yaml' ELSE 'db' END AS effective_source, CASE WHEN grade <> 'U' THEN score WHEN pts IS NOT NULL THEN pts ELSE score END AS effective_score FROM both_sides")
def effective_trainer(spark, sf_dir):
    db = ranks(spark, sf_dir, "trainer").select("trainer", "grade", "score")
    both = db.join(prefixes(spark, sf_dir).select(F.col("name").alias("trainer"), "pts"), "trainer", "full_outer")
    sure, listed = F.coalesce(F.col("grade") != "U", F.lit(False)), F.col("pts").isNotNull()
    pick = lambda a, b: F.when(sure, a).when(listed, b).otherwise(a)
    return both.select("trainer", pick(F.col("grade"), F.lit("Y")).alias("effective_grade"), pick(F.lit("db"), F.lit("yaml")).alias("effective_source"), pick(F.col("score"), F.col("pts")).alias("effective_score"))


@query(f"{W} SELECT f.family, f.grade AS overall_grade, f.score AS overall_score, c.grade AS club_grade, c.score AS club_score FROM ({OVER_IDX}) f LEFT JOIN ({INDEX}) c ON f.family = c.family")
def family_report(spark, sf_dir):
    rows = ranks(spark, sf_dir, "overall", "family")
    over, club = family_index(rows, "overall", "grade", "score"), family_index(rows, "family", "grade", "score")
    return over.select("family", F.col("grade").alias("overall_grade"), F.col("score").alias("overall_score")).join(club.select("family", F.col("grade").alias("club_grade"), F.col("score").alias("club_score")), "family", "left")


@query(f"{W} SELECT 'C1' AS combo, 'trainer' AS kind, trainer AS name FROM ({GT}) WHERE grade IN ('S', 'A') UNION ALL SELECT 'C2', 'cross', trainer || '|' || family FROM ({GX}) WHERE grade IN ('S', 'A') UNION ALL SELECT 'C3', 'family', family FROM ({OVER_IDX}) WHERE grade IN ('S', 'A') UNION ALL SELECT 'C3', 'sire', sire FROM {SIRES} WHERE sire_score >= 3.5")
def combo_lists(spark, sf_dir):
    of = lambda df, combo, kind, name: df.select(F.lit(combo).alias("combo"), F.lit(kind).alias("kind"), name.alias("name"))
    good = F.col("grade").isin("S", "A")
    rows = ranks(spark, sf_dir, "trainer", "cross", "overall")
    trainers, crosses = of_kind(rows, "trainer").where(good), of_kind(rows, "cross").where(good)
    over = family_index(rows, "overall", "grade").where(good)
    top = sires(spark, sf_dir).where(R.sire_tier(F.col("sire_score")) == "top")
    return of(trainers, "C1", "trainer", F.col("trainer")).unionByName(of(crosses, "C2", "cross", F.concat_ws("|", "trainer", "family"))).unionByName(of(over, "C3", "family", F.col("family"))).unionByName(of(top, "C3", "sire", F.col("sire")))


NOTES_SQL = "concat_ws(',', CASE WHEN NOT trainer_known AND trainer_q <> '' THEN 'trainer' END, CASE WHEN NOT sire_known THEN 'sire' END, CASE WHEN family_q <> '' AND family_grade IS NULL AND family_q <> 'zz' THEN 'family' END, CASE WHEN family_grade IS NULL AND family_q = 'zz' THEN 'alias' END, CASE WHEN family_q <> '' AND trainer_q <> '' AND cross_grade IS NULL THEN 'cross' END)"


@query(f"{FULL_SQL} SELECT id, {NOTES_SQL} AS notes FROM full_offers")
def followup_notes(spark, sf_dir):
    return noted(full_offers(spark, sf_dir)).select("id", "notes")


def noted(rows):
    """Offers with what to follow up: names that no table has, and a family known by an alias only."""
    c = F.col
    rows = rows.join(aliases(rows.sparkSession), c("family_q") == c("alias"), "left")
    asked, unknown = c("family_q") != "", c("family_grade").isNull()
    notes = [
        F.when(~c("trainer_known") & (c("trainer_q") != ""), "trainer"), F.when(~c("sire_known"), "sire"), F.when(asked & unknown & c("alias").isNull(), "family"),
        F.when(unknown & c("alias").isNotNull(), "alias"), F.when(asked & (c("trainer_q") != "") & c("cross_grade").isNull(), "cross"),
    ]
    return rows.withColumn("notes", F.concat_ws(",", *notes)).drop("alias", "manual", "suggests")


def aliases(spark):
    """Family names in use that the ranks don't have, with a grade given by hand and the line that they suggest."""
    return F.broadcast(spark.createDataFrame([("zz", "A", "old bolt")], "alias string, manual string, suggests string"))


def entries(spark, sf_dir):
    """Events as ledger entries: purchases are income."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "purchase", "income").otherwise("expense").alias("type"), X.half_up(F.col("value")).alias("amount"), F.col("event_id").alias("created_at"), "value", "user_id")


ENTRIES_SQL = "entries AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, event_type AS name, CASE WHEN event_type = 'purchase' THEN 'income' ELSE 'expense' END AS type, CAST(floor(value + 0.5) AS BIGINT) AS amount, event_id AS created_at, value, user_id FROM events)"
OPENING = 100_000


@query(f"WITH {ENTRIES_SQL} SELECT *, {OPENING} + income - expense AS balance FROM (SELECT CAST(coalesce(sum(CASE WHEN type = 'income' THEN amount END), 0) AS BIGINT) AS income, CAST(coalesce(sum(CASE WHEN type <> 'income' THEN amount END), 0) AS BIGINT) AS expense, CAST(count(*) AS BIGINT) AS n FROM entries)")
def ledger_totals(spark, sf_dir):
    return ledger.totals(entries(spark, sf_dir), OPENING)


@query(f"WITH {ENTRIES_SQL} SELECT id, CAST(date AS VARCHAR) AS date, type, amount FROM entries WHERE type = 'income' ORDER BY date DESC, created_at DESC")
def ledger_list(spark, sf_dir):
    return ledger.listed(entries(spark, sf_dir), "income").select("id", F.col("date").cast("string").alias("date"), "type", "amount")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'name' WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 1000 = 0 THEN 'amount' END AS reason, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN event_id % 1000 WHEN event_id % 11 <> 0 THEN -5 END AS amount FROM events""")
def ledger_validate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 11 == 0, "x12").when(F.col("event_id") % 13 == 0, "-5").otherwise(F.concat(F.lit("￥"), F.translate((F.col("event_id") % 1000).cast("string"), X.DIGITS, X.FULL_DIGITS), F.lit(" ")))
    raw = e.select("event_id", F.to_date("ts").alias("date"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"), text.alias("amount_text"))
    return ledger.validated(raw).select("event_id", "reason", "amount")


@query(f"WITH {ENTRIES_SQL} SELECT id, amount FROM entries WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def ledger_delete(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return ledger.without(rows, rows.where("name = 'error'").select("id")).select("id", "amount")


@query(f"WITH {ENTRIES_SQL} SELECT user_id, id, CAST({OPENING} + sum(CASE WHEN type = 'income' THEN amount ELSE -amount END) OVER (PARTITION BY user_id ORDER BY date, id) AS BIGINT) AS balance FROM entries")
def ledger_running_balance(spark, sf_dir):
    """An extension: the balance after each entry of an account, by sums of ranges of its dates, so that one account fills many tasks."""
    change = F.when(F.col("type") == "income", F.col("amount")).otherwise(-F.col("amount"))
    rows = entries(spark, sf_dir).select("user_id", "id", "date", change.alias("change"))
    return running_sum(rows, ["user_id"], [F.col("date"), F.col("id")], "change", "sum").select("user_id", "id", (OPENING + F.col("sum")).cast("long").alias("balance"))


@query("SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NULL THEN c_name ELSE n END AS name, CASE WHEN k IS NOT NULL AND k % 2 = 0 THEN '' ELSE c_mktsegment END AS latest FROM customer FULL JOIN (SELECT c_custkey * 3 AS k, 'new' || CAST(c_custkey AS VARCHAR) AS n FROM customer) ON c_custkey = k")
def candidate_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    store = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("latest"))
    new = c.select((F.col("c_custkey") * 3).alias("id"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("name"), F.lit("").alias("latest"), F.lit(True).alias("has_name"))
    return ledger.upserted(store, new.withColumn("has_latest", F.col("id") % 2 == 0), "id", ["name", "latest"])


@query("SELECT c_custkey AS id, coalesce(n, 0) AS n_reports, latest FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, max_by(o_orderpriority, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS latest FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def condition_append(spark, sf_dir):
    """Reports are a log of their own; what a record shows is an aggregate of it."""
    store = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("latest"))
    return ledger.latest(store, reports(spark, sf_dir), "id").select("id", "n_reports", "latest")


def reports(spark, sf_dir):
    """Orders as condition reports on their customer."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("at"), F.col("o_orderpriority").alias("text"), F.lit("").alias("note"))


@query("SELECT c_custkey AS id, coalesce(history, '') AS history FROM customer LEFT JOIN (SELECT o_custkey, string_agg(lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || ' ' || o_orderpriority, ',' ORDER BY o_orderkey) AS history FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def condition_history(spark, sf_dir):
    """The nested form, on demand: each record with its reports in order."""
    store = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("latest"), F.lit(None).cast("array<struct<at:string,text:string,note:string>>").alias("history"))
    told = F.transform("history", lambda h: F.concat_ws(" ", h["at"], h["text"]))
    return ledger.appended(store, reports(spark, sf_dir), "id").select("id", F.array_join(told, ",").alias("history"))


@query("SELECT DISTINCT coalesce(nullif(o_orderpriority, ''), 'default') AS pool FROM orders ORDER BY pool")
def pools_distinct(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("")), F.lit("default")).alias("pool")).distinct().orderBy("pool")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def row_filter(spark, sf_dir):
    return read(spark, sf_dir, "part").where(ledger.any_contains("Brand#1", [F.col("p_name"), F.col("p_brand"), F.col("p_type")])).select("p_partkey", "p_name")


@query(f"WITH {ENTRIES_SQL} SELECT id, CASE WHEN amount < 0 THEN '-' ELSE '' END || '¥' || format('{{:,}}', abs(amount)) AS yen, CASE WHEN type = 'income' THEN '+' ELSE '−' END || CASE WHEN amount < 0 THEN '-' ELSE '' END || '¥' || format('{{:,}}', abs(amount)) AS signed, '&lt;' || name || '&amp;&quot;&gt;' AS escaped FROM entries")
def format_yen(spark, sf_dir):
    raw = F.concat(F.lit("<"), F.col("name"), F.lit('&">'))
    return entries(spark, sf_dir).select("id", X.yen(F.col("amount")).alias("yen"), X.signed_yen(F.col("amount"), F.col("type")).alias("signed"), X.html_escaped(raw).alias("escaped"))
