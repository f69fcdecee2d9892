"""Queries of reports, finders and checks over the graded tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.functions import text as X
from tallyworks.operators import ledger, lookup, scoring
from tallyworks.operators.grade import KINDS
from tallyworks.plans import registry as Q
from tallyworks.plans.horses import CLUB, horses, offers, read
from tallyworks.plans.registry import query

GRADE_ORDER = "CASE grade WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'U' THEN 4 ELSE 9 END"


def trainers(spark: SparkSession, sf_dir: str):
    return Q.ranks(spark, sf_dir, "trainer")


def families(spark: SparkSession, sf_dir: str):
    return Q.family_index(Q.ranks(spark, sf_dir, "overall"), "overall", "score", "grade")


@query(f"{Q.W} SELECT trainer, trainer_code, grade, score, CAST({Q._points(R.POINTS['trainer'], 'grade')} AS INTEGER) AS pts FROM ({Q.GT}) ORDER BY {GRADE_ORDER}, score DESC, trainer")
def trainer_report(spark, sf_dir):
    rows = trainers(spark, sf_dir).select(*Q.T, "grade", "score", R.points(R.POINTS["trainer"], F.col("grade")).alias("pts"))
    return rows.orderBy(R.grade_order(F.col("grade")), F.desc("score"), "trainer")


@query(f"SELECT sire, sire_score AS score, tier, CAST({Q._points(R.POINTS['sire'], 'tier')} AS INTEGER) AS pts FROM (SELECT *, {Q.TIER_SQL} AS tier FROM {Q.SIRES}) ORDER BY score DESC, sire")
def sire_report(spark, sf_dir):
    rows = Q.sires(spark, sf_dir).withColumn("tier", R.sire_tier(F.col("sire_score")))
    return rows.select("sire", F.col("sire_score").alias("score"), "tier", R.points(R.POINTS["sire"], F.col("tier")).alias("pts")).orderBy(F.desc("score"), "sire")


@query(f"{Q.W} SELECT trainer || '|' || family AS cross_key, grade, score, n_horses, CAST({Q._points(R.POINTS['cross'], 'grade')} AS INTEGER) AS pts FROM ({Q.GX}) WHERE grade <> 'U' ORDER BY {GRADE_ORDER}, score DESC, cross_key")
def cross_report(spark, sf_dir):
    rows = Q.ranks(spark, sf_dir, "cross").where("grade <> 'U'").select(F.concat_ws("|", "trainer", "family").alias("cross_key"), "grade", "score", "n_horses", R.points(R.POINTS["cross"], F.col("grade")).alias("pts"))
    return rows.orderBy(R.grade_order(F.col("grade")), F.desc("score"), "cross_key")


@query(f"{Q.W} SELECT kind, grade, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'trainer' AS kind, grade FROM ({Q.GT}) UNION ALL SELECT 'family', grade FROM ({Q.GF}) UNION ALL SELECT 'overall', grade FROM ({Q.GO_}) UNION ALL SELECT 'cross', grade FROM ({Q.GX})) GROUP BY kind, grade")
def rank_build_counts(spark, sf_dir):
    """The whole rank build, counted by kind and grade."""
    return Q.ranks(spark, sf_dir, "trainer", "family", "overall", "cross").groupBy("kind", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(f"{Q.W} SELECT '{{\"family\":\"' || family || '\",\"grade\":\"' || grade || '\",\"rank\":' || CAST(rank AS VARCHAR) || '}}' AS entry FROM ({Q.INDEX}) WHERE grade <> 'U'")
def slim_index(spark, sf_dir):
    """The graded part of an index as JSON with the fields that readers need."""
    rows = Q.family_index(Q.ranks(spark, sf_dir, "family"), "family", "grade", "rank")
    return rows.where("grade <> 'U'").select(F.to_json(F.struct("family", "grade", "rank")).alias("entry"))


LABELS = ["s ", "A", "b", None, "unknown", "zz"]
LABEL_SQL = "CASE p_partkey % 6 WHEN 0 THEN 's ' WHEN 1 THEN 'A' WHEN 2 THEN 'b' WHEN 4 THEN 'unknown' WHEN 5 THEN 'zz' END"


@query(f"SELECT p_partkey, CASE upper(trim(coalesce(label, ''))) WHEN 'S' THEN 6.0e0 WHEN 'A' THEN 4.5e0 WHEN 'B' THEN 3.0e0 WHEN 'C' THEN 1.5e0 ELSE 2.0e0 END AS score FROM (SELECT p_partkey, {LABEL_SQL} AS label FROM part)")
def label_score(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 6).cast("int") + 1)
    return read(spark, sf_dir, "part").select("p_partkey", R.label_score(label).alias("score"))


LINES_SQL = "(SELECT p_name AS line, min(CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'A' ELSE 'B' END) AS grade FROM part WHERE p_size < 10 GROUP BY p_name)"


@query(f"SELECT p_partkey, coalesce(l.grade, 'none') AS grade, CAST(CASE l.grade WHEN 'S' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INTEGER) AS pts FROM part LEFT JOIN {LINES_SQL} l ON trim(p_name) = l.line")
def signature_lookup(spark, sf_dir):
    """Exact names only."""
    part = read(spark, sf_dir, "part")
    grade = F.when(F.col("p_partkey") % 3 == 0, "S").when(F.col("p_partkey") % 3 == 1, "A").otherwise("B")
    lines = part.where("p_size < 10").groupBy(F.col("p_name").alias("line")).agg(F.min(grade).alias("grade"))
    found = part.withColumn("line", X.norm_name(F.col("p_name"))).join(lines, "line", "left")
    return found.select("p_partkey", F.coalesce("grade", F.lit("none")).alias("grade"), R.points(R.POINTS["signature"], F.col("grade")).alias("pts"))


@query(f"""{Q.W}, dims AS (SELECT family AS ord, family, grade FROM ({Q.OVER_IDX})), asked AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS q FROM part)
  SELECT p_partkey, m.family AS matched, m.grade AS overall_grade, c.grade AS club_grade FROM (SELECT p_partkey, d.family, d.grade, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN d.family = q THEN 0 ELSE 1 END, d.ord) AS k FROM asked LEFT JOIN dims d ON contains(q, d.family) OR contains(d.family, q)) m LEFT JOIN ({Q.INDEX}) c ON m.family = c.family WHERE m.k = 1""")
def family_rekey(spark, sf_dir):
    """A part of a name finds the overall family; the club's entry is looked up by the name found."""
    rows = Q.ranks(spark, sf_dir, "overall", "family")
    dims = Q.family_index(rows, "overall", "grade").withColumn("ord", F.col("family"))
    asked = read(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("q"))
    found = lookup.first_match(asked, "q", dims, "family", "ord", ["grade"], lookup.either_contains)
    club = Q.family_index(rows, "family", "grade")
    found = found.select("p_partkey", "matched", F.col("grade").alias("overall_grade"))
    return found.join(club.select(F.col("family").alias("matched"), F.col("grade").alias("club_grade")), "matched", "left").select("p_partkey", "matched", "overall_grade", "club_grade")


ALIAS_SQL = Q.ALIAS_SQL


@query(f"{Q.W} SELECT p_partkey, CASE WHEN f.family IS NOT NULL THEN 'hit' WHEN a.alias IS NOT NULL THEN 'alias' ELSE 'missing' END AS found, coalesce(f.grade, a.manual) AS grade FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' line' END AS q FROM part) LEFT JOIN ({Q.OVER_IDX}) f ON q = f.family LEFT JOIN {ALIAS_SQL} a ON q = a.alias")
def family_alias(spark, sf_dir):
    """A family, else an alias with its own grade, else missing."""
    part = read(spark, sf_dir, "part")
    aliases = part.where("p_size < 8").select(F.concat("p_name", F.lit(" line")).alias("q")).distinct().withColumn("manual", F.lit("S"))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" line"))).alias("q"))
    rows = asked.join(families(spark, sf_dir).select(F.col("family").alias("q"), "grade"), "q", "left").join(aliases, "q", "left")
    found = F.when(F.col("grade").isNotNull(), "hit").when(F.col("manual").isNotNull(), "alias").otherwise("missing")
    return rows.select("p_partkey", found.alias("found"), F.coalesce("grade", "manual").alias("grade"))


@query("SELECT s_suppkey, best AS found FROM (SELECT s_suppkey, d.s_name AS best, row_number() OVER (PARTITION BY s_suppkey ORDER BY d.s_name) AS k FROM (SELECT s_suppkey, lower(replace(substr(s_name, 1, length(s_name) - CAST(s_suppkey % 2 AS BIGINT)), ' ', '')) AS q, substr(s_name, 1, length(s_name) - CAST(s_suppkey % 2 AS BIGINT)) AS raw FROM supplier) LEFT JOIN (SELECT DISTINCT s_name FROM supplier WHERE s_suppkey % 2 = 0) d ON d.s_name = raw OR contains(lower(replace(d.s_name, ' ', '')), q)) WHERE k = 1")
def find_by_score(spark, sf_dir):
    """Exact names, else the first that scores 60 or more."""
    s = read(spark, sf_dir, "supplier")
    dims = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name")).distinct().withColumn("ord", F.col("name"))
    asked = s.select("s_suppkey", F.expr("substring(s_name, 1, length(s_name) - cast(s_suppkey % 2 as int))").alias("q"))
    return lookup.first_match(asked, "q", dims, "name", "ord", [], near_score, norm=X.norm_kana).select("s_suppkey", F.col("matched").alias("found"))


@query(f"{Q.WO} SELECT id, CAST(CASE WHEN price <= 2.0 THEN 2 WHEN price < 2.5 THEN 1 WHEN price <= 3.5 THEN 0 WHEN price > 4.0 THEN NULL ELSE -1 END AS INTEGER) AS pts, CAST(CASE verdict WHEN 'GO' THEN CASE WHEN price <= 2.0 THEN 2 ELSE 1 END WHEN 'HOLD' THEN 1 ELSE 0 END AS INTEGER) AS units FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'GO' WHEN 1 THEN 'HOLD' ELSE 'PASS' END AS verdict FROM offers)")
def legacy_units(spark, sf_dir):
    verdict = F.when(F.col("id") % 3 == 0, "GO").when(F.col("id") % 3 == 1, "HOLD").otherwise("PASS")
    return offers(spark, sf_dir).select("id", scoring.legacy_price_points(F.col("price")).alias("pts"), scoring.legacy_units(verdict, F.col("price")).alias("units"))


@query(f"{Q.FULL_SQL} SELECT id, coalesce(unique_grade, 'C') AS unique_grade, coalesce(CASE WHEN id % 2 = 0 THEN family_grade END, unique_grade, 'U') AS overall_grade FROM full_offers")
def legacy_family(spark, sf_dir):
    """Every other offer states its overall grade."""
    stated = F.when(F.col("id") % 2 == 0, F.col("family_grade"))
    unique, overall = scoring.legacy_family(F.col("unique_grade"), stated)
    return Q.full_offers(spark, sf_dir).select("id", unique.alias("unique_grade"), overall.alias("overall_grade"))


DETAIL_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS item, CAST({Q._points(R.POINTS[k], c)} AS INTEGER) AS pts FROM full_offers" for k, c in Q.GRADE_COLS)


@query(f"{Q.FULL_SQL} {DETAIL_SQL}")
def points_detail(spark, sf_dir):
    """The points of each graded component of an offer."""
    detail = F.array(*[F.struct(F.lit(k).alias("item"), R.points(R.POINTS[k], F.col(c)).cast("int").alias("pts")) for k, c in Q.GRADE_COLS])
    return Q.full_offers(spark, sf_dir).select("id", F.inline(detail))


@query(f"WITH decided AS ({Q._decide_sql("'B', 'C', 'none'")}) SELECT id, verdict || ' ' || CAST(points AS VARCHAR) || CASE WHEN hard IS NOT NULL THEN ' / ' || hard ELSE '' END || CASE WHEN combos <> '' THEN ' / ' || combos ELSE '' END AS card FROM decided")
def pocket_card(spark, sf_dir):
    """A decision in one line."""
    return scoring.decided(Q.full_offers(spark, sf_dir)).select("id", scoring.card().alias("card"))


@query("SELECT e.event_id, CASE WHEN e.event_id % 7 = 0 THEN 'date' WHEN e.event_id % 5 = 0 THEN 'amount' END AS reason, CASE WHEN e.event_id % 5 <> 0 THEN CAST(floor(500 - e.event_id % 1000 + 0.5) AS BIGINT) END AS amount FROM events e")
def opening_validate(spark, sf_dir):
    """Opening amounts may be zero or negative."""
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "abc").otherwise((500 - k % 1000).cast("string"))
    raw = read(spark, sf_dir, "events").select("event_id", F.when(k % 7 != 0, F.to_date("ts")).alias("date"), text.alias("amount_text"))
    return ledger.validated_opening(raw).select("event_id", "reason", "amount")


@query("SELECT s_name || CASE s_suppkey % 3 WHEN 0 THEN '牧場' WHEN 1 THEN 'カナ' ELSE '' END AS name FROM supplier WHERE s_suppkey % 3 < 2")
def suggestion_names(spark, sf_dir):
    """Names for a suggestion list: those with a Japanese character, longer than one, each once."""
    k = F.col("s_suppkey") % 3
    name = F.concat("s_name", F.when(k == 0, "牧場").when(k == 1, "カナ").otherwise(""))
    s = read(spark, sf_dir, "supplier").select(name.alias("name"))
    return s.where(X.japanese(F.col("name")) & (F.length("name") > 1)).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS INTEGER) ELSE 0 END AS n, split_part(o_orderpriority || '|a|b', '|', 1) AS trainer, 'a|b' AS family FROM orders")
def tolerant_parts(spark, sf_dir):
    """Counts from text, zero where there is none; a key split at its first bar."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 4 == 2, "x1")
    key = F.split(F.concat("o_orderpriority", F.lit("|a|b")), r"\|", 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", X.int_or_zero(text).alias("n"), key[0].alias("trainer"), key[1].alias("family"))


@query(f"{Q.W}, {Q.PREFIX_SQL} SELECT trainer FROM ({Q.GT}) UNION SELECT name FROM dims")
def trainer_names(spark, sf_dir):
    return trainers(spark, sf_dir).select("trainer").union(Q.prefixes(spark, sf_dir).select("name")).distinct()


def _labels(table: dict, col: str, part: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v[part]}'" for k, v in table.items()) + (f" ELSE '{table['none'][part]}'" if "none" in table else "") + " END"


@query(f"{Q.W} SELECT 'trainer' AS kind, trainer AS name, {_labels(R.GRADE_LABELS, 'grade', 0)} AS label, {_labels(R.GRADE_LABELS, 'grade', 1)} AS short, {_labels(R.GRADE_LABELS, 'grade', 2)} AS hint FROM ({Q.GT}) UNION ALL SELECT 'sire', sire, {_labels(R.TIER_LABELS, 'tier', 0)}, {_labels(R.TIER_LABELS, 'tier', 1)}, {_labels(R.TIER_LABELS, 'tier', 2)} FROM (SELECT *, {Q.TIER_SQL} AS tier FROM {Q.SIRES})")
def grade_labels(spark, sf_dir):
    """Grades of trainers and tiers of sires as readers see them."""
    of = lambda table, c: [R.labelled(table, c, i).alias(n) for i, n in enumerate(("label", "short", "hint"))]
    graded_trainers = trainers(spark, sf_dir).select(F.lit("trainer").alias("kind"), F.col("trainer").alias("name"), *of(R.GRADE_LABELS, F.col("grade")))
    sires = Q.sires(spark, sf_dir).select(F.lit("sire").alias("kind"), F.col("sire").alias("name"), *of(R.TIER_LABELS, R.sire_tier(F.col("sire_score"))))
    return graded_trainers.unionByName(sires)


SIRE_DEFAULT = 2.0
HOLDS = "contains(lower(replace(d.name, ' ', '')), lower(replace(a.q, ' ', '')))"


def _near(asked: str, dim: str) -> str:
    """Every asked row with the exact match of q, else the first in ord that holds it."""
    return f"(SELECT * FROM (SELECT a.*, d.*, row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN d.name = a.q THEN 0 ELSE 1 END, d.ord) AS k FROM {asked} a LEFT JOIN ({dim}) d ON d.name = a.q OR {HOLDS}) WHERE k = 1)"


near_score = Q.near_score


@query(f"WITH asked AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(substr(p_type, 1, length(p_type) - 1)) ELSE 'nobody' END AS q FROM part) SELECT p_partkey, coalesce(name, q) AS sire, coalesce(sire_score, {SIRE_DEFAULT}e0) AS score, CASE WHEN name IS NULL THEN 'low' ELSE {Q.TIER_SQL} END AS tier, name IS NULL AS unlisted FROM {_near('asked', f'SELECT sire AS name, sire AS ord, sire_score FROM {Q.SIRES}')}")
def find_sire(spark, sf_dir):
    """A sire by name, else the first that scores 60 or more, else the default marked as unlisted."""
    k, kind = F.col("p_partkey") % 3, F.col("p_type")
    asked = read(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, kind).when(k == 1, F.lower(F.substr(kind, F.lit(1), F.length(kind) - 1))).otherwise("nobody").alias("q"))
    dims = Q.sires(spark, sf_dir).withColumn("ord", F.col("sire"))
    found = lookup.first_match(asked, "q", dims, "sire", "ord", ["sire_score"], near_score, norm=X.norm_kana)
    score = F.coalesce("sire_score", F.lit(SIRE_DEFAULT))
    return found.select("p_partkey", F.coalesce("matched", "q").alias("sire"), score.alias("score"), R.sire_tier(score).alias("tier"), F.col("matched").isNull().alias("unlisted"))


NAMED_ALIASES = [("zzz line", "S", "old bolt", 1), ("yyy line", "A", None, 2)]
ALIASES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{m}', {f"'{s}'" if s else 'NULL'}, {o})" for a, m, s, o in NAMED_ALIASES) + ") AS v(name, manual, suggests, ord)"


@query(f"""{Q.W}, asked AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(substr(p_name, 1, length(p_name) - 1)) WHEN 2 THEN 'YYY' ELSE 'zzz line' END AS q FROM part),
  hit AS (SELECT p_partkey, q, name, grade FROM {_near('asked', f'SELECT family AS name, family AS ord, grade FROM ({Q.OVER_IDX})')}), ali AS (SELECT p_partkey, name AS alias, manual, suggests FROM {_near('asked', ALIASES_SQL)})
  SELECT p_partkey, CASE WHEN name IS NOT NULL THEN 'hit' WHEN alias IS NOT NULL THEN 'alias' ELSE 'missing' END AS found, coalesce(name, alias) AS matched, coalesce(grade, manual) AS grade, CASE WHEN name IS NULL THEN suggests END AS suggested FROM hit JOIN ali USING (p_partkey)""")
def find_family(spark, sf_dir):
    """A family by name or score, else an alias by name or score with its grade by hand and the line that it suggests, else missing."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    q = F.when(k == 0, name).when(k == 1, F.upper(F.substr(name, F.lit(1), F.length(name) - 1))).when(k == 2, "YYY").otherwise("zzz line")
    asked = read(spark, sf_dir, "part").select("p_partkey", q.alias("q"))
    dims = families(spark, sf_dir).withColumn("ord", F.col("family"))
    aliases = spark.createDataFrame(NAMED_ALIASES, "alias string, manual string, suggests string, ord int")
    hit = lookup.first_match(asked, "q", dims, "family", "ord", ["grade"], near_score, norm=X.norm_kana)
    both = lookup.first_match(hit.withColumnRenamed("matched", "family"), "q", aliases, "alias", "ord", ["manual", "suggests"], near_score, norm=X.norm_kana)
    found = F.when(F.col("family").isNotNull(), "hit").when(F.col("matched").isNotNull(), "alias").otherwise("missing")
    return both.select("p_partkey", found.alias("found"), F.coalesce("family", "matched").alias("matched"), F.coalesce("grade", "manual").alias("grade"), F.when(F.col("family").isNull(), F.col("suggests")).alias("suggested"))


@query(f"{Q.W} SELECT 'C1' AS combo, 'unique' AS kind, family AS name, own_grade AS grade FROM (SELECT a.family, a.club_unique, o.grade AS own_grade FROM ({Q.SHARED}) a JOIN ({Q.OWN}) o ON a.family = o.family AND a.family_code = o.family_code) WHERE club_unique AND own_grade IN ('S', 'A') UNION ALL SELECT 'C4', 'signature', line, grade FROM {LINES_SQL} WHERE grade IN ('S', 'A')")
def combo_candidates(spark, sf_dir):
    """What else lights a combination: the club's own families (C1) and the signature lines (C4) of grade S or A."""
    own = Q.unique_family_grade(spark, sf_dir).where(F.col("club_unique") & F.col("own_grade").isin("S", "A"))
    grade = F.when(F.col("p_partkey") % 3 == 0, "S").when(F.col("p_partkey") % 3 == 1, "A").otherwise("B")
    lines = read(spark, sf_dir, "part").where("p_size < 10").groupBy(F.col("p_name").alias("name")).agg(F.min(grade).alias("grade")).where(F.col("grade").isin("S", "A"))
    of = lambda df, combo, kind, name, g: df.select(F.lit(combo).alias("combo"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(g).alias("grade"))
    return of(own, "C1", "unique", "family", "own_grade").unionByName(of(lines, "C4", "signature", "name", "grade"))


def axis(spark: SparkSession, sf_dir: str, owner: int):
    """One owner's summary in one row: its name, counts, and its 30 trainers with most horses; an owner that isn't there is an error."""
    who = lookup.required(read(spark, sf_dir, "nation").where(F.col("n_nationkey") == owner).select(F.col("n_nationkey").alias("owner"), "n_name"), f"no owner {owner}")
    ours = horses(spark, sf_dir).where(F.col("owner") == owner)
    per_trainer = ours.groupBy("owner", *Q.T).agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce("active", F.lit("0")) == "0").cast("long")).alias("active"), F.sum("wins").alias("wins"), F.sum("starts").alias("starts"))
    counts = per_trainer.groupBy("owner").agg(*[F.sum(c).alias(c) for c in ("n", "active", "wins", "starts")])
    top = per_trainer.orderBy(F.desc("n"), "trainer_code").limit(30)
    top = top.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "trainer_code", "trainer", "n"))).alias("t"))
    row = who.join(counts, "owner", "left").join(top, "owner", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    listed = F.transform(F.coalesce("t", F.array().cast(top.schema["t"].dataType)), lambda x: F.struct(x["trainer"].alias("trainer"), x["trainer_code"].cast("string").alias("trainer_code"), x["n"].alias("n")))
    return row.select("owner", "n_name", zero(F.col("n"), "n_horses"), zero(F.col("active"), "n_active"), zero(F.col("wins"), "wins"), zero(F.col("starts"), "starts"), listed.alias("trainers"))


@query(f"{Q.W} SELECT n_nationkey AS owner, n_name, n_horses, n_active, wins, starts, trainers FROM nation, ({Q.ORACLE_SQL['axis_counts'].removeprefix(Q.W)}), (SELECT string_agg(trainer || ':' || n, ',' ORDER BY n DESC, trainer_code) AS trainers FROM ({Q.ORACLE_SQL['axis_top_trainers'].removeprefix(Q.W)})) WHERE n_nationkey = {CLUB}")
def axis_summary(spark, sf_dir):
    text = F.array_join(F.transform("trainers", lambda x: F.concat_ws(":", x["trainer"], x["n"].cast("string"))), ",")
    return axis(spark, sf_dir, CLUB).withColumn("trainers", text)


REPORT_SQL = " || ".join(f"chr(10) || '{k} ' || coalesce({c}, 'none') || ' ' || CAST({Q._points(R.POINTS[k], c)} AS INTEGER)" for k, c in Q.GRADE_COLS)


@query(f"WITH d AS ({Q._decide_sql("'B', 'C', 'none'", more=''.join(f', {c}' for _, c in Q.GRADE_COLS))}) SELECT id, d.verdict || ' ' || d.points || {REPORT_SQL} || CASE WHEN d.combos <> '' THEN chr(10) || 'combos ' || d.combos ELSE '' END || CASE WHEN d.hard IS NOT NULL THEN chr(10) || 'pass ' || d.hard ELSE '' END AS report FROM d")
def decision_report(spark, sf_dir):
    """A decision as a text report that lists the points by component."""
    return scoring.decided(Q.full_offers(spark, sf_dir)).select(*scoring.detail())


SET_SQL = "CASE id % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'auto' WHEN 2 THEN 'C' END"
LINE_SQL = f"(SELECT f.family AS suggests, coalesce(w.own_grade, f.grade) AS suggested FROM ({Q.OVER_IDX}) f LEFT JOIN ({Q.OWN_IDX}) w ON f.family = w.family WHERE f.family = 'old bolt')"
BY_HAND_SQL = f"""{Q.BROWSER_SQL}, known AS (SELECT o.*, CASE WHEN o.family_q = 'zz' THEN 'A' END AS manual, CASE WHEN o.family_q = 'zz' THEN s.suggested END AS suggested FROM full_offers o LEFT JOIN {LINE_SQL} s ON true),
  hand AS (SELECT id, weight, price, status, sire_tier, coalesce(CASE WHEN {SET_SQL} <> 'auto' THEN {SET_SQL} END, family_grade, manual, CASE WHEN family_q = '' THEN 'none' ELSE 'U' END) AS family_grade,
    CASE WHEN id % 9 = 0 THEN 'B' WHEN family_grade IS NOT NULL AND club_unique THEN coalesce(unique_grade, 'none') ELSE coalesce(manual, 'none') END AS unique_grade, CASE WHEN id % 13 = 0 THEN 'A' ELSE coalesce(cross_grade, 'none') END AS cross_grade,
    coalesce(signature_grade, suggested, 'none') AS signature_grade, CASE WHEN trainer_known THEN shown_grade WHEN trainer_q = '' THEN 'none' ELSE 'U' END AS trainer_grade FROM known),
  pts AS (SELECT id, CAST({" + ".join(Q._points(R.POINTS[k], c) for k, c in Q.GRADE_COLS)} + {Q.PRICE_PTS_SQL} + CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END - CASE WHEN weight <= 420 THEN 1 ELSE 0 END AS INTEGER) AS points,
    CASE WHEN status = '満口' THEN '満口' WHEN price > 4.0 THEN '一口4万円超は原則見送り' WHEN id % 11 = 0 THEN '近況に重大リスク語' END AS hard,
    concat_ws(',', CASE WHEN unique_grade IN ('S', 'A') AND trainer_grade IN ('S', 'A') THEN 'C1' END, CASE WHEN cross_grade IN ('S', 'A') THEN 'C2' END, CASE WHEN family_grade IN ('S', 'A') AND sire_tier = 'top' AND price <= 2.0 THEN 'C3' END,
      CASE WHEN signature_grade IN ('S', 'A') AND family_grade IN ('B', 'C', 'none', 'U') THEN 'C4' END, CASE WHEN price >= 2.5 AND cross_grade NOT IN ('S', 'A') AND unique_grade NOT IN ('S', 'A') THEN 'C5' END) AS combos FROM hand)
  SELECT id, points, combos, hard, CASE WHEN hard IS NOT NULL THEN 'PASS' WHEN points >= 12 THEN 'GO' WHEN points >= 8 THEN 'HOLD' ELSE 'PASS' END AS verdict FROM pts"""


@query(BY_HAND_SQL)
def decide_by_hand(spark, sf_dir):
    """Decisions with aliases, the signature that an alias suggests, and grades set by hand; names are found by their scores."""
    c, k = F.col, F.col("id")
    ranks = Q.ranks(spark, sf_dir, *KINDS)
    lines = Q.families_of(ranks).join(Q.aliases(spark).select(c("suggests").alias("family")), "family", "left_semi")
    named = Q.aliases(spark).join(lines.select(c("family").alias("suggests"), F.coalesce("own_grade", "grade").alias("suggested")), "suggests", "left")
    rows = Q.full_offers(spark, sf_dir, ranks, browser=True).join(F.broadcast(named.select("alias", "manual", "suggested")), lookup.holds(near_score, c("family_q"), c("alias"), X.norm_kana(c("family_q")), X.norm_kana(c("alias"))), "left")
    typed = {
        "overall_set": F.when(k % 7 == 0, "S").when(k % 7 == 1, "auto").when(k % 7 == 2, "C"),
        "unique_set": F.when(k % 9 == 0, "B"),
        "cross_set": F.when(k % 13 == 0, "A").otherwise("auto"),
        "state": F.when(k % 4 == 0, "good").when(k % 4 == 1, "mild"),
        "injury": k % 11 == 0,
    }
    return scoring.by_hand(rows.withColumns(typed)).select("id", "points", F.array_join("combos", ",").alias("combos"), "hard", "verdict")


_values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
POINT_ROWS = [(k, g, p) for k, t in R.POINTS.items() for g, p in t.items()]
USED_SQL = " UNION ALL ".join(f"SELECT '{k}' AS component, coalesce({c}, 'none') AS grade FROM full_offers" for k, c in Q.GRADE_COLS)


@query(f"{Q.FULL_SQL} SELECT p.component, p.grade, CAST(p.pts AS INTEGER) AS pts, CAST(count(u.grade) AS BIGINT) AS n_offers FROM {_values(POINT_ROWS)} AS p(component, grade, pts) LEFT JOIN ({USED_SQL}) u ON p.component = u.component AND p.grade = u.grade GROUP BY ALL")
def points_sheet(spark, sf_dir):
    """The points of each grade of each component, and how many offers have them."""
    graded = F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.coalesce(F.col(c), F.lit("none")).alias("grade")) for k, c in Q.GRADE_COLS]))
    used = Q.full_offers(spark, sf_dir).select(graded).groupBy("component", "grade").agg(F.count(F.lit(1)).alias("n_offers"))
    return F.broadcast(R.points_table(spark)).join(used, ["component", "grade"], "left").select("component", "grade", "pts", F.coalesce("n_offers", F.lit(0)).alias("n_offers"))


LABEL_ROWS = [(kind, code, *names) for kind, t in (("grade", R.GRADE_LABELS), ("tier", R.TIER_LABELS)) for code, names in t.items()]
RANKED_SQL = f"SELECT 'trainer' AS entity, 'grade' AS kind, grade AS code FROM ({Q.GT}) UNION ALL SELECT 'family', 'grade', grade FROM ({Q.GF}) UNION ALL SELECT 'overall', 'grade', grade FROM ({Q.GO_}) UNION ALL SELECT 'own', 'grade', grade FROM ({Q.OWN}) UNION ALL SELECT 'cross', 'grade', grade FROM ({Q.GX}) UNION ALL SELECT 'sire', 'tier', {Q.TIER_SQL} FROM {Q.SIRES}"


@query(f"{Q.W} SELECT e.entity, l.code, l.label, l.short, l.hint, CAST(count(r.code) AS BIGINT) AS n FROM (SELECT DISTINCT entity, kind FROM ({RANKED_SQL})) e JOIN {_values(LABEL_ROWS)} AS l(kind, code, label, short, hint) ON e.kind = l.kind LEFT JOIN ({RANKED_SQL}) r ON r.entity = e.entity AND r.code = l.code GROUP BY ALL")
def tiers_sheet(spark, sf_dir):
    """The grades and tiers with their labels and hints, and how many entities of each kind have them."""
    graded = Q.ranks(spark, sf_dir, *KINDS).select(F.col("kind").alias("entity"), F.lit("grade").alias("kind"), F.col("grade").alias("code"))
    tiers = Q.sires(spark, sf_dir).select(F.lit("sire").alias("entity"), F.lit("tier").alias("kind"), R.sire_tier(F.col("sire_score")).alias("code"))
    counts = graded.unionByName(tiers).groupBy("entity", "kind", "code").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("entity", "kind").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("of"))
    rows = listed.join(F.broadcast(R.labels_table(spark)), "kind")
    return rows.select("entity", "code", "label", "short", "hint", F.coalesce(F.element_at("of", F.col("code")), F.lit(0)).alias("n"))


HEADS = {"own": 30, "trainer": 25, "cross": 25}
HEAD_COLS = "rank AS place, grade AS g, win_rate_sm AS smoothed, n_horses AS horses"


@query(f"{Q.W} SELECT 'own' AS view, family AS name, {HEAD_COLS}, club_share AS share, club_horses AS ours FROM ({Q.OWN}) WHERE rank <= 30 UNION ALL SELECT 'trainer', trainer, {HEAD_COLS}, NULL, NULL FROM ({Q.GT}) WHERE rank <= 25 UNION ALL SELECT 'cross', trainer || '|' || family, {HEAD_COLS}, NULL, NULL FROM ({Q.GX}) WHERE rank <= 25")
def rank_heads(spark, sf_dir):
    """The heads of three rank tables as a page shows them: 30 own families, 25 trainers and 25 crosses, with the page's names."""
    rows, own = Q.ranks(spark, sf_dir, *HEADS), F.col("kind") == "own"
    head = rows.where(F.coalesce(*[F.when(F.col("kind") == k, F.col("rank") <= n) for k, n in HEADS.items()]))
    name = F.when(own, F.col("family")).when(F.col("kind") == "trainer", F.col("trainer")).otherwise(F.concat_ws("|", "trainer", "family"))
    shown = [F.col(a).alias(b) for a, b in (("rank", "place"), ("grade", "g"), ("win_rate_sm", "smoothed"), ("n_horses", "horses"))]
    return head.select(F.col("kind").alias("view"), name.alias("name"), *shown, F.when(own, F.col("club_share")).alias("share"), F.when(own, F.col("club_horses")).alias("ours"))


COMBO_POINTS_SQL = f"SELECT 'C1' AS combo, 'unique' AS component, family AS name, grade FROM ({Q.OWN}) UNION ALL SELECT 'C1', 'trainer', trainer, grade FROM ({Q.GT}) UNION ALL SELECT 'C2', 'cross', trainer || '|' || family, grade FROM ({Q.GX}) UNION ALL SELECT 'C3', 'family', family, grade FROM ({Q.GO_}) UNION ALL SELECT 'C3', 'sire', sire, {Q.TIER_SQL} FROM {Q.SIRES} UNION ALL SELECT 'C4', 'signature', line, grade FROM {LINES_SQL}"


@query(f"{Q.W} SELECT combo, c.component, name, c.grade, CAST(pts AS INTEGER) AS pts FROM ({COMBO_POINTS_SQL}) c JOIN {_values(POINT_ROWS)} AS p(component, grade, pts) ON c.component = p.component AND c.grade = p.grade WHERE c.grade IN ('S', 'A', 'top')")
def combo_sheet(spark, sf_dir):
    """The entities that light each combination, with the points that their grade counts. C5 has none: it hangs on the price."""
    rows = Q.ranks(spark, sf_dir, "own", "trainer", "cross", "overall")
    of = {"own": ("C1", "unique", "family"), "trainer": ("C1", "trainer", "trainer"), "overall": ("C3", "family", "family")}
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in of.items()], F.lit(("C2", "cross")[i]))
    name = F.coalesce(*[F.when(F.col("kind") == k, F.col(v[2])) for k, v in of.items()], F.concat_ws("|", "trainer", "family"))
    entities = rows.select(pick(0).alias("combo"), pick(1).alias("component"), name.alias("name"), "grade")
    sires = Q.sires(spark, sf_dir).select(F.lit("C3").alias("combo"), F.lit("sire").alias("component"), F.col("sire").alias("name"), R.sire_tier(F.col("sire_score")).alias("grade"))
    grade = F.when(F.col("p_partkey") % 3 == 0, "S").when(F.col("p_partkey") % 3 == 1, "A").otherwise("B")
    lines = read(spark, sf_dir, "part").where("p_size < 10").groupBy(F.col("p_name").alias("name")).agg(F.min(grade).alias("grade"))
    lines = lines.select(F.lit("C4").alias("combo"), F.lit("signature").alias("component"), "name", "grade")
    lit = entities.unionByName(sires).unionByName(lines).where(F.col("grade").isin("S", "A", "top"))
    return lit.join(F.broadcast(R.points_table(spark)), ["component", "grade"]).select("combo", "component", "name", "grade", "pts")
