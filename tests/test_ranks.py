"""Places, the rank build, lookups by two keys and search, on skewed and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import text
from tallyworks.operators import grade, lookup, place, scoring, search, stats
from tallyworks.plans import registry
from tallyworks.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def scans(df, table):
    """How often the plan, and the plans of what it staged, scan a table."""
    return len(re.findall(rf"Location: InMemoryFileIndex.*{table}\.parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_places_of_one_score_spread_evenly(spark):
    """All rows tie, so that only the tie's keys part them."""
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("p").alias("pool"), F.lit(1.0).alias("score"), F.format_string("n%06d", F.pmod(F.col("id") * 7919, F.lit(40_000))).alias("name"))
    order = [F.desc_nulls_last("score"), F.col("name")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = place.ranged(rows, ["pool"], order).groupBy(F.shiftright("__at", 33)).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) == 8 and dealt.max() <= 2 * dealt.mean()
    got = place.placed(rows, ["pool"], order).select("name", "place", "of").collect()
    assert {(r["name"], r["place"], r["of"]) for r in got} == {(f"n{i:06d}", i + 1, 40_000) for i in range(40_000)}


def test_places_within_pools_with_nulls(spark):
    rows = [(p, s, n) for n, (p, s) in enumerate([("a", 1.0), (None, 2.0), ("b", None), ("a", None), ("a", 3.0), (None, 2.0), ("b", 1.0), ("a", 1.0)])]
    df = spark.createDataFrame(rows, "pool string, score double, name int")
    got = {r["name"]: (r["place"], r["of"]) for r in place.placed(df, ["pool"], [F.desc_nulls_last("score"), F.col("name")]).collect()}
    assert got == {4: (1, 4), 0: (2, 4), 7: (3, 4), 3: (4, 4), 1: (1, 2), 5: (2, 2), 6: (1, 2), 2: (2, 2)}
    assert place.placed(df.limit(0), ["pool"], [F.col("name")]).count() == 0


def test_running_sums_of_a_hot_account(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(3).alias("account"), (F.col("id") % 97).alias("day"), "id", F.when(F.col("id") % 11 != 0, F.col("id") % 100 - 40).alias("change"))
    rows = rows.withColumn("account", F.when(F.col("account") != 5, F.col("account")))
    got = place.running_sum(rows, ["account"], [F.col("day"), F.col("id")], "change", "balance").collect()
    at, wrong = {}, 0
    for r in sorted(got, key=lambda r: (r["account"] is None, r["account"] or 0, r["day"], r["id"])):
        at[r["account"]] = at.get(r["account"], 0) + (r["change"] or 0)
        wrong += at[r["account"]] != r["balance"]
    assert len(got) == 20_000 and not wrong and None in at


def test_grades_read_their_input_once(spark):
    df = spark.createDataFrame([(f"t{i}", i % 5 * 10, float(i % 3)) for i in range(40)], "name string, starts int, composite_raw double")
    rows = grade.graded(df, 20, ["name"]).orderBy("rank").collect()
    ranked = [r for r in rows if r["rank"]]
    assert [r["rank"] for r in ranked] == list(range(1, 25)) and {r["grade"] for r in rows if not r["rank"]} == {"U"}
    assert [r["grade"] for r in ranked] == ["S"] * 4 + ["A"] * 6 + ["B"] * 8 + ["C"] * 6
    assert [(r["composite_raw"], r["name"]) for r in ranked] == sorted(((r["composite_raw"], r["name"]) for r in ranked), key=lambda x: (-x[0], x[1]))


@pytest.fixture()
def staged_plans(monkeypatch):
    """The plans of all that is staged meanwhile."""
    from tallyworks.sources import staging

    plans = []
    plain = staging.staged

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    for module in (grade, place, lookup, registry):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", noted)
    return plans


@pytest.mark.parametrize("name", ["rank_build_counts", "family_report", "combo_lists", "unique_family_grade", "grade_family_overall", "grade_trainer"])
def test_rank_build_scans_the_horses_once(spark, staged_plans, name):
    df = QUERIES[name](spark, SF)
    texts = [*staged_plans, df._jdf.queryExecution().executedPlan().toString()]
    assert sum(len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", t)) for t in texts) == 1


def test_owner_reaches_the_scan(spark, staged_plans):
    df = registry.stats(spark, SF, "trainer")
    assert "EqualTo(c_nationkey,3)" in df._jdf.queryExecution().executedPlan().toString()
    QUERIES["grade_trainer"](spark, SF)
    assert any("EqualTo(c_nationkey,3)" in p for p in staged_plans)


def test_own_share_of_a_third(spark):
    """A family is the club's own with 3 horses and 0.35 of all, both at least."""
    horses = [("f1", 3, 5), ("f2", 2, 0), ("f3", 7, 13), ("f4", 7, 14), ("f5", 3, 0)]
    rows = [(f, f, "t", "1", o, 1, 20, 100) for f, ours, others in horses for o in [3] * ours + [4] * others]
    df = spark.createDataFrame(rows, "family string, family_code string, trainer string, trainer_code string, owner int, wins long, starts long, prize long")
    got = {(r["kind"], r["family"]): r for r in grade.rank_build(df, F.col("owner") == 3, ("overall", "own")).collect()}
    assert {f for k, f in got if k == "own"} == {"f1", "f3", "f5"} and got["overall", "f1"]["club_share"] == 0.375 and got["overall", "f4"]["club_share"] == 0.3333
    assert not got["overall", "f2"]["club_unique"] and got["overall", "f3"]["club_unique"]


def test_rank_build_on_odd_horses(spark):
    rows = [(" t ", "1", "f", "9", 3, 1, 30, 100), ("t", "1", "f ", "9", 3, 1, 30, None), ("", "2", "f", "9", 3, None, None, 5), ("u", None, None, "9", 3, 0, 5, 5), ("t", "1", "g", "8", None, 9, 50, 9), ("t", "1", "f", "9", 4, 2, 40, 7)]
    df = spark.createDataFrame(rows, "trainer string, trainer_code string, family string, family_code string, owner int, wins long, starts long, prize long")
    got = {(r["kind"], r["trainer"], r["family"]): (r["n_horses"], r["wins"], r["starts"], r["club_horses"], r["grade"]) for r in grade.rank_build(df, F.col("owner") == 3).collect()}
    assert got == {("trainer", "t", None): (2, 2, 60, 2, "B"), ("family", None, "f"): (3, 2, 60, 3, "B"), ("overall", None, "f"): (4, 4, 100, 3, "B"), ("cross", "t", "f"): (2, 2, 60, 2, "B"), ("own", None, "f"): (4, 4, 100, 3, "A")}
    assert grade.rank_build(df.limit(0), F.col("owner") == 3).count() == 0


def brute_cross(crosses, t, f):
    if not t or not f:
        return None
    ranked = sorted(crosses, key=lambda c: c[2])
    near = [c for c in ranked if (t.startswith(c[0]) or c[0].startswith(t)) and (f in c[1] or c[1] in f)]
    return next((c[2] for c in [*[c for c in ranked if c[:2] == (t, f)], *near]), None)


@pytest.mark.parametrize("few,salted", [(200, 200_000), (20, 200_000), (20, 5), (200, 5)])
def test_crosses_of_a_hot_trainer(spark, monkeypatch, few, salted):
    """One trainer has a third of all crosses and of all subjects; both ways of meeting give the first near cross."""
    words = ["old", "cold", "bolt", "red", "gizmo", "rod", "x", "blue anvil", "日本", "本"]
    crosses = [("hot" if i % 3 == 0 else f"t{i % 17}", f"{words[i % 10]} {words[i * 7 % 9]}"[: 1 + i % 12], i) for i in range(240)]
    asked = [(("hot", "ho", "hotel", f"t{i % 17}", "t1")[i % 5], f"{words[i * 3 % 10]} {words[i % 7]}"[: i % 13]) for i in range(150)]
    dim = spark.createDataFrame(crosses, "trainer string, family string, rank int")
    subjects = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, trainer string, family string")
    monkeypatch.setattr(lookup, "FEW", few)
    monkeypatch.setattr(lookup, "SALTED", salted)
    got = {r["id"]: r["rank"] for r in lookup.first_cross(subjects, dim, "rank", ["rank"]).collect()}
    assert got == {i: brute_cross([c for c in crosses if c[1].strip()], t, f if f.strip() else "") for i, (t, f) in enumerate(asked)}


@pytest.mark.parametrize("of_trainer,of_family", [(lookup.by_score, lookup.by_score), (lookup.both_prefixes, lookup.either_contains), (lookup.name_contains, lookup.query_contains), (lookup.query_contains, lookup.name_contains)])
def test_crosses_do_not_hang_on_how_many_there_are(spark, monkeypatch, of_trainer, of_family):
    """Long families that score by common characters, exact names of which no key is left and crosses without a place, by each way of meeting."""
    long = "abcdefghij" * 4
    families = ["old bolt", "Old Bolt x", "bolt", long[::-1] + "k", "jihgfedcba k", "K jihgfedcba", "\x0b", "ディープ x", "x"]
    crosses = [(("hot", "hotel", "t")[i % 3], f"{families[i % 9]}{i if i % 4 == 0 else ''}", None if i == 7 else i) for i in range(60)] + [("\x0b", "f", 70), ("h" * 45, long, 71), ("hot", "\x0b", 72)]
    asked = [(t, f) for t in ("hot", "HO", "hotels", "\x0b", "h" * 45, long) for f in (*families, long, "old", "でぃーぷ", "f", "bolt xyz")]
    dim = spark.createDataFrame(crosses, "trainer string, family string, rank int")
    subjects = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, trainer string, family string")
    key = text.norm_kana
    rule = lambda f, q, n: (key(q) != "") & (key(n) != "") & (f(key(q), key(n)))
    c = dim.select(F.col("trainer").alias("t"), F.col("family").alias("f"), "rank")
    exact = (F.col("trainer") == F.col("t")) & (F.col("family") == F.col("f"))
    near = subjects.join(c, exact | (rule(of_trainer, F.col("trainer"), F.col("t")) & rule(of_family, F.col("family"), F.col("f"))))
    want = {i: None for i in range(len(asked))} | {r["id"]: r["r"] for r in near.groupBy("id").agg(F.min_by("rank", F.struct(~exact, "rank")).alias("r")).collect()}
    for few, salted, listed, lengths in ((200, 200_000, 20_000, 48), (5, 200_000, 20_000, 48), (5, 4, 20_000, -1), (200, 4, -1, -1)):
        for name, value in (("FEW", few), ("SALTED", salted), ("MAX_BROADCAST_ROWS", listed), ("MAX_LENGTHS", lengths)):
            monkeypatch.setattr(lookup, name, value)
        assert {r["id"]: r["rank"] for r in lookup.first_cross(subjects, dim, "rank", ["rank"], of_trainer, of_family, key).collect()} == want
    assert sum(r is not None for r in want.values()) > 10 and (of_family is not lookup.by_score or want[asked.index(("hot", long))] is not None)


@pytest.mark.parametrize("exact_first", [True, False])
def test_lookups_by_score_do_not_hang_on_how_many_names_there_are(spark, monkeypatch, exact_first):
    """An exact name of which no key is left, and more lengths of long names than meet by parts."""
    long = "abcdefghij" * 4
    dim = spark.createDataFrame([("jihgfedcba k", 1), ("\x0b", 2), ("bolt", 3), (None, 4), ("old bolt", None)], "name string, ord int")
    asked = spark.createDataFrame([(q,) for q in ("\x0b", long, long + "k", "bolt", "ol", "B" * 50)], "q string").select(F.lit("one").alias("kind"), F.col("q").alias("__q"))
    find = lambda: {r["__q"]: r["one"]["matched"] for r in lookup.matches_of_kinds(asked, {"one": lookup.Listing(dim, "name", "ord", [], lookup.by_score, text.norm_kana, exact_first)}).collect()}
    want = {long: "jihgfedcba k", long + "k": "jihgfedcba k", "bolt": "bolt" if exact_first else "old bolt", "ol": "old bolt", "B" * 50: "old bolt"} | ({"\x0b": "\x0b"} if exact_first else {})
    for small, lengths, listed in ((5_000_000, 48, 20_000), (-1, 48, 20_000), (-1, -1, 20_000), (-1, -1, -1)):
        for name, value in (("MAX_PAIRS", small), ("MAX_LENGTHS", lengths), ("MAX_BROADCAST_ROWS", listed)):
            monkeypatch.setattr(lookup, name, value)
        assert find() == want


def test_blocks_of_families_part_a_hot_trainer(spark):
    """The crosses of one trainer meet the subjects of its own by family, not all of them."""
    many = spark.range(4000).select(F.lit("hot").alias("__name"), F.format_string("family %05d of many", "id").alias("__f"), F.struct(F.col("id").alias("rank")).alias("__m"), F.col("id").alias("__ord"))
    asked = many.select(F.col("__name").alias("__q"), F.col("__f").alias("family")).where("__ord % 4 = 0")
    pairs = lookup.near_crosses(asked, many, spark.createDataFrame([("hot", "hot")], "__q string, __name string"), lookup.either_contains, lambda c: c)
    assert pairs.select("family", "__f").distinct().count() == 1000


def test_search_is_that_of_all_pairs(spark):
    names = ["DeepImpact", "ディープ インパクト", "deep", "Impact deep", "aab", "abb", "b", "ab", "  ", "", None, "Supplier#1", "日本", "本日", "pppp", "ppq", "deep"]
    rows = [(("x", "y")[i % 2], n, i) for i, n in enumerate(names)]
    items = spark.createDataFrame(rows, "category string, name string, ord int")
    queries = spark.createDataFrame([(q,) for q in ("deep", "ab", "b", "でぃーぷ", "pp", "本", "zz", "", " ", None, "supplier #1", "bab")], "query string")
    scored = items.crossJoin(queries).withColumn("score", text.match_score(F.col("query"), F.col("name"))).where("score > 0").collect()
    for k, keep in ((3, False), (100, True)):
        index = search.indexed(items, k, keep)
        got = {(r["query"], r["category"], r["place"]): (r["name"], r["score"]) for r in search.best(index, queries).collect()}
        want = {}
        for q, c in {(r["query"], r["category"]) for r in scored}:
            mine = sorted((r for r in scored if (r["query"], r["category"]) == (q, c)), key=lambda r: (-r["score"], r["ord"]))
            want |= {(q, c, i): (r["name"], r["score"]) for i, r in enumerate(mine[:k], 1)}
        assert got == want
        first = {(r["query"], r["place"]): r["ord"] for r in search.first_of(index, queries, 2).collect()}
        assert first == {(q, i): o for q in {r["query"] for r in scored} for i, o in enumerate(sorted(r["ord"] for r in scored if r["query"] == q)[:2], 1)}
        plan = search.best(index, queries)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        if keep:
            index.drop()
    with pytest.raises(ValueError, match="good for 3"):
        search.best(search.indexed(items, 3), queries, 4)


def test_only_eligible_offers_are_ranked(spark):
    df = spark.createDataFrame([("p", "a", 9.0, False), ("p", "b", 5.0, True), ("p", "c", 5.0, True)], "pool string, name string, total double, eligible boolean")
    assert [(r["name"], r["rank"], r["label"]) for r in scoring.ranked(df, only_eligible=True).orderBy("rank").collect()] == [("b", 1, "本命"), ("c", 2, "控え")]
    assert [(r["name"], r["label"]) for r in scoring.ranked(df).orderBy("rank").collect()] == [("a", "見送り"), ("b", "控え"), ("c", "3位")]


def test_metrics_of_a_known_family(spark):
    df = spark.createDataFrame([(14, 93, 10, 5_168_000)], "wins long, starts long, n_horses long, prize long")
    row = stats.with_rates(df).first()
    assert (row["win_rate"], row["win_rate_sm"], row["prize_man_per_horse"]) == (0.1505, 0.1429, 5168.0)
    assert row["composite_raw"] == pytest.approx(31.3866, abs=1e-4)
    own = grade.graded(spark.createDataFrame([(i, 1, float(-i)) for i in range(16)], "family_code int, starts int, composite_raw double"), 0, ["family_code"], steps=grade.OWN_GRADES)
    assert "".join(r["grade"] for r in own.orderBy("rank").collect()) == "SSSAAAAABBBBBCCC"
