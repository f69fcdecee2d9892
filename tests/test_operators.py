"""Operators on odd rows, and the ways that only large tables take."""

from pyspark.sql import functions as F

from tallyworks.functions import text
from tallyworks.operators import lookup, scoring, stats
from tallyworks.plans import horses, registry


def test_first_match_of_large_dimensions(spark, monkeypatch):
    names = ["ab", "abcde", "cde", "x", "日本語", "本", "zzz yy", ""]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    asked = spark.createDataFrame([(q,) for q in ("abcdef", "bcd", "de", "xyz", "日本", "本語の", "zzz", "q", "", None)], "q string")
    for fuzzy in (lookup.either_contains, lookup.both_prefixes, lookup.query_contains, lookup.name_contains):
        find = lambda: sorted(((r["q"] or "", r["matched"] or "") for r in lookup.first_match(asked, "q", dim, "name", "ord", ["ord"], fuzzy).collect()))  # noqa: E731, B023
        small = find()
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", -1)
        assert find() == small
        monkeypatch.undo()


def test_first_match_by_score_of_large_dimensions(spark, monkeypatch):
    names = ["DeepImpact", "ディープ インパクト", "Supplier#1", "A b", "  ", "other"]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    asked = spark.createDataFrame([(q,) for q in ("deep impact", "でぃーぷ", "IMPACT", "ab", "supplier #1", "B", "　", "none of them", None)], "q string")
    near = lambda q, n: text.match_score(q, n) >= 60
    find = lambda: {r["q"]: r["matched"] for r in lookup.first_match(asked, "q", dim, "name", "ord", ["ord"], near, norm=text.norm_kana).collect()}
    small = find()
    assert small == {"deep impact": "DeepImpact", "でぃーぷ": "ディープ インパクト", "IMPACT": "DeepImpact", "ab": "A b", "supplier #1": "Supplier#1", "B": "A b", "　": None, "none of them": None, None: None}
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", -1)
    assert find() == small


def test_names_with_a_common_beginning_do_not_all_meet(spark):
    names = spark.range(1000).select(F.format_string("Supplier#%09d", "id").alias("__name"))
    asked = names.select(F.col("__name").alias("__q"))
    assert lookup.by_head(asked, names).distinct().count() == 1000


def test_many_found_names_are_not_broadcast(spark, monkeypatch):
    """However small their files are: in memory they take many times as much."""
    asked = spark.createDataFrame([(i, f"name {i:03}") for i in range(60)], "id int, q string")
    dim = spark.createDataFrame([(f"name {i:03}"[: 8 if i % 2 else 7], i) for i in range(60)], "name string, ord int")
    find = lambda: lookup.first_match(asked, "q", dim, "name", "ord", ["ord"], lookup.both_prefixes)
    crosses = lambda: lookup.first_cross(asked.select("id", F.col("q").alias("trainer"), F.lit("f").alias("family")), dim.select(F.col("name").alias("trainer"), F.lit("f").alias("family"), "ord"), "ord", ["ord"])
    few = [sorted(map(tuple, f().collect()), key=repr) for f in (find, crosses)]
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 40)
    for f, want in zip((find, crosses), few):
        plan = f()._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
        assert sorted(map(tuple, f().collect()), key=repr) == want


def test_first_cross_is_exact_else_fuzzy(spark, monkeypatch):
    crosses = [("t1", "cold bolt", "A", 3), ("t1", "bolt", "B", 2), ("t1", "old bolt x", "S", 1), ("t10", "red", "C", 4), ("t2", "", "S", 0), ("", "red", "S", 5), ("t1", "bolt", "C", 6)]
    asked = [("t1", "old bolt"), ("t1", "bolt"), ("t1", "cold bolt"), ("t", "cold"), ("t1", "red"), ("t10", "red wine"), ("t10", "bolt"), ("t2", "red"), ("t3", "bolt"), ("", "red"), ("t1", ""), (None, "red"), ("t1", None), ("t1", "old bolt")]

    def first(t, f):
        if not t or not f:
            return None
        ranked = sorted(crosses, key=lambda c: c[3])
        fuzzy = [c for c in ranked if c[0] and c[1] and (t.startswith(c[0]) or c[0].startswith(t)) and (f in c[1] or c[1] in f)]
        return next((c[2:] for c in [*[c for c in ranked if c[:2] == (t, f)], *fuzzy]), None)

    subjects = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, trainer string, family string")
    dim = spark.createDataFrame(crosses, "trainer string, family string, grade string, rank int")
    for limit in (20_000, -1):
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", limit)
        got = {r["id"]: (r["grade"], r["rank"]) for r in lookup.first_cross(subjects, dim, "rank", ["grade", "rank"]).collect()}
        assert got == {i: first(*a) or (None, None) for i, a in enumerate(asked)}
    assert first("t1", "old bolt") == ("S", 1) and first("t1", "red") == ("C", 4)


def test_ranks_follow_the_whole_order(spark):
    rows = [(("p", "q", None, "")[i % 4], f"n{i % 7}", (i * 37 % 11) / 4, i % 3 > 0, i) for i in range(60)] + [("p", "none", None, True, 99)]
    df = spark.createDataFrame(rows, "pool string, name string, total double, eligible boolean, i int")
    got = scoring.ranked(df).collect()
    assert len(got) == len(rows)
    for pool in ("p", "q", "default"):
        mine = sorted((r for r in got if r["pool"] == pool), key=lambda r: r["rank"])
        key = [(-(r["total"] if r["total"] is not None else -1), r["name"], not r["eligible"]) for r in mine]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and key == sorted(key)


def test_text_counters(spark):
    columns = ["chokyoshimei_ryakusho", "chokyoshi_code", "ketto6_bamei", "ketto6_hanshoku_toroku_bango", "banushi_code", *stats.MASTER_COUNTERS, "heichi_honshokin_ruikei"]
    rows = [(" t ", "1", "f", "9", "c", "2", "1", "0", "0", "0", "3", "500"), ("t", "1", "f", "9", "c", "1", " ", "0", "0", "0", "3", None)]
    got = stats.entity_stats(stats.master(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))), ["trainer"]).first()
    assert (got["trainer"], got["n_horses"], got["wins"], got["starts"], got["prize"]) == ("t", 2, 3, 6, 500)


def test_names_meet_by_whole_parts(spark, monkeypatch):
    """No near pair is lost and no other pair meets; scores of long names count as well."""
    long = "abcdefghij" * 4
    names = ["ab", "abcde", "cde", "x", "日本語", "本", "zzz yy", "Zzz", "ディープ インパクト", "A b", " ", long[::-1] + "k"]
    asked = ["abcdef", "bcd", "de", "xyz", "日本", "本語の", "zzz", "q", "ab", "でぃーぷ", "　", "", None, long]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    queries = spark.createDataFrame([(q,) for q in asked], "q string")
    for fuzzy in lookup.PARTS:
        norm = text.norm_kana if fuzzy is lookup.by_score else lambda c: c
        for exact_first in (True, False):
            find = lambda: sorted((r["__q"], r["one"]["matched"]) for r in lookup.matches_of_kinds(queries.select(F.lit("one").alias("kind"), F.col("q").alias("__q")), {"one": lookup.Listing(dim, "name", "ord", [], fuzzy, norm, exact_first)}).collect())  # noqa: E731, B023
            small = find()
            monkeypatch.setattr(lookup, "MAX_PAIRS", -1)
            assert find() == small
            monkeypatch.undo()
        q, n = (df.withColumn("__k", norm(F.col(c))) for df, c in ((queries.where("trim(q) <> ''").select(F.col("q").alias("__q")), "__q"), (dim.where("trim(name) <> ''").select(F.col("name").alias("__name")), "__name")))
        want = q.join(n.withColumnRenamed("__k", "__n"), fuzzy(F.col("__q"), F.col("__name"))).select("__q", "__name").collect()
        assert {tuple(r) for r in lookup.pairs(q.select("__q"), n.select("__name"), fuzzy, norm).select("__q", "__name").collect()} == {tuple(r) for r in want}


def test_large_lookups_compare_no_pairs_of_names(spark):
    """Names with a common beginning of 14 characters: as many rows meet as are near."""
    names = spark.range(2000).select(F.format_string("Supplier#%09d", "id").alias("__name"))
    asked = names.select(F.expr("substring(__name, 1, 17)").alias("__q")).distinct()
    met = lookup.pairs(asked, names, lookup.by_score, text.norm_kana)
    assert met.count() == 2000 and "contains" not in met._jdf.queryExecution().executedPlan().toString().lower()


def test_large_tables_do_not_pass_through_the_driver(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = horses.horses(spark, sf)
    monkeypatch.setattr(horses, "BROADCAST_BYTES", 0)
    many = horses.horses(spark, sf)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3 and "Broadcast" not in plan.split("ShuffledHashJoin", 1)[0] and "p_partkey" not in "".join(line for line in plan.split("\n") if "BroadcastExchange" in line)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_large_orders_do_not_pass_through_the_driver(spark, monkeypatch):
    """Sized by the two columns that a rank build reads, orders seem small where their hash takes 50 bytes a row."""
    monkeypatch.setattr(horses, "BROADCAST_BYTES", 0)
    plan = horses.horses(spark, "/root/testdata/sf0.001").select("id", "owner", "prize")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin [l_orderkey" in plan


def test_crosses_of_many_offers_are_not_broadcast(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = sorted(map(str, registry.full_offers(spark, sf).select("id", "cross_record").collect()))
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 40)
    many = registry.full_offers(spark, sf).select("id", "cross_record")
    joins = [line for line in many._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [trainer_q" in line and "family_q" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
    assert sorted(map(str, many.collect())) == few
