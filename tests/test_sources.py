"""Documents in and out."""

import json

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.operators import ledger, scoring
from tallyworks.sources import bundle as B
from tallyworks.sources import database
from tallyworks.sources import documents as D
from tallyworks.sources import rules as S


def test_candidates(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"updated_at": "t", "candidates": [{"id": "1", "name": "馬", "price_man_yen": 1.5, "kinjou_history": [{"at": "a", "text": "順調", "note": ""}], "unlisted": 3}, {"id": "2"}]}, indent=1))
    rows = D.read_candidates(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["price_man_yen"]) for r in rows] == [("1", "馬", 1.5), ("2", None, None)] and rows[0]["kinjou_history"][0]["text"] == "順調"
    assert D.read_candidates(spark, str(tmp_path / "none.json")).count() == 0
    D.write_candidates(D.read_candidates(spark, str(path)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("updated_at is not null").count() == 2
    assert sorted(D.read_candidates(spark, str(tmp_path / "out"), lines=True).collect(), key=lambda r: r["id"]) == rows
    assert D.read_candidates(spark, str(tmp_path / "none"), lines=True).count() == 0


def test_ranks(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"trainers": [{"trainer": "t", "grade": "S", "rank": 1, "score": 6.0}, {"trainer": "u", "grade": "U"}], "families": []}))
    rows = D.read_ranks(spark, str(path), "trainers")
    assert {(r["trainer"], r["grade"], r["rank"]) for r in rows.collect()} == {("t", "S", 1), ("u", "U", None)}
    assert D.read_ranks(spark, str(path), "families").count() == D.read_ranks(spark, str(tmp_path / "none"), "trainers").count() == 0
    D.write_ranks({"trainers": rows}, str(tmp_path / "ranks"))
    assert sorted(D.read_ranks(spark, str(tmp_path / "ranks"), "trainers", lines=True).collect()) == sorted(rows.collect())


def test_bundle(spark, tmp_path):
    tables = {"b": spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string"), "a": spark.createDataFrame([], "k int"), "日本": spark.createDataFrame([(None, "z")], "k int, v string")}
    B.write_bundle(tables, str(tmp_path / "b"))
    B.joined(spark, str(tmp_path / "b"), str(tmp_path / "b.js"))
    text = (tmp_path / "b.js").read_text()
    assert text.startswith("window.CLUB_DATA = {") and text.endswith("};\n")
    assert json.loads(text[len("window.CLUB_DATA = ") : -2]) == {"b": [{"k": 1, "v": "x"}, {"k": 2, "v": "y"}], "a": [], "日本": [{"v": "z"}]}
    for key, df in tables.items():
        assert sorted(B.read_bundle_table(spark, str(tmp_path / "b"), key, df.schema).collect(), key=repr) == sorted(df.collect(), key=repr)
    with pytest.raises(KeyError):
        B.read_bundle_table(spark, str(tmp_path / "b"), "none", tables["a"].schema)


def test_bundle_of_many_rows(spark, tmp_path):
    rows = spark.range(0, 300_000, 1, 8).select("id", F.concat(F.lit('"a,'), F.col("id").cast("string")).alias("v"))
    files = B.write_bundle({"many": rows}, str(tmp_path / "b"))
    assert len([f for f in files if "-rows/" in f]) > 1  # no task held the table
    B.joined(spark, str(tmp_path / "b"), str(tmp_path / "b.js"))
    with open(tmp_path / "b.js", encoding="utf-8") as f:
        back = json.loads(f.read()[len("window.CLUB_DATA = ") : -2])["many"]
    assert back == [{"id": i, "v": f'"a,{i}'} for i in range(300_000)]


def test_ledger_states(spark, tmp_path):
    states = spark.createDataFrame([('{"opening":{"amount":5,"date":"2024-01-01"},"entries":[{"id":"1","amount":7}]}',), ("{bad",), (None,)], "s string")
    rows = states.select(D.entries_from_json(F.col("s")).alias("e")).collect()
    assert [len(r["e"]["entries"] or []) for r in rows] == [1, 0, 0] and rows[0]["e"]["opening"]["amount"] == 5
    entries = spark.createDataFrame([(i, i * 10) for i in range(20)], "id long, amount long")
    assert sorted(D.save_entries(entries, str(tmp_path / "e")).collect()) == sorted(entries.collect())


def test_ranks_index_and_cache(spark, tmp_path):
    path = str(tmp_path / "ranks")
    of = lambda grade: spark.createDataFrame([("t", grade, 1), ("u", "U", None)], "trainer string, grade string, rank long")
    D.write_ranks({"trainers": of("S")}, path, {"trainers": ["trainer", "grade"]})
    assert [tuple(r) for r in spark.read.json(f"{path}/index/trainers").select("trainer", "grade").collect()] == [("t", "S")]
    assert spark.read.json(f"{path}/meta").where("generated_at is not null").count() == 1
    grade = lambda: D.cached_ranks(spark, path, "trainers", lines=True).where("rank = 1").first()["grade"]
    assert grade() == "S" and D.cached_ranks(spark, path, "trainers", lines=True) is D.cached_ranks(spark, path, "trainers", lines=True)
    D.write_ranks({"trainers": of("A")}, path)
    assert grade() == "A"
    # someone who doesn't know the library writes the files
    folder = tmp_path / "ranks" / "trainers"
    for f in folder.iterdir():
        f.unlink()
    (folder / "part-0.json").write_text(json.dumps({"trainer": "t", "grade": "B", "rank": 1}) + "\n")
    assert grade() == "B"
    (folder / "part-0.json").write_text(json.dumps({"trainer": "someone", "grade": "C", "rank": 1}) + "\n")
    assert grade() == "C"
    D.forget_ranks()


def test_axis_round_trip(spark, tmp_path):
    from tallyworks.plans.reports import axis

    summary = axis(spark, "/root/testdata/sf0.001", 3)
    D.write_axis(summary, str(tmp_path / "axis"))
    back = D.read_axis(spark, str(tmp_path / "axis"))
    assert back.where("generated_at is not null").count() == 1 and back.drop("generated_at").collect() == summary.collect()
    assert D.read_axis(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no owner 999"):
        axis(spark, "/root/testdata/sf0.001", 999).collect()


SCORES = {
    "meta": {"max_score": 9.0}, "db_ranks": {"family_overall_weight": 1.0, "family_hiroo_weight": 0.0, "cross_bonus": {"S": 3.0}}, "broodmare_family": {"S": 7.0, "unknown": 1.0, "default": 1.0},
    "trainers": {"a": {"grade": "S", "score": 5.0}, "b": {"grade": "B", "score": 3}, "default": {"grade": "C", "score": 2.0}}, "sires": {"x": 4.0, "default": 2.0},
    "price_tiers_man_yen": [{"max": 1.0, "score": 9.5}], "kinjou": {"base": 1.0, "positive": [{"keyword": "good", "delta": 0.5}], "negative": [], "weight_light_alert_kg": 400}, "skip_if": {"status_in": ["gone"], "price_over_man_yen": 1.5},
}
CHECKLIST = {"verdict": {"GO": {"min": 3}, "HOLD": {"min": 2}}, "points": {"cross": {"S": 3, "none": 0}, "price_man_yen": [{"max": 1.0, "pts": 1}]}, "hard_pass": [{"field": "status", "in": ["gone"], "reason": "r1"}, {"field": "price_man_yen", "gt": 2.0, "reason": "r2"}]}


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_rules_from_files(spark, tmp_path, kind):
    if kind == "yaml":
        pytest.importorskip("yaml")
    for name, doc in (("s", SCORES), ("c", CHECKLIST)):
        (tmp_path / f"{name}.{kind}").write_text(json.dumps(doc))  # JSON is YAML too
    scores, checklist = (S.read_rules(spark, str(tmp_path / f"{n}.{kind}")) for n in "sc")
    rules = S.rules_of(scores, checklist)
    assert (rules.go, rules.hold, rules.max_score, rules.light_kg, rules.skip_price) == (3, 2, 9.0, 400, 1.5) and rules.points["trainer"]["S"] == 4
    offers = spark.createDataFrame([("open", 0.5, "good", "S"), ("gone", 3.0, "", None), ("open", 3.0, None, "A")], "status string, price double, text string, cross_grade string")
    zero = offers.withColumns({"family_pts": F.lit(0.0), "trainer_pts": F.lit(0.0), "sire_score": F.lit(0.0), "weight": F.lit(410)})
    rows = scoring.scored(zero, rules).orderBy("price", "status").collect()
    assert [r["total"] for r in rows] == [9.0, 0.0, 0.2]
    assert [(r["cross_pts"], r["condition_pts"], r["price_pts"], r["skip_flags"]) for r in rows] == [(3.0, 1.5, 9.5, []), (0.0, 1.0, -1.0, ["status:gone", "price_over:3.0"]), (0.2, 1.0, -1.0, ["price_over:3.0"])]
    graded = zero.withColumns({c: F.lit(None).cast("string") for c in ("family_grade", "unique_grade", "signature_grade", "sire_tier")}).withColumn("trainer_grade", F.lit("none"))
    rows = scoring.decided(graded, rules=rules).orderBy("price", "status").collect()
    # the first: cross 3, price 1, trainer none 1; no keyword of the condition is among the mild ones
    assert [(r["verdict"], r["hard"]) for r in rows] == [("GO", None), ("PASS", "r1"), ("PASS", "r2")]
    assert S.listed_trainers(spark, scores).orderBy("ord").collect() == [("a", "S", 5.0, 0), ("b", "B", 3.0, 1)] and S.listed_sires(spark, scores).count() == 1
    assert S.rules_of() == S.rules_of({}, {}) and S.rules_of().points == R.DEFAULT.points


def test_strict_updates(spark):
    store = spark.createDataFrame([(1, "a", None, None)], "id int, name string, latest string, history array<struct<at:string,text:string,note:string>>")
    reports = spark.createDataFrame([(1, "t", "x", "n"), (2, "t", "y", "n")], "id int, at string, text string, note string")
    assert [r["latest"] for r in ledger.appended(store, reports, "id").collect()] == ["x"]
    assert ledger.appended(store, reports.where("id = 1"), "id", strict=True).count() == 1
    with pytest.raises(Exception, match="no id 2"):
        ledger.appended(store, reports, "id", strict=True).collect()
    updates = spark.createDataFrame([("1", "b", True), (" ", "c", True)], "id string, name string, has_name boolean")
    assert ledger.upserted(store, updates, "id", ["name"]).count() == 1
    with pytest.raises(Exception, match="id is needed"):
        ledger.upserted(store, updates, "id", ["name"], strict=True).collect()


def test_ledger_added_and_cleared(spark):
    entries = spark.createDataFrame([("1", "2024-01-01", "n", "income", 5, "", 1)], "id string, date string, name string, type string, amount long, memo string, created_at long")
    raw = spark.createDataFrame([("2024-02-01", "fee", "expense", "1,200", "m"), (None, "fee", "expense", "5", ""), ("2024-02-01", " ", "income", "5", "")], "date string, name string, type string, amount_text string, memo string")
    rows = ledger.added(entries, raw, F.lit(7)).orderBy("date").collect()
    assert [(r["name"], r["amount"], r["created_at"]) for r in rows] == [("n", 5, 1), ("fee", 1200, 7)] and rows[1]["id"]
    state = spark.createDataFrame([('{"opening":{"amount":5,"date":"d"},"entries":[{"id":"1"}]}',)], "s string").select(D.entries_from_json(F.col("s")).alias("e")).select("e.*")
    left = ledger.cleared(state).first()
    assert left["entries"] == [] and left["opening"]["amount"] == 5


def test_updates_of_one_id_are_merged(spark):
    store = spark.createDataFrame([("1", "a", "x"), ("3", "c", "z")], "id string, name string, latest string")
    updates = spark.createDataFrame([("1", "b", True, None, False, 1), ("1", "c", True, None, False, 2), ("1", None, False, "", True, 3), ("2", "d", True, "p", True, 2), ("2", "e", True, None, True, 1)], "id string, name string, has_name boolean, latest string, has_latest boolean, at int")
    rows = sorted(map(tuple, ledger.upserted(store, updates, "id", ["name", "latest"], order=[F.col("at")]).collect()))
    assert rows == [("1", "c", ""), ("2", "d", "p"), ("3", "c", "z")]
    again = ledger.upserted(store, updates.drop("has_latest"), "id", ["name", "latest"])
    assert sorted(map(tuple, again.collect())) == [("1", "c", "x"), ("2", "e", None), ("3", "c", "z")]


def test_database_bounds_pushdown_and_configuration(spark, tmp_path):
    """The bundled database: rows come back, in partitions whose bounds it told, and the owner's filter and the columns reach it."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = f"jdbc:derby:{tmp_path}/horses;create=true"
    (tmp_path / "db.json").write_text(json.dumps({"default_connection": "here", "connections": {"here": {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver", "options": {"fetchsize": 7}}, "far": {"host": "h", "database": "d", "user": "u", "password": "p"}}}))
    options = database.read_config(spark, str(tmp_path / "db.json"))
    far = database.read_config(spark, str(tmp_path / "db.json"), "far")
    assert (options["url"], options["fetchsize"]) == (url, "7") and far == {"url": "jdbc:postgresql://h:5432/d", "queryTimeout": "60", "loginTimeout": "10", "user": "u", "password": "p"}
    with pytest.raises(KeyError):
        database.read_config(spark, str(tmp_path / "db.json"), "none")
    rows = spark.range(1, 101).select(F.col("id"), (F.col("id") % 4).cast("string").alias("owner"), F.lit("x").alias("unused"), (F.col("id") * 2).alias("wins"))
    rows.write.format("jdbc").options(**options, dbtable="horses", createTableColumnTypes="owner VARCHAR(10), unused VARCHAR(5)").save()
    rows.limit(0).write.format("jdbc").options(**options, dbtable="nobody").save()
    assert database.bounds(spark, "horses", "id", options) == (1, 100) and database.bounds(spark, "nobody", "id", options) is None
    table = database.read_table(spark, "horses", options, "id", partitions=4)
    assert table.rdd.getNumPartitions() == 4 and sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    assert max(table.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 26
    ours = table.where(F.col("owner") == "3").groupBy("owner").agg(F.sum("wins").alias("wins"))
    assert ours.collect() == [("3", 2550)]
    filters, columns = database.pushed(ours)
    assert "EqualTo(owner,3)" in filters and columns == [["owner", "wins"]]
    assert database.read_table(spark, "nobody", options, "id").count() == 0


def test_dates_of_today(spark):
    import datetime

    day, now = spark.range(1).select(D.today_iso(), D.now_iso()).first()
    assert abs((datetime.date.fromisoformat(day) - datetime.datetime.now(datetime.timezone.utc).date()).days) <= 1 and now[:10] == day and datetime.datetime.fromisoformat(now)


def test_card_of_a_checklist():
    checklist = {"pocket_card": ["first", "second"], "combo_rules": [{"id": "C1", "name": "both", "verdict_hint": "GO", "when": "a AND b"}]}
    assert S.pocket_card(checklist, "card") == "【card】\n\n- first\n- second\n\nコンボ:\n- C1 both: GO（a AND b）"
    assert S.pocket_card({}, "t") == "【t】\n\n\nコンボ:"
