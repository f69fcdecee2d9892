"""Values worked out by hand from the rules, so that a wrong rule value fails."""

from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.functions import text as X
from tallyworks.operators import scoring

# id, label, trainer, sire, text, price, status, pool -> total, units, eligible
CANDIDATES = [
    ("1", "A", 4.0, 4.0, "順調。今朝452kg。併せ馬快調。", 1.8, "募集中", "young", 15.9, "1〜2口", True),
    ("2", "B", 3.5, 3.0, "", 1.8, "募集中", "young", 12.0, "1口（様子見）", True),
    ("4", "A", 2.8, 2.0, "", 2.0, "募集中", "young", 11.8, "1口（様子見）", True),
    ("8", "S", 4.5, 3.8, "", 2.4, "募集中", "old", 16.3, "1〜4口", True),
    ("5", "A", 3.0, 3.0, "", 1.8, "募集中", "old", 13.0, "1〜2口", True),
    ("6", "B", 4.0, 2.0, "", 2.0, "募集中", "old", 11.5, "1口（様子見）", True),
    ("3", "A", 3.8, 2.0, "", 2.4, "満口", "young", 12.3, "1口（様子見）", False),
]


def scored(spark):
    df = spark.createDataFrame([c[:8] for c in CANDIDATES], "name string, label string, trainer_pts double, sire_score double, text string, price double, status string, pool string")
    weights = X.weights(F.col("text"))
    rows = df.withColumns({"family_pts": R.label_score(F.col("label")), "cross_grade": F.lit(None).cast("string"), "weights": weights, "weight": F.array_min(weights)})
    return scoring.scored(rows)


def test_totals_units_and_flags(spark):
    got = {r["name"]: r for r in scored(spark).withColumn("told", R.units_text(F.col("units"))).collect()}
    for name, *_, total, units, eligible in CANDIDATES:
        assert (got[name]["total"], got[name]["told"], got[name]["eligible"]) == (total, units, eligible)
    assert got["1"]["condition_pts"] == 2.9 and got["3"]["skip_flags"] == ["status:満口"]
    over = scored(spark).withColumn("price", F.lit(4.5)).select(R.skip_flags(F.col("status"), F.col("price")).alias("f")).collect()
    assert {tuple(r["f"]) for r in over} == {("price_over:4.5",), ("status:満口", "price_over:4.5")}


def test_labels_of_the_pools(spark):
    label = lambda eligible: {(r["pool"], r["rank"]): (r["name"], r["label"]) for r in scoring.ranked(scored(spark), eligible).collect()}
    assert label(True) == {("young", 1): ("1", "本命"), ("young", 2): ("2", "控え"), ("young", 3): ("4", "3位"), ("old", 1): ("8", "本命"), ("old", 2): ("5", "控え"), ("old", 3): ("6", "3位")}
    every = label(False)
    assert [every["young", k] for k in (1, 2, 3, 4)] == [("1", "本命"), ("3", "見送り"), ("2", "3位"), ("4", "4位")]


DEMO = {"status": "募集中", "price": 2.2, "weight": 417, "text": "", "sire_tier": "top", "family_grade": "S", "unique_grade": "S", "signature_grade": "none", "trainer_grade": "A", "cross_grade": "B"}


def one(spark, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", type(None): "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def test_older_page_s_decision(spark):
    row = scoring.decided(one(spark, **DEMO), "legacy").select("*", scoring.legacy_units(F.col("verdict"), F.col("price")).alias("units")).first()
    assert (row["points"], row["verdict"], row["combos"], row["units"]) == (13, "GO", ["C1"], 1)


def test_browser_s_decision(spark):
    asked = {"family_q": "alias", "trainer_q": "t", "trainer_known": True, "shown_grade": "S", "club_unique": False, "manual": "S", "suggested": "S", "overall_set": None, "unique_set": None, "cross_set": "auto", "state": None, "injury": False}
    row = scoring.by_hand(one(spark, **{**DEMO, "family_grade": None, "unique_grade": None, "signature_grade": None, "cross_grade": None}, **asked)).first()
    assert (row["points"], row["verdict"], row["combos"]) == (15, "GO", ["C1"])


def test_grades_in_any_case(spark):
    df = spark.createDataFrame([("s",), ("S",), ("none",), ("x",), (None,), ("u",)], "g string")
    assert [r[0] for r in df.select(R.points(R.POINTS["trainer"], F.col("g"))).collect()] == [4, 4, 1, 1, 1, 0]
    assert [r[0] for r in spark.createDataFrame([("top",), ("mid",), ("TOP",)], "g string").select(R.points(R.POINTS["sire"], F.col("g"))).collect()] == [2, 1, 0]
    lower = one(spark, **{**DEMO, "family_grade": "s"})
    assert scoring.decided(lower).first()["points"] - scoring.decided(lower, "tool").first()["points"] == 5


def test_weights_of_a_text(spark):
    assert one(spark, t="452kg 0417 kg 1420kg 380.5 KG").select(X.weights(F.col("t"))).first()[0] == [452, 380]


def test_first_band_that_scores_sixty_wins_over_a_later_equal_one(spark):
    bands = lambda *names: spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(names)], "name string, ord int, profile string")
    profiles = spark.createDataFrame([("light", 405, 470), ("heavy", 430, 500), ("default", 420, 480)], "profile string, low int, high int")
    rows = spark.createDataFrame([("a", "x"), ("none", "y"), ("", None), ("none", "none")], "t string, s string")
    got = scoring.banded(rows, "t", "s", bands(("ab", "light"), ("a", "heavy")), bands(("x y", "heavy")), profiles, "default")
    assert {(r["t"], r["s"]): (r["profiles"], r["low"], r["high"], (r["trainer_band"] or {"matched": None})["matched"]) for r in got.collect()} == {
        ("a", "x"): ("heavy,light", 430, 470, "ab"), ("none", "y"): ("heavy", 430, 500, None), ("", None): ("default", 420, 480, None), ("none", "none"): ("default", 420, 480, None),
    }


def test_a_weight_without_bands_says_so(spark):
    rows = spark.createDataFrame([(450, None, ("ab", "light"))], "kg int, t struct<matched: string, profile: string>, s struct<matched: string, profile: string>")
    told = scoring.weight_judgement(F.col("kg"), F.lit(430), F.lit(500), F.col("t"), F.col("s"), F.lit(""))
    assert rows.select(told).first()[0] == "OK帯 / 430-500 / no light alert / trainer unassigned / sire ab light"
