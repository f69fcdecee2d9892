"""Scores, ranks and decision points of offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import rules as R
from tallyworks.functions import text as X
from tallyworks.operators import lookup
from tallyworks.operators.place import placed


def bonus(grade: Column, table: dict[str, float] = R.BONUS) -> Column:
    return F.coalesce(*[F.when(grade == g, F.lit(v)) for g, v in table.items()], F.lit(0.2))


def family_points(overall: Column, club: Column, unique: Column, unique_grade: Column, rules: R.Rules = R.DEFAULT) -> Column:
    """The only score there is, or the weighted one of both, plus the bonus of an own family; a zero or missing score counts the default."""
    score = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(rules.family_default))
    base = F.when(overall.isNotNull() & club.isNotNull(), rules.overall_weight * score(overall) + rules.club_weight * score(club)).when(overall.isNotNull() | club.isNotNull(), score(F.coalesce(overall, club)))
    extra = F.when(overall.isNotNull() & F.coalesce(unique, F.lit(False)), bonus(F.coalesce(unique_grade, F.lit("C")), rules.unique_bonus)).otherwise(0.0)
    return F.coalesce(F.round(base + extra, 2), F.lit(0.0))


def scored(offers: DataFrame, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Total score of offers that carry family_pts, trainer_pts, cross_grade, sire_score, text, weight, price and status."""
    price = F.coalesce(F.col("price"), F.lit(0.0))
    cross = F.when(F.col("cross_grade").isNotNull(), bonus(F.col("cross_grade"), rules.cross_bonus)).otherwise(0.0)
    out = offers.withColumn("cross_pts", cross).withColumn("condition_pts", R.condition_score(F.col("text"), F.col("weight"), rules)).withColumn("price_pts", R.tiered(price, rules.price_scores, -1.0))
    total = F.least(F.lit(rules.max_score), F.col("family_pts") + F.col("trainer_pts") + F.col("cross_pts") + F.col("sire_score") + F.col("condition_pts") + F.col("price_pts"))
    out = out.withColumn("total", F.round(total, 2)).withColumn("skip_flags", R.skip_flags(F.col("status"), price, rules))
    return out.withColumn("eligible", F.size("skip_flags") == 0).withColumn("units", R.units(F.col("total"), price, rules))


def recorded(scored_offers: DataFrame, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """What a score is made of, beside total, flags and units: ``breakdown``, and the records of family, cross and condition.

    Takes the columns of ``scored`` and those of its lookups: overall_grade and its
    rank, the club's, the own grade and rank, ``cross_record``, and where family and trainer came from.
    """
    c, two = F.col, lambda x: F.round(c(x), 2)
    by_name = F.trim(F.coalesce("family_q", F.lit(""))) != ""
    found = c("family_grade").isNotNull() | c("club_grade").isNotNull()
    unique = F.coalesce(c("club_unique"), F.lit(False)) & by_name
    breakdown = F.struct(
        two("family_pts").alias("family"), two("trainer_pts").alias("trainer"), "trainer_grade", F.when(c("trainer_from_ranks"), "db").otherwise("yaml").alias("trainer_source"),
        two("cross_pts").alias("cross"), two("sire_score").alias("sire"), two("condition_pts").alias("condition"), two("price_pts").alias("price"),
    )
    family = F.struct(
        F.when(~by_name, "label").when(found, "db").otherwise("none").alias("source"), F.when(~by_name, c("label")).alias("label"), unique.alias("unique"), F.when(unique, c("unique_grade")).alias("unique_grade"), F.when(unique, c("own_rank")).alias("unique_rank"),
        c("family_grade").alias("overall_grade"), "overall_rank", "club_grade", "club_rank",
    )
    condition = F.struct(R.hits(c("text"), c("weight"), rules).alias("hits"), c("weights").alias("weights_kg"))
    return scored_offers.withColumns({"breakdown": breakdown, "family_record": family, "condition_record": condition, "recommend_units": R.units_text(c("units")), "max_score": F.lit(rules.max_score)})


def ranked(offers: DataFrame, only_eligible: bool = False, pool: str = "pool") -> DataFrame:
    """Rank and label within each pool: total descending, then name; of offers that share both, eligible ones come first. A pool isn't sorted in one task."""
    rows = offers.where("eligible") if only_eligible else offers
    rows = rows.withColumn(pool, F.coalesce(F.nullif(F.col(pool), F.lit("")), F.lit("default")))
    rows = placed(rows, [pool], [F.desc_nulls_last(F.round(F.col("total") * 100).cast("long")), F.col("name"), F.desc("eligible")]).withColumn("rank", F.col("place").cast("int")).drop("place", "of")
    label = F.when(~F.col("eligible"), "見送り").when(F.col("rank") == 1, "本命").when(F.col("rank") == 2, "控え").otherwise(F.concat(F.col("rank").cast("string"), F.lit("位")))
    return rows.withColumn("label", label)


def combos(unique: Column, trainer: Column, cross: Column, overall: Column, tier: Column, price: Column, signature: Column, lenient: bool = False) -> Column:
    """The ids of the combinations that hold; ``lenient``: C4 also for an unknown family."""
    s, weak = R.strong, F.coalesce(overall, F.lit("none")).isin("B", "C", "none", *(["U"] if lenient else []))
    found = [
        F.when(s(unique) & s(trainer), F.lit("C1")), F.when(s(cross), F.lit("C2")), F.when(s(overall) & (tier == "top") & (price <= 2.0), F.lit("C3")),
        F.when(s(signature) & weak, F.lit("C4")), F.when((price >= 2.5) & ~s(cross) & ~s(unique), F.lit("C5")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def decided(offers: DataFrame, variant: str = "canonical", rules: R.Rules = R.DEFAULT, condition: Column | None = None, hard: Column | None = None) -> DataFrame:
    """Points, combinations and verdict of offers with grades.

    ``canonical`` and ``tool`` share their point tables and differ in C4; for
    them ``condition`` and ``hard`` replace what the condition text gives.
    ``legacy`` has tables of its own, whatever the rules, and adds points for combinations.
    """
    c = F.col
    price = F.coalesce(c("price"), F.lit(0.0))
    if variant == "legacy":
        t = R.LEGACY_POINTS
        price_pts = F.coalesce(legacy_price_points(c("price")), F.lit(0))
        hard = F.coalesce(F.when(c("status") == R.SOLD_OUT, F.lit("満口・募集終了")), F.when(c("price") > 4.0, F.lit("一口4万超は即PASS")))
        ids = F.filter(
            F.array(
                F.when(R.strong(c("unique_grade")) & R.strong(c("trainer_grade")), F.lit("C1")), F.when(R.strong(c("cross_grade")), F.lit("C2")), F.when(R.strong(c("family_grade")) & (c("sire_tier") == "top") & (c("price") <= 2.0), F.lit("C3")),
                F.when(R.strong(c("signature_grade")), F.lit("C4")), F.when((c("price") >= 2.5) & ~R.strong(c("unique_grade")) & ~R.strong(c("cross_grade")), F.lit("C5")),
            ),
            lambda x: x.isNotNull(),
        )
        extra = F.aggregate(ids, F.lit(0), lambda a, x: a + F.when(x == "C5", -2).when(x == "C4", 1).otherwise(2))
        light = F.coalesce(((c("weight") > 0) & (c("weight") <= R.LIGHT_KG)).cast("int"), F.lit(0))
        condition = -light
    else:
        t, extra = rules.points, F.lit(0)
        price_pts = R.tiered(price, rules.price_points, -2)
        hard = R.hard_pass(c("status"), price, c("text"), rules) if hard is None else hard
        ids = combos(c("unique_grade"), c("trainer_grade"), c("cross_grade"), c("family_grade"), c("sire_tier"), price, c("signature_grade"), variant == "tool")
        condition = R.condition_points(c("text"), c("weight"), rules) if condition is None else condition
    parts = [R.points(t[k], c(g), variant == "canonical") for k, g in (("family", "family_grade"), ("unique", "unique_grade"), ("signature", "signature_grade"), ("trainer", "trainer_grade"), ("cross", "cross_grade"), ("sire", "sire_tier"))]
    out = offers.withColumn("combos", ids).withColumn("points", (sum(parts, F.lit(0)) + price_pts + condition + extra).cast("int")).withColumn("hard", hard)
    return out.withColumn("verdict", R.verdict(c("points"), c("hard"), R.DEFAULT if variant == "legacy" else rules))


def by_hand(offers: DataFrame, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Decisions on offers whose grades may be set by hand: ``overall_set``, ``unique_set`` and ``cross_set`` win over what the lookups found; null or ``auto`` leaves it.

    A family that isn't found takes the grade of its alias (``manual``), else U, or
    none where no name was given; the own grade is the found one if the family is the
    club's own, else that of the alias. Without a signature of its own an offer takes the
    grade of the line that its alias suggests (``suggested``). A trainer who isn't known is
    U, or none without a name. ``state`` (good, mild) and ``injury`` stand for the condition text.
    """
    c, none = F.col, F.lit("none")
    chosen = lambda col, found: F.coalesce(F.when(c(col) != "auto", c(col)), found)
    unnamed = lambda col: F.when(F.coalesce(c(col), F.lit("")) == "", none).otherwise("U")
    graded = {
        "family_grade": chosen("overall_set", F.coalesce("family_grade", "manual", unnamed("family_q"))),
        "unique_grade": chosen("unique_set", F.when(c("family_grade").isNotNull() & F.coalesce(c("club_unique"), F.lit(False)), F.coalesce("unique_grade", none)).otherwise(F.coalesce("manual", none))),
        "cross_grade": chosen("cross_set", F.coalesce("cross_grade", none)),
        "signature_grade": F.coalesce("signature_grade", "suggested", none),
        "trainer_grade": F.when(c("trainer_known"), c("shown_grade")).otherwise(unnamed("trainer_q")),
    }
    state = F.when(c("state") == "good", 1).when(c("state") == "mild", -1).otherwise(0)
    light = F.coalesce((c("weight") <= rules.light_kg).cast("int"), F.lit(0))
    risk = next(reason for name, _, _, reason in rules.hard_pass if name == "text")
    hard = F.coalesce(R.hard_pass(c("status"), F.coalesce(c("price"), F.lit(0.0)), F.lit(""), rules), F.when(c("injury"), F.lit(risk)))
    return decided(offers.withColumns(graded), "tool", rules, state - light, hard)


def legacy_price_points(price: Column) -> Column:
    """Points of a price on the older page; null where the price rules the offer out."""
    return F.when(price.isNull(), 0).when(price > R.MAX_PRICE, None).when(price <= 2.0, 2).when(price < 2.5, 1).when(price <= 3.5, 0).otherwise(-1)


def legacy_units(verdict: Column, price: Column) -> Column:
    return F.when(verdict == "GO", F.when(price <= 2.0, 2).otherwise(1)).when(verdict == "HOLD", 1).otherwise(0)


def legacy_family(matched: Column, stated: Column) -> tuple[Column, Column]:
    """The older page's (unique, overall) grades: an unmatched family is C as an own one; a stated overall grade wins, else it follows the matched one, else it is U."""
    return F.coalesce(matched, F.lit("C")), F.coalesce(stated, matched, F.lit("U"))


def card() -> Column:
    """A decided offer in one line: verdict and points, the reason that rules it out, the combinations."""
    parts = [F.concat_ws(" ", "verdict", F.col("points").cast("string")), F.col("hard"), F.when(F.size("combos") > 0, F.array_join("combos", ","))]
    return F.concat_ws(" / ", *parts)


def weight_band(kg: Column, low: Column, high: Column) -> Column:
    return F.when(kg > high, "上限注意").when(kg < low, "下限注意").when((kg <= R.LIGHT_KG) | (kg >= 520), "警戒線付近").otherwise("OK帯")


def banded(offers: DataFrame, trainer: str, sire: str, trainer_bands: DataFrame, sire_bands: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """Each offer with what the profiles allow that its trainer's band and its sire's name.

    Bands are (name, ord, profile): the first by ``ord`` whose name scores 60 or more
    counts, be there an equal one later or not. ``profiles`` (profile, low, high) is a rule table. ``low`` is the largest, ``high`` the least
    of the profiles named, each once; without any, those of the default one. Adds trainer_band, sire_band, profiles, low, high.
    """
    listings = {side: lookup.Listing(bands, "name", "ord", ["profile"], lookup.by_score, X.norm_kana, exact_first=False) for side, bands in (("trainer", trainer_bands), ("sire", sire_bands))}
    asked = offers.select(F.inline(F.array(*[F.struct(F.lit(side).alias("kind"), F.col(c).alias("__q")) for side, c in (("trainer", trainer), ("sire", sire))])))
    found = lookup.found_of_kinds(asked, listings)
    rows = offers
    for side, c in (("trainer", trainer), ("sire", sire)):
        rows = rows.join(found[side].select(F.col("__q").alias(c), F.col(side).alias(f"__{side}")), c, "left")
    limits = F.broadcast(profiles.agg(F.map_from_entries(F.collect_list(F.struct("profile", F.struct("low", "high")))).alias("__limits")))
    named = F.filter(F.array_sort(F.array_distinct(F.array("__trainer.profile", "__sire.profile"))), lambda x: x.isNotNull())
    picked = F.when(F.size(named) == 0, F.array(F.lit(default))).otherwise(named)
    rows = rows.join(limits).withColumn("__picked", picked).withColumn("__bands", F.transform("__picked", lambda x: F.element_at("__limits", x)))
    low, high = F.array_max(F.transform("__bands", lambda x: x["low"])), F.array_min(F.transform("__bands", lambda x: x["high"]))
    return rows.select(*[rows[c] for c in offers.columns], F.col("__trainer").alias("trainer_band"), F.col("__sire").alias("sire_band"), F.array_join("__picked", ",").alias("profiles"), low.alias("low"), high.alias("high"))


def weight_judgement(kg: Column, low: Column, high: Column, trainer_band: Column, sire_band: Column, notes: Column) -> Column:
    """A weight in one text: its band, what the profiles allow, the light alert that costs a point, where trainer and sire stand, and what to follow up."""
    asked = F.when(F.coalesce(kg, F.lit(0)) == 0, F.lit("no weight"))
    alert = F.when(kg <= R.LIGHT_KG, F.lit("light_weight -1")).otherwise(F.lit("no light alert"))
    of = lambda side, band: F.concat(F.lit(f"{side} "), F.coalesce(F.concat(band["matched"], F.lit(" "), band["profile"]), F.lit("unassigned")))
    follow = F.when(notes != "", F.concat(F.lit("notes "), notes))
    text = F.concat_ws(" / ", weight_band(kg, low, high), F.concat_ws("-", low.cast("string"), high.cast("string")), alert, of("trainer", trainer_band), of("sire", sire_band), follow)
    return F.coalesce(asked, text)


def detail(id_col: str = "id", rules: R.Rules = R.DEFAULT) -> list[Column]:
    """A decided offer as a text report: one line of verdict and points, one for each graded component, the combinations, the reason that rules it out."""
    cols = {"family": "family_grade", "unique": "unique_grade", "signature": "signature_grade", "trainer": "trainer_grade", "cross": "cross_grade", "sire": "sire_tier"}
    lines = [F.concat_ws(" ", F.lit(k), F.coalesce(F.col(c), F.lit("none")), R.points(rules.points[k], F.col(c)).cast("string")) for k, c in cols.items()]
    combos = F.when(F.size("combos") > 0, F.concat(F.lit("combos "), F.array_join("combos", ",")))
    return [F.col(id_col), F.concat_ws("\n", F.concat_ws(" ", "verdict", F.col("points").cast("string")), *lines, combos, F.concat(F.lit("pass "), F.col("hard"))).alias("report")]
