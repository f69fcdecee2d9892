"""Rule tables and the expressions made of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules that scores and points follow.
PRICE_SCORES = [(1.0, 1.5), (1.5, 1.0), (2.0, 0.5), (2.5, 0.0), (3.0, -0.5), (99.0, -1.0)]
PRICE_POINTS = [(1.5, 2), (2.0, 1), (2.5, 0), (3.0, -1), (99.0, -2)]
POSITIVE = [("順調", 0.4), ("良化", 0.3), ("増体", 0.2), ("快調", 0.3), ("併せ馬", 0.2)]
NEGATIVE = [("休養", -0.5), ("骨折", -1.5), ("跛行", -1.0), ("気になる", -0.3), ("停滞", -0.4), ("減量", -0.3)]
MILD = ["停滞", "減量", "気になる", "安静", "休養"]
HARD = ["骨折", "跛行", "手術", "予後不良"]
LABEL_SCORES = {"S": 6.0, "A": 4.5, "B": 3.0, "C": 1.5, "unknown": 2.0}
BONUS = {"S": 1.5, "A": 1.0, "B": 0.5, "C": 0.2}
POINTS = {
    "family": {"S": 5, "A": 4, "B": 2, "C": 1, "U": 0, "none": 0},
    "unique": {"S": 3, "A": 2, "B": 1, "C": 0, "none": 0},
    "signature": {"S": 2, "A": 1, "B": 0, "C": 0, "none": 0},
    "trainer": {"S": 4, "A": 3, "B": 2, "C": 1, "U": 0, "none": 1},
    "cross": {"S": 4, "A": 3, "B": 1, "C": 0, "none": 0},
    "sire": {"top": 2, "mid": 1, "low": 0},
}
LEGACY_POINTS = {
    "family": {"S": 4, "A": 3, "B": 1, "C": 0, "U": 0},
    "unique": {"S": 3, "A": 2, "B": 0, "C": 0},
    "signature": {"S": 2, "A": 1, "none": 0},
    "trainer": {"S": 3, "A": 2, "B": 1, "C": -1, "U": 0, "none": 0},
    "cross": {"S": 3, "A": 2, "B": 0, "C": -1},
    "sire": {"top": 2, "mid": 1, "low": 0, "unknown": 0},
}
SOLD_OUT = "満口"
MAX_PRICE, LIGHT_KG, MAX_SCORE, GO, HOLD = 4.0, 420, 22.0, 12, 8
HARD_PASS = [("status", "in", [SOLD_OUT], "満口"), ("price", "gt", MAX_PRICE, "一口4万円超は原則見送り"), ("text", "contains_any", HARD, "近況に重大リスク語")]
# A grade's and a tier's label in Japanese, a short one and a hint.
GRADE_LABELS = {
    "S": ("最上級", "最上級（S）", "本線で強く加点"),
    "A": ("上級", "上級（A）", "有力。積極検討"),
    "B": ("標準", "標準（B）", "材料が揃えばHOLD〜"),
    "C": ("控えめ", "控えめ（C）", "他材料が弱いとPASS寄り"),
    "U": ("データ不足", "データ不足（U）", "標本少なく断定しない"),
    "none": ("未設定", "未設定", "入力なし"),
}
TIER_LABELS = {"top": ("上位", "上位（top）", "ルール値 3.5以上"), "mid": ("中位", "中位（mid）", "ルール値 2.8以上"), "low": ("下位", "下位（low）", "2.8未満・未登録寄り")}


@dataclass(frozen=True)
class Rules:
    """What scores and points follow; ``sources.rules`` makes one of rule documents."""

    price_scores: list = field(default_factory=lambda: PRICE_SCORES)
    price_points: list = field(default_factory=lambda: PRICE_POINTS)
    positive: list = field(default_factory=lambda: POSITIVE)
    negative: list = field(default_factory=lambda: NEGATIVE)
    label_scores: dict = field(default_factory=lambda: LABEL_SCORES)
    unique_bonus: dict = field(default_factory=lambda: BONUS)
    cross_bonus: dict = field(default_factory=lambda: BONUS)
    points: dict = field(default_factory=lambda: POINTS)
    hard_pass: list = field(default_factory=lambda: HARD_PASS)
    skip_status: list = field(default_factory=lambda: [SOLD_OUT])
    skip_price: float = MAX_PRICE
    condition: tuple = (2.0, 0.0, 3.0)
    light_kg: int = LIGHT_KG
    light_delta: float = -0.3
    overall_weight: float = 0.55
    club_weight: float = 0.45
    family_default: float = 2.0
    max_score: float = MAX_SCORE
    go: int = GO
    hold: int = HOLD
    monthly: int = 10_000
    most_units: int = 4


DEFAULT = Rules()


def tiered(c: Column, tiers: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first tier whose limit isn't exceeded."""
    return F.coalesce(*[F.when(c <= limit, F.lit(value)) for limit, value in tiers], F.lit(beyond))


def points(table: dict[str, int], grade: Column, any_case: bool = True) -> Column:
    """The points of a grade, in any case unless told otherwise; those of ``none`` for an unlisted or missing one."""
    key = F.when(grade.isin(*[k for k in table if k != k.upper()]), grade).otherwise(F.upper(grade)) if any_case else grade
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values())))).otherwise(table.get("none", 0))


def sire_tier(score: Column) -> Column:
    return F.when(score >= 3.5, "top").when(score >= 2.8, "mid").otherwise("low")


def grade_order(grade: Column) -> Column:
    """S first, then A, B, C, U and anything else."""
    return F.coalesce(*[F.when(grade == g, i) for i, g in enumerate("SABCU")], F.lit(9))


def labelled(table: dict[str, tuple[str, str, str]], key: Column, part: int = 0) -> Column:
    """The label of a grade or tier (``part`` 1: short, 2: a hint); that of ``none``, if there is one, for any other."""
    return F.coalesce(*[F.when(key == k, F.lit(v[part])) for k, v in table.items()], F.lit(table["none"][part] if "none" in table else None))


def label_score(label: Column, rules: Rules = DEFAULT) -> Column:
    """The score of a family's label, whatever its case; unknown labels count 2."""
    key = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(*[F.when(key == k.upper(), F.lit(v)) for k, v in rules.label_scores.items()], F.lit(rules.label_scores["unknown"]))


def strong(grade: Column) -> Column:
    return F.coalesce(grade.isin("S", "A"), F.lit(False))


def hits(text: Column, weight: Column, rules: Rules = DEFAULT) -> Column:
    """The keywords that a condition text holds, as +word and -word, and light_weight:kg."""
    t = F.coalesce(text, F.lit(""))
    named = [F.when(t.contains(k), F.lit(f"{'+' if d > 0 else '-'}{k}")) for k, d in rules.positive + rules.negative]
    light = F.when(weight <= rules.light_kg, F.concat(F.lit("light_weight:"), weight.cast("string")))
    return F.filter(F.array(*named, light), lambda x: x.isNotNull())


def condition_score(text: Column, weight: Column, rules: Rules = DEFAULT) -> Column:
    """The base plus the deltas of all keywords and of a light weight, within its bounds."""
    t = F.coalesce(text, F.lit(""))
    base, low, high = rules.condition
    total = sum((F.when(t.contains(k), F.lit(d)).otherwise(F.lit(0.0)) for k, d in rules.positive + rules.negative), F.lit(base))
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), total + F.when(weight <= rules.light_kg, F.lit(rules.light_delta)).otherwise(F.lit(0.0)))), 4)


def condition_points(text: Column, weight: Column, rules: Rules = DEFAULT) -> Column:
    t = F.coalesce(text, F.lit(""))
    any_of = lambda names: reduce(lambda a, b: a | b, [t.contains(k) for k in names])
    plus = any_of([k for k, _ in rules.positive]).cast("int")
    minus = any_of(MILD + [k for k, _ in rules.negative]).cast("int")
    return F.when(F.trim(t) == "", 0).otherwise(plus - minus - F.coalesce((weight <= rules.light_kg).cast("int"), F.lit(0)))


def hard_pass(status: Column, price: Column, text: Column, rules: Rules = DEFAULT) -> Column:
    """The first reason that rules an offer out; null if none does."""
    of = {"status": status, "price": price, "text": F.coalesce(text, F.lit(""))}
    holds = {
        "in": lambda c, v: c.isin(*v),
        "gt": lambda c, v: c > v,
        "contains_any": lambda c, v: reduce(lambda a, b: a | b, [c.contains(k) for k in v]),
    }
    return F.coalesce(*[F.when(holds[op](of[name], value), F.lit(reason)) for name, op, value, reason in rules.hard_pass], F.lit(None).cast("string"))


def units(total: Column, price: Column, rules: Rules = DEFAULT) -> Column:
    """Recommended units: low and high bound by the score and the monthly budget."""
    most = F.lit(rules.most_units)
    budget = F.greatest(F.lit(1), F.floor(rules.monthly / (F.greatest(price * 10_000, F.lit(1.0)) / 12)).cast("int"))
    high = F.when(total >= 16, F.least(most, F.greatest(F.lit(2), budget))).when(total >= 13, F.least(most, F.greatest(F.lit(1), F.least(F.lit(2), budget)))).otherwise(1)
    return high.cast("int")


def units_text(most: Column) -> Column:
    """Recommended units as readers see them: a range, or one to wait and see."""
    return F.when(most > 1, F.concat(F.lit("1〜"), most.cast("string"), F.lit("口"))).otherwise(F.lit("1口（様子見）"))


def skip_flags(status: Column, price: Column, rules: Rules = DEFAULT) -> Column:
    """What keeps an offer out of the ranks, with the value that does."""
    sold = F.when(status.isin(*rules.skip_status), F.concat(F.lit("status:"), status))
    over = F.when(price > rules.skip_price, F.concat(F.lit("price_over:"), price.cast("string")))
    return F.filter(F.array(sold, over), lambda x: x.isNotNull())


def verdict(total: Column, hard: Column, rules: Rules = DEFAULT) -> Column:
    return F.when(hard.isNotNull(), "PASS").when(total >= rules.go, "GO").when(total >= rules.hold, "HOLD").otherwise("PASS")


def points_table(spark: SparkSession, rules: Rules = DEFAULT) -> DataFrame:
    """The points of the rules, one row for each component and grade."""
    return spark.createDataFrame([(component, grade, pts) for component, table in rules.points.items() for grade, pts in table.items()], "component string, grade string, pts int")


def labels_table(spark: SparkSession) -> DataFrame:
    """The labels of grades and tiers, one row each."""
    rows = [(kind, code, *names) for kind, table in (("grade", GRADE_LABELS), ("tier", TIER_LABELS)) for code, names in table.items()]
    return spark.createDataFrame(rows, "kind string, code string, label string, short string, hint string")
