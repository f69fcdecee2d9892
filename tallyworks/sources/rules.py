"""Rules and checklists read from files, so that users change them without code."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tallyworks.functions import rules as R

# The names that the tables of points have in a checklist.
POINT_TABLES = {"family": "family_overall", "unique": "hiroo_unique", "signature": "signature_line", "trainer": "trainer_hiroo", "cross": "cross", "sire": "sire_tier"}
FIELDS = {"status": "status", "price_man_yen": "price", "kinjou_latest": "text"}


def read_rules(spark: SparkSession, path: str) -> dict:
    """A rule document, as JSON or, where PyYAML can be imported, as YAML; read through Spark from any file system."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def rules_of(scores: dict | None = None, checklist: dict | None = None) -> R.Rules:
    """The rules of a score document and a checklist; what they leave out keeps its default."""
    scores, checklist = scores or {}, checklist or {}
    ranks, condition, budget, skip = (scores.get(k) or {} for k in ("db_ranks", "kinjou", "budget", "skip_if"))
    points, limits = checklist.get("points") or {}, checklist.get("verdict") or {}
    given = {}

    def take(name: str, table: dict, key: str, make=lambda v: v) -> None:
        if table.get(key) is not None:
            given[name] = make(table[key])

    words = lambda rows: [(r["keyword"], float(r["delta"])) for r in rows]
    take("max_score", scores.get("meta") or {}, "max_score", float)
    take("overall_weight", ranks, "family_overall_weight", float)
    take("club_weight", ranks, "family_hiroo_weight", float)
    take("family_default", ranks, "family_default", float)
    take("unique_bonus", ranks, "hiroo_unique_bonus")
    take("cross_bonus", ranks, "cross_bonus")
    take("label_scores", scores, "broodmare_family", lambda v: {**R.LABEL_SCORES, **{k: float(s) for k, s in v.items() if k != "default"}})
    take("price_scores", scores, "price_tiers_man_yen", lambda v: [(float(r["max"]), float(r["score"])) for r in v])
    take("positive", condition, "positive", words)
    take("negative", condition, "negative", words)
    given["condition"] = tuple(float(condition.get(k, d)) for k, d in zip(("base", "min", "max"), R.DEFAULT.condition))
    take("light_kg", condition, "weight_light_alert_kg", int)
    take("light_delta", condition, "weight_light_delta", float)
    take("monthly", budget, "default_monthly_yen", int)
    take("most_units", budget, "max_units_per_horse", int)
    take("skip_status", skip, "status_in", list)
    take("skip_price", skip, "price_over_man_yen", float)
    given["points"] = {k: points.get(name) or R.POINTS[k] for k, name in POINT_TABLES.items()}
    take("price_points", points, "price_man_yen", lambda v: [(float(r["max"]), int(r["pts"])) for r in v])
    take("hard_pass", checklist, "hard_pass", lambda v: [(FIELDS[r["field"]], op, r[op], r["reason"]) for r in v for op in ("in", "gt", "contains_any") if op in r])
    take("go", limits.get("GO") or {}, "min", int)
    take("hold", limits.get("HOLD") or {}, "min", int)
    return replace(R.DEFAULT, **given)


def pocket_card(checklist: dict, title: str = "ポケット判定カード") -> str:
    """The checklist's card as text: its lines, then its combination rules with their hint and condition."""
    lines = [f"【{title}】", "", *[f"- {x}" for x in checklist.get("pocket_card") or []], "", "コンボ:"]
    return "\n".join([*lines, *[f"- {c.get('id')} {c.get('name')}: {c.get('verdict_hint')}（{c.get('when')}）" for c in checklist.get("combo_rules") or []]])


def listed_trainers(spark: SparkSession, scores: dict) -> DataFrame:
    """The trainers of a score document in its order: name, grade, score, ord; its default is none of them."""
    rows = [(n, v["grade"], float(v["score"]), i) for i, (n, v) in enumerate((scores.get("trainers") or {}).items()) if n != "default"]
    return spark.createDataFrame(rows, "name string, grade string, score double, ord int")


def listed_sires(spark: SparkSession, scores: dict) -> DataFrame:
    """The sires of a score document in its order: name, score, ord; its default is none of them."""
    rows = [(n, float(v), i) for i, (n, v) in enumerate((scores.get("sires") or {}).items()) if n != "default"]
    return spark.createDataFrame(rows, "name string, score double, ord int")
