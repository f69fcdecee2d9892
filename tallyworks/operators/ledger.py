"""An income and expense ledger, and the candidate store's updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import text as X


def totals(entries: DataFrame, opening: int | None) -> DataFrame:
    """Income, expense (anything that isn't income), rows, and the balance if there is an opening amount."""
    income = F.coalesce(F.sum(F.when(F.col("type") == "income", F.col("amount"))), F.lit(0)).cast("long")
    expense = F.coalesce(F.sum(F.when(F.coalesce(F.col("type") == "income", F.lit(False)), None).otherwise(F.col("amount"))), F.lit(0)).cast("long")
    sums = entries.agg(income.alias("income"), expense.alias("expense"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("balance", F.lit(opening).cast("long") + F.col("income") - F.col("expense"))


def validated(raw: DataFrame) -> DataFrame:
    """``amount`` from ``amount_text`` rounded, and ``reason``: null for a good entry (date and name there, a finite amount above 0)."""
    value = X.amount(F.col("amount_text"))
    reason = F.when(F.col("date").isNull(), "date").when(F.trim(F.coalesce("name", F.lit(""))) == "", "name").when(value.isNull() | (value <= 0), "amount")
    return raw.withColumn("amount", X.half_up(value)).withColumn("reason", reason)


def validated_opening(raw: DataFrame) -> DataFrame:
    """An opening amount needs a date and a finite amount, which may be zero or negative."""
    value = X.amount(F.col("amount_text"))
    reason = F.when(F.col("date").isNull(), "date").when(value.isNull(), "amount")
    return raw.withColumn("amount", X.half_up(value)).withColumn("reason", reason)


def listed(entries: DataFrame, kind: str = "all") -> DataFrame:
    rows = entries if kind == "all" else entries.where(F.col("type") == kind)
    return rows.orderBy(F.desc("date"), F.desc("created_at"))


def without(entries: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return entries.join(ids, key, "left_anti")


def merged(updates: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """One update for each key: of each field, the value of the last update in ``order`` that carries it."""
    carried = lambda f: F.coalesce(F.col(f"has_{f}"), F.lit(False))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    last = [F.max_by(F.when(carried(f), F.struct(f)), F.when(carried(f), place)).alias(f"__{f}") for f in fields]
    return updates.groupBy(key).agg(*last).select(key, *[F.col(f"__{f}.{f}").alias(f) for f in fields], *[F.col(f"__{f}").isNotNull().alias(f"has_{f}") for f in fields])


def upserted(store: DataFrame, updates: DataFrame, key: str, fields: list[str], strict: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Updates replace the fields that they carry (``has_<field>``), even by empty values; new keys are added; blank keys are left out or, if ``strict``, an error.

    Updates of one key are merged first: later ones in ``order`` win, field by field;
    without an order, the largest value of a field does.
    """
    unkeyed = X.blank(F.col(key).cast("string"))
    good = updates.withColumn(key, F.when(unkeyed, F.raise_error(F.lit(f"{key} is needed"))).otherwise(F.col(key))) if strict else updates.where(~unkeyed)
    flagged = good.withColumns({f"has_{f}": F.lit(False) for f in fields if f"has_{f}" not in good.columns})
    s, u = store.alias("s"), merged(flagged, key, fields, order or [F.col(f) for f in fields]).alias("u")
    pick = lambda f: F.when(F.coalesce(F.col(f"u.has_{f}"), F.lit(False)), F.col(f"u.{f}")).otherwise(F.col(f"s.{f}")).alias(f)
    return s.join(u, F.col(f"s.{key}") == F.col(f"u.{key}"), "full_outer").select(F.coalesce(f"s.{key}", f"u.{key}").alias(key), *[pick(f) for f in fields])


def latest(store: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """The store with ``latest``, the text of each record's last report (by ``at``, then text), and ``n_reports``: one aggregate over a log, no array on the way."""
    last = reports.groupBy(key).agg(F.max_by("text", F.struct("at", "text")).alias("__last"), F.count(F.lit(1)).alias("__n"))
    rows = store.join(last, key, "left")
    kept = F.col("latest") if "latest" in store.columns else F.lit(None).cast("string")
    return rows.withColumns({"latest": F.when(F.col("__n").isNotNull(), F.col("__last")).otherwise(kept), "n_reports": F.coalesce("__n", F.lit(0))}).drop("__last", "__n")


def appended(store: DataFrame, reports: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Appends reports (key, at, text, note) to ``history`` in the order of ``at`` and sets ``latest``; reports of a missing key are left out or, if ``strict``, an error."""
    new = reports.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "text", "note"))).alias("__new"))
    rows = store.withColumn("__here", F.lit(True)).join(new, key, "full_outer" if strict else "left")
    if strict:
        rows = rows.withColumn(key, F.when(F.col("__here").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string")))).otherwise(F.col(key)))
    rows = rows.drop("__here")
    history = F.concat(F.coalesce("history", F.array().cast("array<struct<at:string,text:string,note:string>>")), F.coalesce("__new", F.array().cast("array<struct<at:string,text:string,note:string>>")))
    return rows.withColumn("latest", F.when(F.col("__new").isNotNull(), F.element_at("__new", -1)["text"]).otherwise(F.col("latest"))).withColumn("history", history).drop("__new")


def any_contains(query: str, cells: list[Column]) -> Column:
    """A row filter: a blank query keeps all."""
    return F.lit(query.strip() == "") | F.lower(F.concat_ws(" ", *cells)).contains(query.strip().lower())


def added(entries: DataFrame, raw: DataFrame, now: Column | None = None) -> DataFrame:
    """The entries and those of ``raw`` that are valid, each with an id of its own and the time of entry in ms."""
    good = validated(raw).where("reason IS NULL").drop("reason", "amount_text")
    made = (now if now is not None else F.unix_millis(F.current_timestamp())).cast("long")
    good = good.withColumn("id", F.uuid()).withColumn("created_at", made)
    return entries.unionByName(good.select(*[F.col(c).cast(entries.schema[c].dataType) for c in entries.columns]))


def cleared(state: DataFrame) -> DataFrame:
    """Ledger states without their entries; the opening stays."""
    return state.withColumn("entries", F.array().cast(state.schema["entries"].dataType))
