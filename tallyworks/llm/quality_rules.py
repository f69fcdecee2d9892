"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets the base counts. For each (lang, source) the sketch of a
ratio counts its rows by logarithmic buckets, which gives every quantile within
1 % of its value; sketches merge by adding counts, per language and over all.
Each document's step of a ratio, by how much one more sign, window or line would move it, is sketched beside
it. The upper fence of a group is its upper quartile and multiples of its own
quartile distance and of its median step: what a group's texts vary by, and what can be told
apart in texts of their length. No fence holds a value set beforehand. It is blended with that of its language, and the
language's with that of all rows, the less so the more rows there are, and
decides whether the document is kept. Documents that the base rule fails aren't sketched. Counts are exact sums, so the same rows
always give the same fences, whatever the partitions and retries. Only
DataFrame functions are used.

Defined cases: a null text counts as empty (no words, so the base rule fails
it); null lang and source form groups of their own; repeated rows are judged
one by one; an empty table gives an empty result; other columns are ignored
by ``measure`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import WORD_BREAK, let, staged, words

SYMBOLS = "#*$%&|<>"
#: The judged ratios.
RATIOS = ["symbol_share", "upper_share", "repeat_share", "dup_line_share", "mean_word"]
#: A fence is q75 + FENCE * (q75 - q25) + STEPS * (the median step of the ratio).
FENCE, STEPS = 4.0, 25.0
#: The fence of a group counts by its rows against so many rows of its language's, and that of a language so against that of all rows.
PRIOR_ROWS = 50
#: Bucket i of a sketch holds the values over GAMMA^(i-1) up to GAMMA^i; zeros, and values below 1e-9, share the lowest one.
GAMMA = 1.02
LOWEST = -1100
#: Fence tables up to so many rows (under 10 MB) are broadcast; larger ones join by key with salted rows.
MAX_BROADCAST_ROWS = 50_000
SALTS = 32
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: sort window hashes with their places, then join the places."""
    places = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(x, a["end"])).cast("long").alias("n"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(places), twice), covered))


def measures(text: Column) -> Column:
    """A struct of the base counts and the judged ratios of one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    raw = F.struct(
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.length(F.regexp_replace(t, WORD_BREAK, "")).cast("long").alias("c"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("s"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("u"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )
    per = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0).cast("long")), F.lit(0.0))
    return let(
        raw,
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"), m["c"].alias("word_chars"), m["s"].alias("n_symbols"), m["l"]["d"].alias("n_dup_lines"), m["w"]["r"].alias("n_repeat_words"), m["l"]["n"].alias("n_lines"),
            per(m["s"], m["c"]).alias("symbol_share"), per(m["u"], m["c"]).alias("upper_share"), per(m["w"]["r"], m["w"]["n"]).alias("repeat_share"), per(m["l"]["d"], m["l"]["n"]).alias("dup_line_share"), per(m["c"], m["w"]["n"]).alias("mean_word"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def steps() -> dict[str, Column]:
    """By how much one more symbol, acronym of three capitals, repeated window (six words at first) and line would move each ratio; of mean_word, the standard error if word lengths deviate by half their mean."""
    one = lambda n: 1 / F.greatest(F.col(n), F.lit(1))
    return {"symbol_share": one("word_chars"), "upper_share": 3 * one("word_chars"), "repeat_share": 6 * one("n_words"), "dup_line_share": one("n_lines"), "mean_word": F.col("mean_word") / 2 * F.sqrt(one("n_words"))}


def sketched(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, step, bucket, n): the sketches of all groups, of the ratios and of their steps."""
    bucket = lambda c: F.when(c > 1e-9, F.ceil(F.log(c) / F.log(F.lit(GAMMA)))).otherwise(LOWEST).cast("int").alias("bucket")
    of = lambda name, is_step, c: F.struct(F.lit(name).alias("measure"), F.lit(is_step).alias("step"), bucket(c))
    each = F.array(*[of(c, False, F.col(c)) for c in RATIOS], *[of(c, True, x) for c, x in steps().items()])
    rows = measured.where(~base_failed()).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "measure", "step", "bucket").agg(F.count(F.lit(1)).alias("n"))


def bounds(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, measure, <name>, <name>_n): the fence of each merged sketch, and its rows."""
    counts = sketch.groupBy(*keys, "measure", "step", "bucket").agg(F.sum("n").alias("n"))
    each = Window.partitionBy(*keys, "measure", "step")
    counts = counts.withColumn("upto", F.sum("n").over(each.orderBy("bucket"))).withColumn("of", F.sum("n").over(each))
    at = lambda q, step: F.min(F.when((F.col("step") == step) & (F.col("upto") >= q * F.col("of")), F.col("bucket"))).alias(f"b{int(q * 100)}")
    found = counts.groupBy(*keys, "measure").agg(at(0.25, False), at(0.75, False), at(0.5, True), F.max("of").alias(f"{name}_n"))
    value = lambda c: F.when(F.col(c) == LOWEST, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col(c)) / (GAMMA + 1))
    return found.select(*keys, "measure", (value("b75") + FENCE * (value("b75") - value("b25")) + STEPS * value("b50")).alias(name), f"{name}_n")


def fences(measured: DataFrame) -> DataFrame:
    """(fence_lang, fence_source, fence): a struct of the upper bound of each ratio for every group."""
    sketch = staged(sketched(measured), "sketches")
    whole = bounds(sketch, [], "by_all").select(F.col("measure").alias("m"), "by_all")
    langs = bounds(sketch, ["lang"], "by_lang").select(F.col("lang").alias("l"), F.col("measure").alias("m"), "by_lang", "by_lang_n")
    out = bounds(sketch, ["lang", "source"], "own").join(langs, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).drop("m")
    out = out.join(F.broadcast(whole), F.col("measure") == F.col("m"))  # five rows
    # Fences are blended by their logarithms, so that a wide one beside doesn't carry a narrow one along; steps keep all of them above zero.
    blend = lambda own, n, wider: (F.col(n) * F.log(own) + PRIOR_ROWS * wider) / (F.col(n) + PRIOR_ROWS)
    out = out.withColumn("fence", F.exp(blend("own", "own_n", blend("by_lang", "by_lang_n", F.log("by_all")))))
    wide = out.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == c, F.col("fence"))).alias(c) for c in RATIOS])
    return staged(wide.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), F.struct(*RATIOS).alias("fence")), "fences")


def judged(measured: DataFrame, fence: DataFrame) -> DataFrame:
    """Join each row with its group's fence; adds base_failed and kept."""
    same = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    if fence.count() <= MAX_BROADCAST_ROWS:
        out = measured.join(F.broadcast(fence), same, "left")
    else:  # a hot group goes to SALTS tasks
        salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        fence = fence.withColumn("fence_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(fence, same & (F.col("salt") == F.col("fence_salt")), "left").drop("salt", "fence_salt")
    failed = base_failed()
    inside = [F.col(c) <= F.col(f"fence.{c}") for c in RATIOS]
    kept = ~failed
    for x in inside:
        kept = kept & x
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("fence_lang", "fence_source", "fence")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each document, staged: they are a small part of the texts."""
    rows = docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))
    return staged(rows.select("doc_id", "lang", "source", "m.*"), "measures")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the ratios, base_failed and kept for every document."""
    measured = measure(docs)
    return judged(measured, fences(measured)).select("doc_id", *BASE, "base_failed", "kept", *RATIOS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. They are staged beside their measures, so that each text is measured once."""
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang", "source", measures(F.col("text")).alias("m")), "measured-rows")
    fence = fences(rows.select("lang", "source", "m.*"))
    return judged(rows.select("row", "doc_id", "lang", "source", "m.*"), fence).where("kept").select("row.*")
