"""How filters interact: what each removes, alone and after others, in every order.

Each document fails some of five conditions: A under 100 words; B fewer than 80
distinct words in a hundred; C more than 10 capitals A-Z in a hundred code points; D any of
``#$%&*|``; E the text of a smaller id, anywhere in the table. The documents of a
part (its language) are counted by the 32 patterns of failures, as a tensor of shape
2x2x2x2x2 whose axes are the filters. An order's step keeps what passes
along the axes of its filters so far, so each figure is a contraction of that
tensor with a vector for every axis: (1, 0) selects passes, (0, 1) failures,
(1, 1) both. One einsum gives all steps of all 120 orders.

Only counts leave the tasks that read texts. Copies are found by the SHA-256 of
whole texts: one row per distinct text says which id is the first, so that no task
needs all copies of a text.

Defined cases: null texts are empty, and empty texts are copies of each other; a null
language is the part ''; a null id is neither a copy nor an original and has
no labels; rows that repeat an id and its text are counted one by one and none is the other's
copy; an id labelled twice counts as good or toxic if either row says so; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import discard, staged

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What the vectors of an axis select.
PASS, FAIL, ALL = 0, 1, 2
VECTORS = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: bytes) -> int:
    """The conditions A to D that a text in UTF-8 fails, as bits; bytes split at the six signs of ASCII white space."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | (signs > 0) << 3


def failed(text: Column) -> Column:
    """``failures`` of a text column."""

    @F.pandas_udf("int")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([failures(t) for t in texts], dtype="int32")

    return bits(F.coalesce(text, F.lit("")).cast("binary"))


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, part, fails, good, toxic, n): what the audit needs of each document, repeated rows counted."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"), failed(F.col("text")).alias("fails"))
    rows = rows.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    known = known.select("doc_id", "digest", "part", "fails", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    return known.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def patterns(rows: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n) with E among the failures: for each text, the rows of its smallest id pass it, and so do rows without an id."""
    keys = ["part", "fails", "good", "toxic"]
    every = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    known = rows.where("doc_id IS NOT NULL")
    of_id = known.groupBy("digest", "doc_id").agg(F.collect_list(F.struct(*keys, "n")).alias("rows"))
    first = of_id.groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows"))
    originals = first.unionByName(rows.where("doc_id IS NULL").select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("passing"))
    both = every.join(originals, keys, "left").withColumn("passing", F.coalesce("passing", F.lit(0)))
    split = F.array(F.struct(F.col("fails"), F.col("passing").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))
    return both.select("part", "good", "toxic", F.inline(split)).where("n > 0")


def selections() -> dict[str, np.ndarray]:
    """For each figure, what each axis selects at every step of every order: (steps, axes)."""
    out = {k: np.full((len(ORDERS) * len(FILTERS), len(FILTERS)), ALL) for k in ("kept", "removed", "failing", "unique_fails")}
    out["unique_fails"][:] = PASS
    at = 0
    for order in ORDERS:
        for k, letter in enumerate(order):
            axis, before = FILTERS.index(letter), [FILTERS.index(f) for f in order[:k]]
            out["kept"][at, [*before, axis]] = PASS
            out["removed"][at, before] = PASS
            for name in ("removed", "failing", "unique_fails"):
                out[name][at, axis] = FAIL
            at += 1
    return out


def audit_of(counts: pd.DataFrame) -> pd.DataFrame:
    """All figures of one part from its counts by pattern."""
    tensor = np.zeros((32, 3), dtype=np.int64)  # documents, good ones, toxic ones
    n = counts["n"].to_numpy()
    for k, weight in enumerate((n, n * counts["good"].to_numpy(), n * counts["toxic"].to_numpy())):
        np.add.at(tensor[:, k], counts["fails"].to_numpy(), weight)
    tensor = tensor.reshape(2, 2, 2, 2, 2, 3)  # the axes E, D, C, B, A: E is the highest bit
    steps = {}
    for name, chosen in selections().items():
        a, b, c, d, e = (VECTORS[chosen[:, k]] for k in range(5))
        steps[name] = np.einsum("edcbak,oa,ob,oc,od,oe->ok", tensor, a, b, c, d, e, optimize=True)
    removed = steps["removed"][:, 0]
    letters = np.array([letter for order in ORDERS for letter in order])
    total = {letter: int(removed[letters == letter].sum()) for letter in FILTERS}
    return pd.DataFrame(
        {
            "part": counts["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)),
            "kept": steps["kept"][:, 0], "removed": removed, "redundant": steps["failing"][:, 0] - removed, "unique_fails": steps["unique_fails"][:, 0],
            "good_lost": steps["removed"][:, 1], "toxic_lost": steps["removed"][:, 2], "shapley": [total[x] for x in letters],
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: see ``COUNTS``."""
    rows = staged(measured(docs, labels), "measured")
    counts = staged(patterns(rows), "patterns")
    discard(rows)
    return counts.groupBy("part").applyInPandas(audit_of, SCHEMA)


_LETTERS = ", ".join(f"('{f}')" for f in FILTERS)
_PLACES = ", ".join(f"CASE WHEN {f.lower()} THEN strpos(filter_order, '{f}') ELSE 6 END" for f in FILTERS)
#: The same figures from the place of the first filter in an order that a document fails.
SQL = rf"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
  failing AS (SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_CAPITALS} * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM split),
  marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  counts AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
  one AS (SELECT * FROM (VALUES {_LETTERS}) AS v(x)),
  orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM one p, one q, one r, one s, one t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
  steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f FROM orders, range(1, 6) g(step)),
  placed AS (SELECT *, least({_PLACES}) AS gone, CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS hit, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) AS fails FROM counts, steps),
  summed AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN hit AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM placed GROUP BY ALL)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed"""
