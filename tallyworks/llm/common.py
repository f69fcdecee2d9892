"""Helpers that the training-data operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.sources.staging import discard, staged  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
_shipped: dict[str, str] = {}
#: Bytes of a batch of rows on its way to Python. Spark's own 64 MB stand in the executor's JVM, in Arrow and as Python objects at once, for each task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_SPARKS_BATCH = "67108864b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: a plain column used inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def bounded_labels(labels: DataFrame, target: str, keep: Column, max_rows: int) -> DataFrame:
    """One row (doc_id, y) per labelled document for which ``keep`` holds; about ``max_rows`` of them by a hash of the id if there are more.

    Null ids and null labels are left out; an id labelled twice takes the larger label.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(F.col(target)).cast("int").alias("y"))
    )
    total = rows.count()
    if total > max_rows:
        share = int(max_rows / total * 1_000_000)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share)
    return rows


def with_labels(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Join a label table to documents; it is broadcast only while its count is within twice the documented bound."""
    small = labels.count() <= 2 * max_rows
    return docs.join(F.broadcast(labels) if small else labels, "doc_id")


def fold(remainder_of: int, held: int) -> Column:
    """Whether crc32(doc_id as text) leaves the held-out remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % remainder_of == held, F.lit(False))


def isotonic(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (score, rows, positives) bins: the ends of each block with its smoothed share of positives, in order, to interpolate between."""
    blocks: list[list[float]] = []
    for x, n, p in sorted(bins):
        blocks.append([x, n, p, x])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n2, p2, end = blocks.pop()
            blocks[-1][1] += n2
            blocks[-1][2] += p2
            blocks[-1][3] = end
    return [(x, (p + 0.02) / (n + 0.1)) for low, n, p, high in blocks for x in sorted({low, high})]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    if _shipped.get("application") != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/tallyworks", "zip", root, "tallyworks"))
        _shipped["application"] = spark.sparkContext.applicationId


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's batches to Python, unless it has a bound of its own. A table that isn't written yet takes the bound when it is."""
    if spark.conf.get(BATCH_SETTING) == _SPARKS_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def tokenizer_file(path: str) -> str:
    """A path as it is; a bare file name is that of a public tokenizer, resolved on the worker that opens it."""
    if "/" in path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


def as_text(column: str) -> Column:
    """An id as text, so that a worker's data frame doesn't turn it to floating point beside a null."""
    return F.col(column).cast("string").alias(column)


def with_id(rows: DataFrame, like: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` with the id's own type again."""
    return rows.withColumn(column, F.col(column).cast(like.schema[column].dataType))
