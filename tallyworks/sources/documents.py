"""JSON documents in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyworks.sources.store import Store

REPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("at", "text", "note")])
CANDIDATE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "sex", "trainer", "stable_area", "sire", "damsire", "status", "family_label", "family_mare", "maternal_granddam", "dam", "signature_line", "pool", "kinjou_latest")]
    + [T.StructField("generation", T.IntegerType()), T.StructField("price_man_yen", T.DoubleType()), T.StructField("total_man_yen", T.LongType()), T.StructField("units", T.LongType()), T.StructField("kinjou_history", T.ArrayType(REPORT))]
)


def read_document(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON document as a row, or its ``lines`` as rows; no row if it isn't there."""
    try:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_candidates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The candidates of a store document, or those that ``write_candidates`` wrote as ``lines``; none if there is nothing."""
    if lines:
        return read_document(spark, path, CANDIDATE, lines)
    schema = T.StructType([T.StructField("updated_at", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE))])
    return read_document(spark, path, schema).select(F.explode("candidates").alias("c")).select("c.*")


GRADED_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("trainer", "family_name", "grade", "note", "hiroo_family_grade")]
    + [T.StructField(n, T.LongType()) for n in ("wins", "starts", "n_horses", "rank", "hiroo_horses", "hiroo_family_rank")]
    + [T.StructField(n, T.DoubleType()) for n in ("win_rate_sm", "score", "percentile")] + [T.StructField("hiroo_unique", T.BooleanType())]
)


def read_ranks(spark: SparkSession, path: str, table: str, lines: bool = False) -> DataFrame:
    """One table of a rank document by its name, or the one that ``write_ranks`` wrote as ``lines``; empty if there is nothing."""
    if lines:
        return read_document(spark, f"{path}/{table}", GRADED_ROW, lines)
    schema = T.StructType([T.StructField(table, T.ArrayType(GRADED_ROW))])
    return read_document(spark, path, schema).select(F.explode(table).alias("r")).select("r.*")


def write_ranks(tables: dict[str, DataFrame], path: str, slim: dict[str, list[str]] | None = None) -> None:
    """Each graded table in a folder of its own, as line-delimited JSON written by all tasks.

    ``slim`` names the fields of an index (``index/<table>``) of a table's graded
    rows; ``meta`` holds the time of writing. Tables read before are forgotten.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        if slim and name in slim:
            df.where("grade <> 'U'").select(*slim[name]).write.mode("overwrite").json(f"{path}/index/{name}")
        session = df.sparkSession
    if tables:
        session.range(1).select(now_iso().alias("generated_at")).write.mode("overwrite").json(f"{path}/meta")
    forget_ranks()


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def today_iso() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


_ranks: dict[tuple, tuple[tuple, DataFrame]] = {}


def file_states(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of each file under a path; empty if there is nothing."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ()
    found, out = files.listFiles(at, True), []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def cached_ranks(spark: SparkSession, path: str, table: str, lines: bool = False) -> DataFrame:
    """``read_ranks`` kept in the executors' memory and disk for as long as the files are what they were; whoever writes them, the next call sees it."""
    key, state = (spark.sparkContext.applicationId, path, table, lines), file_states(spark, f"{path}/{table}" if lines else path)
    kept = _ranks.get(key)
    if kept is None or kept[0] != state:
        if kept is not None:
            kept[1].unpersist()
        _ranks[key] = state, read_ranks(spark, path, table, lines).persist()
    return _ranks[key][1]


def forget_ranks() -> None:
    """Give up what is kept."""
    while _ranks:
        (application, *_), (_, df) = _ranks.popitem()
        if df.sparkSession.sparkContext.applicationId == application:
            df.unpersist()


AXIS = T.StructType(
    [T.StructField("generated_at", T.StringType()), T.StructField("owner", T.LongType()), T.StructField("n_name", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("n_horses", "n_active", "wins", "starts")]
    + [T.StructField("trainers", T.ArrayType(T.StructType([T.StructField("trainer", T.StringType()), T.StructField("trainer_code", T.StringType()), T.StructField("n", T.LongType())])))]
)


def write_axis(summary: DataFrame, path: str) -> None:
    """An owner's summary with the time of writing, as a JSON document of one line."""
    summary.withColumn("generated_at", now_iso()).write.mode("overwrite").json(path)


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """The summary that ``write_axis`` wrote; none if there is nothing."""
    return read_document(spark, path, AXIS, lines=True)


def save_entries(entries: DataFrame, path: str) -> DataFrame:
    """Publish ledger entries as the next version of a store; the rows as read back. The version before stays until it is pruned, and a write that fails changes nothing."""
    return Store(entries.sparkSession, path, entries.schema).update(lambda _: entries)


def write_candidates(df: DataFrame, path: str) -> None:
    """One row per candidate with the time of writing, as line-delimited JSON."""
    df.withColumn("updated_at", now_iso()).write.mode("overwrite").json(path)


def entries_from_json(text, schema: str = "opening struct<amount:long,date:string>, entries array<struct<id:string,date:string,name:string,type:string,amount:long,memo:string,createdAt:long>>"):
    """A ledger state column from JSON text; malformed text gives an empty state."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit('{"entries":[]}'), schema))
