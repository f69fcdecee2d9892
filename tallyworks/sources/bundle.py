"""Report tables as one script document, written by many tasks.

A bundle is a folder: ``header``, for every table a numbered folder of text whose lines are its rows as
JSON, and ``footer``; ``manifest`` lists their files in order. ``joined`` streams
them into one file, ``window.NAME = {"table":[...],...};``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.operators.place import ranged
from tallyworks.sources.staging import discard


def _lines(df: DataFrame, order: list[Column]) -> DataFrame:
    """(at, value): the rows as JSON in order, all but the first after a comma."""
    rows = ranged(df, [], order)
    first = rows.agg(F.min("__at")).first()[0]
    comma = F.when(F.col("__at") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    return rows.select("__at", F.concat(comma, F.to_json(F.struct(*[rows[c] for c in df.columns]))).alias("value"))


def write_bundle(tables: dict[str, DataFrame], path: str, name: str = "CLUB_DATA", orders: dict[str, list[Column]] | None = None) -> list[str]:
    """Write a bundle of tables, each in its order or else by all its columns; the files in order. No task holds a table."""
    files: list[str] = []
    spark = next(iter(tables.values())).sparkSession
    put = lambda text, at: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{at}")
    for k, (key, df) in enumerate(tables.items()):
        put((f"window.{name} = {{" if not k else "],") + json.dumps(key, ensure_ascii=False) + ":[", f"{2 * k:06d}-head")
        order = (orders or {}).get(key) or [F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]
        lines = _lines(df, order)
        lines.repartitionByRange("__at").sortWithinPartitions("__at").select("value").write.mode("overwrite").text(f"{path}/{2 * k + 1:06d}-rows")
        discard(lines)
    put("]};", f"{2 * len(tables):06d}-foot")
    fs = _files(spark, path)
    for folder in sorted(s.getPath().toString() for s in fs.listStatus(_path(spark, path)) if s.getPath().getName()[:6].isdigit()):
        names = sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, folder)) if s.getPath().getName().startswith("part-") and s.getLen())
        files += [f"{folder.rsplit('/', 1)[1]}/{n}" for n in names]
    spark.createDataFrame(list(enumerate(files)), "place int, file string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return files


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> list[str]:
    return [r["file"] for r in spark.read.schema("place int, file string").json(f"{path}/manifest").orderBy("place").collect()]


def joined(spark: SparkSession, path: str, target: str) -> None:
    """One file of the bundle's files, streamed a buffer at a time."""
    fs, out_fs = _files(spark, path), _files(spark, target)
    out = out_fs.create(_path(spark, target), True)
    try:
        for f in manifest(spark, path):
            part = fs.open(_path(spark, f"{path}/{f}"))
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()


def read_bundle_table(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """A table's rows from a bundle's folder, read in parallel; its number is its place among the heads."""
    for f in manifest(spark, path):
        folder = f.split("/")[0]
        if folder.endswith("-head") and json.loads(spark.read.text(f"{path}/{folder}").first()[0].rsplit(":[", 1)[0].split("= {", 1)[-1].removeprefix("],")) == key:
            rows = spark.read.text(f"{path}/{int(folder[:6]) + 1:06d}-rows")
            return rows.select(F.from_json(F.ltrim(rows["value"], F.lit(",")), schema).alias("r")).select("r.*")
    raise KeyError(f"no table {key} in {path}")
