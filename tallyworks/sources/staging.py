"""Tables written in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This library's part of the folder in ``spark.checkpoint.dir``; a folder of this machine only in local mode."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/tallyworks"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder; it goes when the driver's JVM ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/{context.applicationId}"
    if path not in _kept:
        _file_system(spark, path).deleteOnExit(context._jvm.org.apache.hadoop.fs.Path(path))
        _kept.add(path)
    return path


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    return context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_named(df: DataFrame, name: str) -> None:
    """Delete the tables staged under ``name`` that ``df`` reads."""
    spark = df.sparkSession
    ours = f"{scratch_dir(spark)}/{name}-"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if ours.split(":", 1)[-1].lstrip("/") in folder:
            _file_system(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if files:
            folder = files[0].rsplit("/", 1)[0]
            spark = df.sparkSession
            _file_system(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
