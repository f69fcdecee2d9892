"""Database tables: configuration from a file, parallel scans, and what of a query reaches the database."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

#: Seconds until a connection or a statement is given up.
CONNECT_SECONDS, STATEMENT_SECONDS = 10, 60


def read_config(spark: SparkSession, path: str, connection: str | None = None) -> dict[str, str]:
    """JDBC options of one connection, by default the document's ``default_connection``.

    The document is JSON, or YAML where PyYAML can be imported, and holds ``connections`` by
    name: either a ``url``, or ``host``, ``port`` and ``database`` of a ``kind`` (postgresql
    unless it says otherwise); ``user``, ``password``, ``driver`` and ``options`` as they are.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        document = json.loads(text)
    else:
        import yaml

        document = yaml.safe_load(text)
    name = connection or document["default_connection"]
    if name not in document["connections"]:
        raise KeyError(f"no connection {name} in {path}")
    c = document["connections"][name]
    url = c.get("url") or f"jdbc:{c.get('kind', 'postgresql')}://{c['host']}:{c.get('port', 5432)}/{c['database']}"
    given = {k: str(c[k]) for k in ("user", "password", "driver") if c.get(k)}
    return {"url": url, "queryTimeout": str(STATEMENT_SECONDS), **({"loginTimeout": str(CONNECT_SECONDS)} if "postgresql" in url else {}), **given, **{k: str(v) for k, v in (c.get("options") or {}).items()}}


def bounds(spark: SparkSession, table: str, column: str, options: dict[str, str]) -> tuple | None:
    """The least and largest value of a column, asked of the database; none in an empty table."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(column)
    query = f"(SELECT MIN({name}) AS LOW, MAX({name}) AS HIGH FROM {table}) BOUNDS"
    row = spark.read.format("jdbc").options(**options, dbtable=query).load().first()
    return None if row[0] is None else (row[0], row[1])


def read_table(spark: SparkSession, table: str, options: dict[str, str], partition: str | None = None, limits: tuple | None = None, partitions: int = 16) -> DataFrame:
    """A table, or a subquery in parentheses with a name. By ranges of ``partition``, a column of numbers, dates or times, it is read in parallel.

    The ranges span the column's least and largest value, which the database tells unless
    ``limits`` does; rows beyond them and nulls are read as well, by the outer ranges. Filters and
    columns go to the database as far as Spark can say them there.
    """
    reader = spark.read.format("jdbc").options(**options, dbtable=table)
    if partition:
        limits = limits or bounds(spark, table, partition, options)
        if limits:
            reader = reader.options(partitionColumn=partition, lowerBound=str(limits[0]), upperBound=str(limits[1]), numPartitions=str(partitions))
    return reader.load()


def pushed(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    """What reaches the scans of a query: filters, and the columns of each scan."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    filters = [f for found in re.findall(r"PushedFilters: \[(.*?)\]", plan) for f in re.findall(r"\w+\([^()]*\)", found)]
    columns = [[c.split(":")[0] for c in found.split(",")] for found in re.findall(r"ReadSchema: struct<(.*?)>", plan)]
    return filters, columns
