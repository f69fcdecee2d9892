"""The test tables seen as a horse master and as offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.sources.documents import file_states

CLUB = 3
#: Bytes of files up to which a table may be broadcast. Spark goes by the files as well, which hold names of few kinds in far less than the driver's memory.
BROADCAST_BYTES = 1 << 20


_schemas: dict[tuple, tuple] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is found once for as long as its files are what they were, as finding it is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    key, state = (spark.sparkContext.applicationId, path), file_states(spark, path)
    if _schemas.get(key, (None,))[0] != state:
        _schemas[key] = state, spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key][1]).parquet(path)


def joinable(spark: SparkSession, sf_dir: str, name: str, hint: str = "shuffle_hash") -> DataFrame:
    """A table for a join; a large one meets by shuffles, so that it doesn't pass through the driver."""
    table = read(spark, sf_dir, name)
    small = sum(size for _, size, _ in file_states(spark, f"{sf_dir}/{name}.parquet")) <= BROADCAST_BYTES
    return table if small else table.hint(hint)


def horses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a horse: supplier = trainer, part = family, nation of the customer = owner."""
    # Spark sizes orders by the two columns that a rank build reads; a sort may spill, a hash of millions of them may not
    item, order = read(spark, sf_dir, "lineitem"), joinable(spark, sf_dir, "orders", "merge")
    customer, supplier, part = (joinable(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    rows = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey)
    rows = rows.join(supplier, item.l_suppkey == supplier.s_suppkey).join(part, item.l_partkey == part.p_partkey)
    return rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("s_name").alias("trainer"), F.col("l_suppkey").alias("trainer_code"), F.col("p_name").alias("family"), F.col("p_brand").alias("family_code"),
        F.col("p_type").alias("sire"), F.col("c_nationkey").alias("owner"), (F.col("l_returnflag") == "R").cast("long").alias("wins"), F.col("l_quantity").cast("long").alias("starts"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("prize"), F.round(F.col("l_discount") * 45, 2).alias("price"), F.when(F.col("o_orderstatus") == "P", "満口").otherwise("募集中").alias("status"), F.col("o_orderpriority").alias("pool"),
        F.when(F.col("l_linestatus") == "O", "0").alias("active"), F.col("o_orderdate").alias("born"), F.col("l_partkey").alias("dam"),
    )


HORSES_SQL = """horses AS (
  SELECT l_orderkey AS id, l_linenumber AS line, s_name AS trainer, l_suppkey AS trainer_code, p_name AS family, p_brand AS family_code, p_type AS sire, c_nationkey AS owner,
    CAST(l_returnflag = 'R' AS BIGINT) AS wins, CAST(trunc(l_quantity) AS BIGINT) AS starts, CAST(round(l_extendedprice * 100) AS BIGINT) AS prize, round(l_discount * 45, 2) AS price,
    CASE WHEN o_orderstatus = 'P' THEN '満口' ELSE '募集中' END AS status, o_orderpriority AS pool, CASE WHEN l_linestatus = 'O' THEN '0' END AS active, o_orderdate AS born, l_partkey AS dam
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

#: Condition texts of offers, by the order's key.
TEXTS = ["順調に良化", "休養中", "併せ馬で快調", "軽い跛行", "気になる点なく増体", "停滞 減量", ""]


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order as an offer with a condition text and a weight."""
    h = horses(spark, sf_dir).where("line = 1")
    words = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % 7).cast("int") + 1)
    text = F.concat(words, F.lit(" "), (400 + F.col("id") % 90).cast("string"), F.lit("kg"))
    return h.withColumn("name", F.concat(F.lit("offer"), F.col("id").cast("string"))).withColumn("text", F.when(words == "", words).otherwise(text))


OFFERS_SQL = (
    """offers AS (
  SELECT *, 'offer' || CAST(id AS VARCHAR) AS name, CASE WHEN w = '' THEN '' ELSE w || ' ' || CAST(400 + id % 90 AS VARCHAR) || 'kg' END AS text, CASE WHEN w <> '' THEN 400 + id % 90 END AS weight
  FROM (SELECT *, CASE id % 7 """
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEXTS))
    + " END AS w FROM horses WHERE line = 1))"
)
