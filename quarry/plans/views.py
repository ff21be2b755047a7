"""Canonical inputs of the mining operators, as views of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders from this day on are the test side of the recommenders.
SPLIT_DAY = "2000-04-01"
#: Rows of a table that one task of a shuffle gets.
TASK_ROWS = 500_000
#: Shuffled bytes, compressed, up to which adaptive execution joins partitions.
TASK_BYTES = "16MB"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str) -> None:
    """Let this session shuffle into so many partitions that none has more than some TASK_ROWS rows of the largest table;
    a larger setting stays. Partitions are not put together again beyond TASK_BYTES, unless the session names another size.
    So what a task holds does not grow with the tables."""
    wanted = -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < wanted:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(joined) in ("67108864b", "64MB"):  # Spark's own
        spark.conf.set(joined, TASK_BYTES)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, stars (1 to 5) and day: who bought which part, and how much of it."""
    spread(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("day"))
    return lines.join(orders, "l_orderkey").select("user_id", "item_id", "stars", "day")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(F.col("day") < F.lit(SPLIT_DAY).cast("timestamp")).select("user_id", "item_id", "stars")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(F.col("day") >= F.lit(SPLIT_DAY).cast("timestamp")).select("user_id", "item_id", "stars")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, item_id)."""
    return ratings(spark, sf_dir).select("user_id", "item_id").distinct()


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (basket, item): the brands in each order."""
    spread(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return lines.join(parts, "p_partkey").select("basket", "item").dropna().distinct()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, text: documents as reviews of their source by one of 50 users."""
    return table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(50)).cast("long").alias("user_id"), F.col("source").alias("item_id"), "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, coords, chunk and label of the embeddings, in four chunks."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"), F.pmod("vec_id", F.lit(4)).cast("int").alias("chunk"), "label")
