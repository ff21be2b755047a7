"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, text string"


def interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, business_id) of a CSV file with a header; further columns are ignored. Quoting is understood."""
    return spark.read.option("header", True).csv(path).select("user_id", "business_id")


def reviews_json(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, one JSON object a line; missing fields are null."""
    return spark.read.schema(REVIEW).json(path)


def pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, business_id), one JSON object a line."""
    return spark.read.schema("user_id string, business_id string").json(path)


def cities_json(spark: SparkSession, path: str) -> DataFrame:
    """(city) of business objects, without empty and null ones."""
    return spark.read.schema("city string").json(path).where("city is not null and city <> ''")


def points_text(spark: SparkSession, folder: str) -> DataFrame:
    """(point_id, coords, chunk, file) of ``id,x,y,...`` lines in the .txt files of a folder.

    Files count as chunks 0, 1, ... in the order of their names; only the names go through the driver.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    names = [r[0] for r in lines.select("file").distinct().orderBy("file").collect()]
    order = spark.createDataFrame(list(enumerate(names)), "chunk int, file string")
    fields = F.split("value", ",")
    parsed = lines.select(fields[0].cast("long").alias("point_id"), F.transform(F.slice(fields, 2, F.size(fields)), lambda x: x.cast("double")).alias("coords"), "file")
    return parsed.join(F.broadcast(order), "file").select("point_id", "coords", "chunk", "file")


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """The words of a file, one a line."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''").distinct().collect()]


def similarity_model(spark: SparkSession, path: str, kind: str = "item") -> DataFrame:
    """(a, b, sim) of a JSON model of items (b1, b2) or users (u1, u2)."""
    x, y = ("b1", "b2") if kind == "item" else ("u1", "u2")
    return spark.read.schema(f"{x} string, {y} string, sim double").json(path).select(F.col(x).alias("a"), F.col(y).alias("b"), "sim")


def average_model(spark: SparkSession, path: str) -> DataFrame:
    """(key, mean) of a JSON object from ids to averages, which stands on the first line."""
    line = spark.read.text(path).limit(1)
    return line.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "mean"))


def model_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A part of a model that ``writers.model_tables`` wrote."""
    return spark.read.parquet(f"{folder}/{name}")


def itemsets_text(spark: SparkSession, path: str) -> DataFrame:
    """(items) of ``?``-joined lines; see ``writers.itemsets_joined``."""
    return spark.read.text(path).where("value <> ''").select(F.array_sort(F.split("value", r"\?")).alias("items"))
