"""Content-based recommendation: tokens, TF-IDF, item and user profiles, set cosine."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import set_cosine

#: ASCII punctuation and digits, which are deleted before a text is split.
DELETED = string.punctuation + string.digits


def tokens(text: Column, stopwords: list[str] = ()) -> Column:
    """Lower-cased words of a-z only that are no stop words; words are split at ASCII white space."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), DELETED, "")
    found = F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[a-z]+$"))
    return F.filter(found, lambda w: ~w.isin(list(stopwords))) if stopwords else found


def term_frequency(docs: DataFrame, key: str, text: str, stopwords: list[str] = (), min_count: int = 2) -> DataFrame:
    """(key, word, n, tf): words that a key has ``min_count`` times or more, in relation to its most frequent word."""
    words = docs.select(F.col(key).alias("key"), F.explode(tokens(F.col(text), stopwords)).alias("word"))
    counts = words.groupBy("key", "word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    # Joined rather than windowed: a key that has most of the words is no single task.
    most = counts.groupBy("key").agg(F.max("n").alias("most"))
    return counts.join(most, "key").select("key", "word", "n", (F.col("n") / F.col("most")).alias("tf"))


def inverse_frequency(tf: DataFrame, total: DataFrame) -> DataFrame:
    """(word, df, idf): ln of all keys (``total``: one row n_keys) over the keys that have the word."""
    return tf.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("word", "df", F.log(F.col("n_keys") / F.col("df")).alias("idf"))


def profiles(docs: DataFrame, key: str, text: str, stopwords: list[str] = (), min_count: int = 2, top: int = 200) -> DataFrame:
    """(key, word, score): the words of highest TF-IDF of each key; ties go to the lesser word."""
    tf = term_frequency(docs, key, text, stopwords, min_count)
    total = docs.agg(F.countDistinct(key).alias("n_keys"))
    scored = tf.join(inverse_frequency(tf, total), "word").select("key", "word", F.round(F.col("tf") * F.col("idf"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("key", "word", "score")


def user_profiles(reviews: DataFrame, items: DataFrame, mode: str = "union") -> DataFrame:
    """(user_id, word): the words of the items that a user reviewed, or with ``mode='last'`` of the greatest item only."""
    seen = reviews.select("user_id", F.col("item_id").alias("key")).distinct()
    if mode == "last":
        seen = seen.groupBy("user_id").agg(F.max("key").alias("key"))
    return seen.join(items.select("key", "word"), "key").select("user_id", "word").distinct()


def predict(test: DataFrame, users: DataFrame, items: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(user_id, item_id, sim): set cosine of the profiles of test pairs, where it is over the threshold."""
    u = users.groupBy("user_id").agg(F.count("*").alias("nu"))
    i = items.groupBy("key").agg(F.count("*").alias("ni")).withColumnRenamed("key", "item_id")
    words = items.select(F.col("key").alias("item_id"), "word")
    common = test.distinct().join(users, "user_id").join(words, ["item_id", "word"]).groupBy("user_id", "item_id").agg(F.count("*").alias("common"))
    sim = set_cosine(F.col("common"), F.col("nu"), F.col("ni"))
    return common.join(u, "user_id").join(i, "item_id").where(sim > threshold).select("user_id", "item_id", sim.alias("sim"))
