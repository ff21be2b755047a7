"""Writers: distributed ones for tables, and small reports in fixed text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, by all tasks."""
    df.write.mode("overwrite").json(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def model_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each part of a model as a table of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def itemsets_joined(sets: DataFrame, path: str) -> None:
    """Itemsets as lines joined by ``?``; an item that has one raises, since the line could not be read back."""
    line = F.when(F.exists("items", lambda x: x.contains("?")), F.raise_error(F.lit("an item contains '?'"))).otherwise(F.array_join("items", "?"))
    sets.select(line.alias("value")).write.mode("overwrite").text(path)


def single_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object from keys to values on one line, for models as small as one line may be."""
    pair = F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> str:
    """The two blocks of candidates and frequent itemsets, one line a size with a blank line between; empty ones too."""

    def block(sets: DataFrame) -> str:
        lines: dict[int, list[str]] = {}
        for r in sets.select(F.array_sort("items").alias("items")).orderBy(F.size("items"), "items").toLocalIterator():
            items = tuple(r["items"])
            lines.setdefault(len(items), []).append(f"('{items[0]}')" if len(items) == 1 else str(items))
        return "\n\n".join(",".join(x) for x in lines.values())

    return f"Candidates:\n{block(candidates)}\n\nFrequent Itemsets:\n{block(frequent)}"


def communities_report(groups: DataFrame) -> str:
    """One community a line, its members quoted and in order; by size, then members. ``groups``: (v, component)."""
    sets = groups.groupBy("component").agg(F.array_sort(F.collect_list(F.col("v").cast("string"))).alias("members"))
    return "\n".join(", ".join(f"'{m}'" for m in r["members"]) for r in sets.orderBy(F.size("members"), "members").toLocalIterator())


def betweenness_report(scores: DataFrame) -> str:
    """One edge a line, ``('a', 'b'), score``, by falling score, then ends."""
    rows = scores.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "score").orderBy(F.col("score").desc(), "a", "b")
    return "\n".join(f"('{r['a']}', '{r['b']}'), {r['score']}" for r in rows.toLocalIterator())


def hits_line(probes: DataFrame, order: str, hit: str = "hit") -> str:
    """All hits on one line, by ``order``, with a blank between."""
    return " ".join(str(r[0]) for r in probes.orderBy(order).select(hit).toLocalIterator())


def overlap_report(counts: DataFrame, names: tuple[str, str, str] = ("Task2", "Task3", "Intersection")) -> str:
    """Three lines of name and count from ``itemsets.overlap``."""
    n = {r["name"]: r["n"] for r in counts.collect()}
    return "\n".join(f"{name},{n[key]}" for name, key in zip(names, ("first", "second", "both")))


def append_windows(path: str):
    """A ``foreachBatch`` function that appends (window_start, truth, estimate) rows as CSV files with a header."""

    def each(df: DataFrame, batch: int) -> None:
        df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation")).write.mode("append").option("header", True).csv(path)

    return each


def trending_report(seen: int, tags: DataFrame) -> str:
    """How many tagged rows were seen, and the trending tags, most frequent first."""
    rows = tags.orderBy(F.col("cnt").desc(), "tag").toLocalIterator()
    return "\n".join([f"The number of tweets with tags from the beginning: {seen}", *[f"{r['tag']} : {r['cnt']}" for r in rows]]) + "\n"
