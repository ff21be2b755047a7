"""Sketches of streams: Bloom filter, Flajolet-Martin distinct counts, reservoir samples, trending counts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import FAMILY, affine, text_mod, trailing_zeros

BLOOM_BITS, BLOOM_HASHES = 7000, 7
FM_MODULUS, FM_GROUPS, FM_GROUP = 2333333333, 20, 10


def bloom_positions(text: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The bits of a value."""
    x = text_mod(text, bits)
    return F.array(*[affine(x, a, b, bits) for a, b in FAMILY[:hashes]])


def bloom_build(values: DataFrame, column: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(position): the set bits of a filter over the distinct non-empty values; at most ``bits`` rows."""
    kept = values.select(F.col(column).alias("v")).where("v is not null and v <> ''").distinct()
    return kept.select(F.explode(bloom_positions(F.col("v"), bits, hashes)).alias("position")).distinct()


def bloom_probe(values: DataFrame, column: str, bloom: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """The rows of ``values`` with ``hit``: 1 if all bits of the value are set, 0 for empty and null values.

    The filter is at most ``bits`` positions, one array for all rows.
    """
    set_bits = bloom.agg(F.collect_set("position").alias("set_bits"))
    wanted = bloom_positions(F.col(column), bits, hashes)
    inside = F.forall(wanted, lambda p: F.array_contains("set_bits", p))
    known = F.col(column).isNotNull() & (F.col(column) != "")
    return values.join(F.broadcast(set_bits)).withColumn("hit", F.when(known, inside.cast("int")).otherwise(F.lit(0))).drop("set_bits")


def fm_coefficients(seed: int = 7, n: int = FM_GROUPS * FM_GROUP, top: int = 29_400_000) -> list[tuple[int, int]]:
    """Seeded multipliers and offsets of the hash functions."""
    draw = random.Random(seed)
    return [(draw.randint(0, top), draw.randint(0, top)) for _ in range(n)]


def fm_estimate(values: DataFrame, column: str, by: list[str] = (), seed: int = 7) -> DataFrame:
    """(by, truth, estimate): exact and estimated distinct non-empty values.

    For each hash function the most trailing zeros; means over groups of 10; the power of 2 of the median mean.
    """
    kept = values.select(*by, F.col(column).alias("v")).where("v is not null and v <> ''").distinct().select(*by, text_mod(F.col("v"), FM_MODULUS).alias("x"))
    # One row for each value and hash function, summed up in the tasks to one row for each function.
    functions = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, (a, b) in enumerate(fm_coefficients(seed))])
    hashed = kept.select(*by, "x", F.inline(functions))
    zeros = hashed.groupBy(*by, "k").agg(F.count("*").alias("truth"), F.max(trailing_zeros((F.col("x") * F.col("a") + F.col("b")) % FM_MODULUS)).alias("r"))
    means = zeros.groupBy(*by, F.floor(F.col("k") / FM_GROUP).alias("g")).agg(F.max("truth").alias("truth"), F.avg("r").alias("mean"))
    order = means.groupBy(*by).agg(F.coalesce(F.max("truth"), F.lit(0)).alias("truth"), F.array_sort(F.collect_list("mean")).alias("m"))
    median = (F.get("m", F.lit(FM_GROUPS // 2 - 1)) + F.get("m", F.lit(FM_GROUPS // 2))) / 2
    estimate = F.when(F.col("truth") == 0, F.lit(0.5)).otherwise(F.pow(F.lit(2.0), median))
    return order.select(*by, "truth", estimate.alias("estimate"))


def sliding_distinct(events: DataFrame, ts: str, column: str, width: str, step: str) -> DataFrame:
    """(window_start, truth): exact distinct values of each sliding window."""
    spread = events.select(F.window(ts, width, step)["start"].alias("window_start"), F.col(column).alias("v")).distinct()
    return spread.groupBy("window_start").agg(F.count("v").alias("truth"))


def reservoir_sample(rows: DataFrame, key: str, n: int, a: int = 48271, b: int = 11, m: int = 2147483647) -> DataFrame:
    """A uniform sample of ``n`` rows: those of least seeded hash, so each row has the same chance whatever the order.

    Tasks keep their own ``n`` before the merge.
    """
    return rows.withColumn("_h", affine(F.col(key).cast("long"), a, b, m)).orderBy("_h", key).limit(n).drop("_h")


def trending(counts: DataFrame, top: int = 3) -> DataFrame:
    """The rows (tag, cnt) whose count is among the ``top`` highest distinct counts, most frequent first.

    The bar comes from the distinct counts alone, so no window holds all rows.
    """
    bar = counts.select("cnt").distinct().orderBy(F.col("cnt").desc()).limit(top).agg(F.min("cnt").alias("bar"))
    return counts.join(F.broadcast(bar)).where("cnt >= bar").select("tag", "cnt").orderBy(F.col("cnt").desc(), "tag")


def rank_within(counts: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """As ``trending`` for each group of ``by``."""
    return counts.withColumn("r", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("cnt").desc()))).where(F.col("r") <= top).drop("r")
