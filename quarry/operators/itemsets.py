"""Frequent itemsets: level-wise counting, SON candidates, PCY pruning and FP-growth.

Baskets come as distinct (basket, item) rows; a basket is never built as one row, so its size is no limit.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.pairs import met
from quarry.storage import stored

#: Up to this many frequent items, baskets of up to that many items are merged where they are equal.
FEW_ITEMS, MERGED_ITEMS = 200, 64


def basket_items(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item); rows with a null of either go."""
    return df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()


def larger_baskets(pairs: DataFrame, threshold: int) -> DataFrame:
    """The rows of baskets of more than ``threshold`` items."""
    wanted = pairs.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("basket")
    return pairs.join(wanted, "basket", "left_semi")


def alike(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, basket, item, weight): one basket, the least, for all of ``keys`` that have the same items, with their number.

    Only baskets of MERGED_ITEMS items or less are built as a row for that; larger ones stay as they are.
    """
    sizes = pairs.groupBy(*keys, "basket").agg(F.count("*").alias("n"))
    sized = pairs.join(sizes, [*keys, "basket"])
    small = sized.where(F.col("n") <= MERGED_ITEMS).groupBy(*keys, "basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    merged = small.groupBy(*keys, "items").agg(F.min("basket").alias("basket"), F.count("*").alias("weight"))
    large = sized.where(F.col("n") > MERGED_ITEMS).select(*keys, "basket", "item", F.lit(1).cast("long").alias("weight"))
    return stored(merged.select(*keys, "basket", F.explode("items").alias("item"), "weight").unionByName(large), "basket-items")


def parted(pairs: DataFrame, part: Column) -> DataFrame:
    """``pairs`` with the ``part`` of each basket; equal baskets of a part are one with a weight if items are few."""
    pairs = pairs.withColumn("part", part)
    return alike(pairs, ["part"]) if pairs.select("item").distinct().count() <= FEW_ITEMS else pairs


def _levels(pairs: DataFrame, keys: list[str], enough, least: int) -> list[DataFrame]:
    """Itemsets of each size with their count by ``keys``; ``enough``: counts to those that go on, which have ``least`` or
    more.

    Occurrences of the frequent sets of one size are joined with the larger frequent items of their baskets. With few
    items, equal baskets are one with a weight; with many, pairs are counted without a row for each occurrence, and only
    items of frequent pairs go on.
    """
    weighted = "weight" in pairs.columns
    counts = enough(pairs.groupBy(*keys, F.array("item").alias("items")).agg((F.sum("weight") if weighted else F.count("*")).alias("freq")))
    counts = stored(counts, "itemsets")
    single = counts.select(*keys, F.col("items")[0].alias("item"))
    pairs = pairs.join(single, [*keys, "item"], "left_semi")
    out = [counts]
    if weighted:
        pairs = stored(pairs, "basket-items")
    elif single.select("item").distinct().count() <= FEW_ITEMS:
        pairs = alike(pairs, keys)
    else:
        pairs = stored(pairs.withColumn("weight", F.lit(1).cast("long")), "basket-items")
        counts = stored(enough(_pair_counts(pairs, keys, least)), "itemsets")
        if counts.isEmpty():
            return out
        ends = counts.select(*keys, F.explode("items").alias("item")).distinct()
        pairs = stored(pairs.join(ends, [*keys, "item"], "left_semi"), "basket-items")
        out.append(counts)
    occur = pairs.select(*keys, "basket", "weight", F.array("item").alias("items"), F.col("item").alias("last"))
    more = pairs.select(*keys, "basket", F.col("item").alias("next"))
    follow = None  # what may stand behind an item: the frequent pairs, if they are known

    def grow(of: DataFrame) -> DataFrame:
        found = of.join(more, [*keys, "basket"]).where("next > last")
        if follow is not None:
            found = found.join(follow, [*keys, "last", "next"], "left_semi")
        return found.select(*keys, "basket", "weight", F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last"))

    if len(out) == 2:
        occur = stored(grow(occur).join(counts.select(*keys, "items"), [*keys, "items"], "left_semi"), "occurrences")
        follow = counts.select(*keys, F.col("items")[0].alias("last"), F.col("items")[1].alias("next"))
    while True:
        grown = grow(occur)
        counts = stored(enough(grown.groupBy(*keys, "items").agg(F.sum("weight").alias("freq"))), "itemsets")
        if counts.isEmpty():
            return out
        out.append(counts)
        occur = stored(grown.join(counts.select(*keys, "items"), [*keys, "items"], "left_semi"), "occurrences")


def _pair_counts(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, items, freq) of the pairs of items in ``least`` baskets or more."""
    rows = pairs.select("basket", F.struct(*keys, "item").alias("id"))
    found = met(rows, "id", ["basket"], at_least=least)
    return found.select(*[F.col("a")[c].alias(c) for c in keys], F.array(F.col("a")["item"], F.col("b")["item"]).alias("items"), F.col("n").alias("freq"))


def frequent_itemsets(pairs: DataFrame, min_count: int) -> DataFrame:
    """(items, freq) of all itemsets in ``min_count`` baskets or more, by exact counting level by level."""
    levels = _levels(pairs, [], lambda c: c.where(F.col("freq") >= min_count), min_count)
    out = levels[0]
    for c in levels[1:]:
        out = out.unionByName(c)
    return out


def son_candidates(pairs: DataFrame, min_count: int, part: Column) -> DataFrame:
    """Distinct itemsets that are frequent in some part of the baskets at the support scaled to its size.

    ``part`` tells a basket's part, so the candidates do not hang on how rows happen to be partitioned. Baskets may have
    a ``weight``, how many of the part they stand for.
    """
    pairs = pairs.withColumn("part", part)
    weight = F.col("weight") if "weight" in pairs.columns else F.lit(1).cast("long")
    baskets = pairs.select("part", "basket", weight.alias("weight")).distinct().groupBy("part").agg(F.sum("weight").alias("n"))
    total = baskets.agg(F.sum("n")).first()[0] or 1
    bar = baskets.select("part", F.ceil(F.lit(min_count) * F.col("n") / F.lit(total)).alias("bar"))
    levels = _levels(pairs, ["part"], lambda c: c.join(F.broadcast(bar), "part").where("freq >= bar").drop("bar"), bar.agg(F.coalesce(F.min("bar"), F.lit(1))).first()[0])
    out = levels[0]
    for c in levels[1:]:
        out = out.unionByName(c)
    return out.select("items").distinct()


def counted(pairs: DataFrame, candidates: DataFrame, min_count: int) -> DataFrame:
    """SON's second pass: exact counts of candidate itemsets, of which the frequent stay.

    Candidates have all their subsets among them, as those of the first pass do. Baskets are walked along candidates only:
    an occurrence of a set grows by later items of its basket while the result is a candidate and frequent.
    """
    pairs = pairs.select("basket", "item", *[c for c in pairs.columns if c == "weight"])
    wanted = stored(candidates.select(F.array_sort("items").alias("items")), "candidates")
    levels = _levels(pairs, [], lambda c: c.where(F.col("freq") >= min_count).join(wanted, "items", "left_semi"), min_count)
    out = levels[0]
    for c in levels[1:]:
        out = out.unionByName(c)
    return out


def frequent_pairs_pcy(pairs: DataFrame, min_count: int, buckets: int = 1 << 20) -> DataFrame:
    """(items, freq) of frequent pairs; only pairs whose hash bucket is frequent are counted by themselves."""
    single = pairs.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count).select("item")
    kept = stored(pairs.join(single, "item", "left_semi"), "basket-items")
    both = kept.join(kept.select("basket", F.col("item").alias("other")), "basket").where("item < other")
    both = both.withColumn("bucket", F.pmod(F.xxhash64("item", "other"), F.lit(buckets)))
    frequent = both.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("bucket")
    return both.join(frequent, "bucket", "left_semi").groupBy(F.array("item", "other").alias("items")).agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count)


def fp_growth(pairs: DataFrame, min_count: int) -> DataFrame:
    """(items, freq) by FP-growth; half a basket under the count keeps rounding from dropping sets at the bar."""
    baskets = pairs.groupBy("basket").agg(F.collect_set("item").alias("items"))
    total = max(1, pairs.select("basket").distinct().count())
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / total), minConfidence=1.0).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many itemsets each of two results has, and how many both: rows (name, n)."""
    a, b = a.select(F.array_sort("items").alias("items")).distinct(), b.select(F.array_sort("items").alias("items")).distinct()
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("first", a).unionByName(count("second", b)).unionByName(count("both", a.join(b, "items")))
