"""Recommenders: item and user based collaborative filtering, averages, and the hybrid switch.

Ratings are (user_id, item_id, stars); several ratings of one pair are averaged first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import amplified, jaccard, pearson
from quarry.operators import pairs
from quarry.operators.similar import agreeing, candidate_pairs, exact_is_cheaper, exact_jaccard, signatures
from quarry.storage import stored

#: Fixed values of the hybrid rule: grand average, share of the item average, share of the prediction, default similarity.
GRAND_AVERAGE, ITEM_SHARE, CF_SHARE, DEFAULT_SIM = 3.7961611526341503, 0.625, 0.6, 0.2


def averaged(ratings: DataFrame) -> DataFrame:
    """One row for each user and item with the mean of their ratings."""
    return ratings.groupBy("user_id", "item_id").agg(F.avg("stars").alias("stars"))


def similarity(rated: DataFrame, key: str, by: str, min_common: int = 3, near: DataFrame | None = None) -> DataFrame:
    """(a, b, sim): Pearson similarity of all pairs of ``key``, or of the pairs ``near`` (a < b) only, with enough common
    ``by``, where it is positive.

    Keys with too few ratings go before pairs are met, since they can have no pair.
    """
    enough = rated.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_common).select(key)
    kept = rated.join(enough, key, "left_semi")
    if near is None:
        return _pearson(pairs.met(kept, key, [by], "stars", min_common)).select("a", "b", "sim")
    a = kept.select(by, F.col(key).alias("a"), F.col("stars").alias("x"))
    b = kept.select(by, F.col(key).alias("b"), F.col("stars").alias("y"))
    sums = near.select("a", "b").join(a, "a").join(b, ["b", by]).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return _pearson(sums.where(F.col("n") >= min_common)).select("a", "b", "sim")


def _pearson(sums: DataFrame) -> DataFrame:
    """(a, b, n, sim) of sums over common ratings, where the similarity is positive."""
    sim = F.round(pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]), 6)
    return sums.select("a", "b", "n", sim.alias("sim")).where("sim > 0")


def item_similarity(rated: DataFrame, min_common: int = 3) -> DataFrame:
    return similarity(rated, "item_id", "user_id", min_common)


def user_similarity(rated: DataFrame, min_common: int = 3, near: DataFrame | None = None) -> DataFrame:
    return similarity(rated, "user_id", "item_id", min_common, near)


def user_similarity_lsh(rated: DataFrame, min_items: int = 3, threshold: float = 0.01, n_hashes: int = 50) -> DataFrame:
    """User similarity of min-hash candidates only: Jaccard at the threshold, enough common items, positive Pearson.

    As in ``similar.lsh_jaccard``, similar pairs or candidates are found first, whichever are fewer.
    """
    enough = rated.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_items).select("user_id")
    kept = stored(rated.join(enough, "user_id", "left_semi"), "rated")
    sets = kept.select(F.col("user_id").alias("id"), F.col("item_id").alias("member"))
    signs = stored(signatures(sets, n_hashes), "signatures")
    if not exact_is_cheaper(sets, signs):
        near = stored(exact_jaccard(sets, threshold, candidate_pairs(signs)).where("common >= 3").select("a", "b"), "near")
        return user_similarity(kept, near=near)
    found = _pearson(pairs.met(kept, "user_id", ["item_id"], "stars", 3))
    sizes = sets.groupBy("id").agg(F.count("*").alias("m"))
    both = found.join(sizes.select(F.col("id").alias("a"), F.col("m").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("m").alias("nb")), "b")
    return agreeing(both.where(jaccard(F.col("n"), F.col("na"), F.col("nb")) >= threshold).select("a", "b", "sim"), signs)


def both_ways(model: DataFrame) -> DataFrame:
    return model.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim").unionByName(model.select(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))


def nearest(df: DataFrame, by: list[str], neighbour: str, k: int) -> DataFrame:
    """The ``k`` most similar neighbours of each key; ties go to the lesser neighbour."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.col(neighbour)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def weighed(test: DataFrame, own: DataFrame, model: DataFrame, user: str, item: str) -> DataFrame:
    """(user, item, y, sim, ...) of the test pairs (user, item) and the rows (user, y, ...) of ``own`` whose y is similar to
    the item; distinct test pairs.

    Pairs meet the item's neighbours or the user's rows first, whichever are fewer; the other join leaves what fits both.
    """
    test, own, two = stored(test, "asked"), stored(own, "own"), stored(both_ways(model), "model").withColumnRenamed("x", item)
    size = lambda other, by: test.groupBy(by).agg(F.count("*").alias("n")).join(other.groupBy(by).agg(F.count("*").alias("m")), by).agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()[0]
    if size(two, item) <= size(own, user):
        return test.join(two, item).join(own, [user, "y"])
    return test.join(own, user).join(two, [item, "y"])


def predict_by_items(test: DataFrame, rated: DataFrame, model: DataFrame, k: int = 9) -> DataFrame:
    """(user_id, item_id, stars) of test pairs that have a similar item among the user's rated ones."""
    own = rated.select("user_id", F.col("item_id").alias("y"), "stars")
    best = nearest(weighed(test.distinct(), own, model, "user_id", "item_id"), ["user_id", "item_id"], "y", k)
    return best.groupBy("user_id", "item_id").agg((F.sum(F.col("stars") * F.col("sim")) / F.sum("sim")).alias("stars"))


def user_means(rated: DataFrame) -> DataFrame:
    """A user's mean over items, each of which counts once."""
    return rated.groupBy("user_id").agg(F.avg("stars").alias("mean"))


def predict_by_users(test: DataFrame, rated: DataFrame, model: DataFrame, k: int = 9) -> DataFrame:
    """(user_id, item_id, stars): the user's mean plus the weighted deviations of similar users, within 0 and 5."""
    means = user_means(rated)
    raters = rated.join(means, "user_id").select("item_id", F.col("user_id").alias("y"), (F.col("stars") - F.col("mean")).alias("off"))
    best = nearest(weighed(test.distinct(), raters, model, "item_id", "user_id"), ["user_id", "item_id"], "y", k)
    moved = best.groupBy("user_id", "item_id").agg((F.sum(F.col("off") * F.col("sim")) / F.sum("sim")).alias("off"))
    stars = F.least(F.greatest(F.col("mean") + F.col("off"), F.lit(0.0)), F.lit(5.0))
    return moved.join(means, "user_id").select("user_id", "item_id", stars.alias("stars"))


def averages(ratings: DataFrame, key: str, given: DataFrame | None = None) -> DataFrame:
    """(key, mean) over all ratings; values of ``given`` (key, mean) win."""
    own = ratings.groupBy(key).agg(F.avg("stars").alias("mean"))
    if given is None:
        return own
    return own.join(given.withColumnRenamed("mean", "known"), key, "full").select(key, F.coalesce("known", "mean").alias("mean"))


def hybrid_model(rated: DataFrame) -> DataFrame:
    """The item model with case amplification."""
    return item_similarity(rated).select("a", "b", F.round(amplified(F.col("sim")), 6).alias("sim")).where("sim > 0")


def _against(sim) -> Column:
    """A similarity that sorts the greatest first."""
    return -(F.col(sim) if isinstance(sim, str) else sim).cast("double")


def predict_hybrid(test: DataFrame, ratings: DataFrame, model: DataFrame, k: int = 9, default_sim: float = DEFAULT_SIM) -> DataFrame:
    """(user_id, item_id, stars) of test pairs whose user and item are known.

    The average of item and user decides: over 4.5 gives 5, over 1.5 stands as it is, else it is mixed with the
    prediction from items (unmodelled pairs weigh ``default_sim``) and rounded half to even.
    """
    own = stored(averaged(ratings).select("user_id", F.col("item_id").alias("y"), "stars"), "own")
    known = stored(test.distinct().join(ratings.select("item_id").distinct(), "item_id", "left_semi"), "asked")
    # Of the user's items that the model does not pair with the item, those of least number come first: as many of the
    # user's first items as are wanted and paired always hold them. So no row is made of a test pair and a rated item.
    hits = weighed(known, own, model, "user_id", "item_id").groupBy("user_id", "item_id").agg(F.collect_list(F.struct(_against("sim").alias("s"), "y", "stars")).alias("hits"))
    lists = own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("y", "stars"))).alias("own"))
    met = known.join(hits, ["user_id", "item_id"], "left").join(lists, "user_id")
    none = F.filter(F.transform("own", lambda o: F.struct(F.lit(0.0).alias("s"), o["y"].alias("y"), o["stars"].alias("stars"))), lambda o: F.lit(False))
    met = met.select("user_id", "item_id", "own", F.coalesce("hits", none).alias("hits"))
    rest = F.filter(F.slice("own", F.lit(1), F.size("hits") + k), lambda o: ~F.array_contains(F.transform("hits", lambda h: h["y"]), o["y"]))
    rest = F.transform(F.slice(rest, 1, k), lambda o: F.struct(_against(F.lit(default_sim)).alias("s"), o["y"].alias("y"), o["stars"].alias("stars")))
    best = met.select("user_id", "item_id", F.slice(F.array_sort(F.concat("hits", rest)), 1, k).alias("best"))
    over = lambda of: F.aggregate("best", F.lit(0.0), lambda total, x: total + of(x))
    cf = best.select("user_id", "item_id", (over(lambda x: x["stars"] * -x["s"]) / over(lambda x: -x["s"])).alias("cf"))
    users, items = averages(ratings, "user_id").withColumnRenamed("mean", "um"), averages(ratings, "item_id").withColumnRenamed("mean", "im")
    both = cf.join(users, "user_id", "left").join(items, "item_id", "left")
    avg = ITEM_SHARE * F.coalesce("im", F.lit(GRAND_AVERAGE)) + (1 - ITEM_SHARE) * F.coalesce("um", F.lit(GRAND_AVERAGE))
    both = both.withColumn("avg", avg)
    mixed = F.bround(F.round(CF_SHARE * F.col("cf") + (1 - CF_SHARE) * F.col("avg"), 9), 0)
    return both.select("user_id", "item_id", F.when(F.col("avg") > 4.5, 5.0).when(F.col("avg") > 1.5, F.col("avg")).otherwise(mixed).alias("stars"))


def cold_pairs(test: DataFrame, ratings: DataFrame, rule: str = "or") -> DataFrame:
    """Test pairs whose user or item (rule ``or``), or both (``and``), are unknown, with the grand average."""
    u = ratings.select("user_id", F.lit(True).alias("ku")).distinct()
    i = ratings.select("item_id", F.lit(True).alias("ki")).distinct()
    cold_u, cold_i = F.col("ku").isNull(), F.col("ki").isNull()
    met = test.join(u, "user_id", "left").join(i, "item_id", "left")
    return met.where(cold_u | cold_i if rule == "or" else cold_u & cold_i).select("user_id", "item_id", F.lit(GRAND_AVERAGE).alias("stars"))


def predict_all(test: DataFrame, ratings: DataFrame, model: DataFrame, k: int = 9) -> DataFrame:
    """(user_id, item_id, stars) of known pairs by the hybrid, and of pairs with an unknown user or item by the grand average."""
    return predict_hybrid(test, ratings, model, k).unionByName(cold_pairs(test, ratings, "or"))


def rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (n, rmse) over pairs that both have."""
    both = predicted.select("user_id", "item_id", F.col("stars").alias("p")).join(truth.select("user_id", "item_id", F.col("stars").alias("t")), ["user_id", "item_id"])
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("p") - F.col("t")) * (F.col("p") - F.col("t")))).alias("rmse"))
