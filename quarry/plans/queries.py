"""The registered queries of the mining operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.similarity import amplified
from quarry.operators import cluster, graph, itemsets, recommend, similar, sketch, text
from quarry.plans import views
from quarry.storage import stored
from quarry.streaming import replay

#: Share of the baskets that a frequent itemset is in, basket sizes that are too small, and parts of SON's first pass.
SUPPORT, SMALL_BASKET, PARTS = 0.003, 3, 8
#: Common parts of two customers that make an edge; clusters of k-means and BFR; words that no profile has.
EDGE, CLUSTERS, STOPWORDS = 7, 8, ["the", "and", "of"]


def _support(pairs: DataFrame) -> int:
    return max(1, math.ceil(SUPPORT * pairs.select("basket").distinct().count()))


def _joined(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("size"), *[F.col("freq").cast("long").alias("freq")] * ("freq" in sets.columns))


def ratings_avg(spark, d):
    return recommend.averaged(views.ratings(spark, d)).select("user_id", "item_id", F.round("stars", 6).alias("stars"))


def cf_item_similarity(spark, d):
    return recommend.item_similarity(recommend.averaged(views.ratings(spark, d)))


def cf_item_amplified(spark, d):
    return recommend.item_similarity(recommend.averaged(views.ratings(spark, d))).select("a", "b", F.round(amplified(F.col("sim")), 6).alias("sim"))


def cf_user_similarity(spark, d):
    return recommend.user_similarity(recommend.averaged(views.ratings(spark, d)))


def cf_user_similarity_lsh(spark, d):
    return recommend.user_similarity_lsh(recommend.averaged(views.ratings(spark, d)))


def _predicted(df):
    return df.select("user_id", "item_id", F.round("stars", 6).alias("stars"))


def cf_item_predict(spark, d):
    rated = stored(recommend.averaged(views.train(spark, d)), "rated")
    return _predicted(recommend.predict_by_items(views.test(spark, d).select("user_id", "item_id"), rated, recommend.item_similarity(rated)))


def cf_user_predict(spark, d):
    rated = stored(recommend.averaged(views.train(spark, d)), "rated")
    return _predicted(recommend.predict_by_users(views.test(spark, d).select("user_id", "item_id"), rated, recommend.user_similarity(rated)))


def user_avg(spark, d):
    return recommend.averages(views.ratings(spark, d), "user_id").select("user_id", F.round("mean", 6).alias("mean"))


def business_avg(spark, d):
    """Item averages, where those of a given model win: here the averages of the training part."""
    given = recommend.averages(views.train(spark, d), "item_id")
    return recommend.averages(views.ratings(spark, d), "item_id", given).select("item_id", F.round("mean", 6).alias("mean"))


def user_mean_of_means(spark, d):
    return recommend.user_means(recommend.averaged(views.ratings(spark, d))).select("user_id", F.round("mean", 6).alias("mean"))


def hybrid_predict(spark, d):
    train = stored(views.train(spark, d), "train")
    model = recommend.hybrid_model(recommend.averaged(train))
    return _predicted(recommend.predict_hybrid(views.test(spark, d).select("user_id", "item_id"), train, model))


def _strange(pairs):
    """Distinct test pairs of which some have an unknown user or item: customers and parts without any order."""
    return pairs.select("user_id", (F.col("item_id") * 2).alias("item_id")).unionByName(pairs.select((F.col("user_id") * 2).alias("user_id"), (F.col("item_id") * 2).alias("item_id")))


def cold_start_or(spark, d):
    return _predicted(recommend.cold_pairs(_strange(views.test(spark, d).select("user_id", "item_id").distinct()), views.train(spark, d), "or"))


def hybrid_predict_all(spark, d):
    """All test pairs in one result: the hybrid for known users and items, the grand average for the rest."""
    train = stored(views.train(spark, d), "train")
    known = stored(views.test(spark, d).select("user_id", "item_id").distinct(), "test")
    pairs = stored(known.unionByName(_strange(known)).distinct(), "pairs")
    return _predicted(recommend.predict_all(pairs, train, recommend.hybrid_model(recommend.averaged(train))))


def cold_start_and(spark, d):
    return _predicted(recommend.cold_pairs(_strange(views.test(spark, d).select("user_id", "item_id").distinct()), views.train(spark, d), "and"))


def rmse(spark, d):
    rated = stored(recommend.averaged(views.train(spark, d)), "rated")
    found = recommend.predict_by_items(views.test(spark, d).select("user_id", "item_id"), rated, recommend.item_similarity(rated))
    return recommend.rmse(_predicted(found), recommend.averaged(views.test(spark, d))).select("n", F.round("rmse", 6).alias("rmse"))


def basket_build(spark, d):
    sets = views.baskets(spark, d).groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.select("basket", F.array_join("items", ",").alias("items"))


def basket_build_by_item(spark, d):
    """The other way round: the orders of each brand."""
    sets = views.baskets(spark, d).groupBy("item").agg(F.array_sort(F.collect_set("basket")).alias("baskets"))
    return sets.select("item", F.size("baskets").cast("long").alias("n"), F.array_join(F.col("baskets").cast("array<string>"), ",").alias("baskets"))


def frequent_itemsets_by_item(spark, d):
    """Sets of customers who share EDGE parts or more: baskets are the customers of each part."""
    pairs = stored(itemsets.basket_items(views.interactions(spark, d), "item_id", "user_id"), "baskets")
    return _joined(itemsets.frequent_itemsets(pairs, EDGE))


def basket_size_filter(spark, d):
    return itemsets.larger_baskets(views.baskets(spark, d), SMALL_BASKET)


def frequent_itemsets(spark, d):
    pairs = stored(views.baskets(spark, d), "baskets")
    return _joined(itemsets.frequent_itemsets(pairs, _support(pairs)))


def frequent_itemsets_fpgrowth(spark, d):
    pairs = views.baskets(spark, d)
    return _joined(itemsets.fp_growth(pairs, _support(pairs)))


def frequent_itemsets_son(spark, d):
    pairs = stored(views.baskets(spark, d), "baskets")
    s = _support(pairs)
    pairs = itemsets.parted(pairs, F.pmod("basket", F.lit(PARTS)))
    return _joined(itemsets.counted(pairs, itemsets.son_candidates(pairs, s, F.col("part")), s))


def son_candidates(spark, d):
    pairs = stored(views.baskets(spark, d), "baskets")
    s = _support(pairs)
    return _joined(itemsets.son_candidates(itemsets.parted(pairs, F.pmod("basket", F.lit(PARTS))), s, F.col("part")))


def frequent_pairs_pcy(spark, d):
    pairs = views.baskets(spark, d)
    return _joined(itemsets.frequent_pairs_pcy(pairs, _support(pairs)))


def itemset_overlap(spark, d):
    pairs = views.baskets(spark, d)
    s = _support(pairs)
    return itemsets.overlap(itemsets.frequent_itemsets(itemsets.larger_baskets(pairs, SMALL_BASKET), s), itemsets.fp_growth(pairs, s))


def _item_sets(spark, d):
    return views.interactions(spark, d).select(F.col("item_id").alias("id"), F.col("user_id").alias("member"))


def minhash_signatures(spark, d):
    long = similar.long_signatures(similar.signatures(_item_sets(spark, d)))
    return long.select(F.col("id").alias("item_id"), F.col("band").cast("long").alias("band"), F.col("value").cast("long").alias("value"))


def lsh_candidate_pairs(spark, d):
    return similar.candidate_pairs(similar.signatures(_item_sets(spark, d)))


def lsh_jaccard_pairs(spark, d):
    return similar.lsh_jaccard(_item_sets(spark, d), 0.05).select("a", "b", F.round("sim", 6).alias("sim"))


def exact_jaccard_pairs(spark, d):
    return similar.exact_jaccard(_item_sets(spark, d), 0.05).select("a", "b", F.round("sim", 6).alias("sim"))


def tf(spark, d):
    return text.term_frequency(views.reviews(spark, d), "item_id", "text", STOPWORDS).select("key", "word", "n", F.round("tf", 6).alias("tf"))


def idf(spark, d):
    docs = views.reviews(spark, d)
    out = text.inverse_frequency(text.term_frequency(docs, "item_id", "text", STOPWORDS), docs.agg(F.countDistinct("item_id").alias("n_keys")))
    return out.select("word", "df", F.round("idf", 6).alias("idf"))


def tfidf_top200(spark, d):
    return text.profiles(views.reviews(spark, d), "item_id", "text", STOPWORDS).select("key", "word", F.round("score", 6).alias("score"))


def user_profile(spark, d):
    docs = views.reviews(spark, d)
    return text.user_profiles(docs, text.profiles(docs, "item_id", "text", STOPWORDS))


def content_predict(spark, d):
    docs = views.reviews(spark, d)
    items = text.profiles(docs, "item_id", "text", STOPWORDS)
    out = text.predict(docs.select("user_id", "item_id"), text.user_profiles(docs, items), items)
    return out.select("user_id", "item_id", F.round("sim", 6).alias("sim"))


def _edges(spark, d):
    pairs = views.interactions(spark, d).select(F.col("user_id").alias("id"), F.col("item_id").alias("member"))
    return graph.stored(graph.co_interaction(pairs, EDGE), "edges")


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_vertices(spark, d):
    return graph.vertices(_edges(spark, d))


def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d))


def connected_components(spark, d):
    edges = _edges(spark, d)
    return graph.connected(edges, graph.vertices(edges))


def modularity(spark, d):
    edges = _edges(spark, d)
    return graph.modularity(edges, graph.connected(edges, graph.vertices(edges))).select(F.round("q", 6).alias("q"))


def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


def edge_betweenness(spark, d):
    return graph.betweenness(_edges(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def girvan_newman(spark, d):
    return graph.girvan_newman(_edges(spark, d))


def _labelled(spark, d):
    return views.points(spark, d).withColumn("cluster", F.col("label"))


def cluster_stats(spark, d):
    out = cluster.cluster_stats(_labelled(spark, d))
    return out.select(F.col("cluster").cast("long").alias("cluster"), F.col("dim").cast("long").alias("dim"), "n", *[F.round(c, 6).alias(c) for c in ("sum", "sumsq", "std")])


def _described(spark, d):
    """Center and deviation of each label's points, as arrays."""
    s = cluster.cluster_stats(_labelled(spark, d))
    both = s.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("sum") / F.col("n")).alias("c"), "std"))).alias("v"))
    return both.select("cluster", F.transform("v", lambda x: x["c"]).alias("center"), F.transform("v", lambda x: x["std"]).alias("std"))


def nearest_centroid(spark, d):
    out = cluster.nearest_centroid(views.points(spark, d), _described(spark, d))
    return out.select("point_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"))


def mahalanobis_assign(spark, d):
    out = cluster.mahalanobis_assign(views.points(spark, d), _described(spark, d))
    return out.select("point_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"))


def kmeans(spark, d):
    return cluster.kmeans(views.points(spark, d), CLUSTERS)[0]


def bfr_assign(spark, d):
    return cluster.bfr(views.points(spark, d), CLUSTERS).assignment


def bfr_rounds(spark, d):
    rows = cluster.bfr(views.points(spark, d), CLUSTERS).rounds
    return spark.createDataFrame(rows, "round_id long, nof_cluster_discard long, nof_point_discard long, nof_cluster_compression long, nof_point_compression long, nof_point_retained long")


def nmi(spark, d):
    """How far the clusters of nearest label centers agree with the labels."""
    pts = views.points(spark, d)
    both = cluster.nearest_centroid(pts, _described(spark, d)).join(pts.select("point_id", "label"), "point_id")
    return cluster.nmi(both.select(F.col("cluster").alias("x"), F.col("label").alias("y"))).select(F.round("nmi", 6).alias("nmi"))


def bloom_build(spark, d):
    return sketch.bloom_build(views.table(spark, d, "nation"), "n_name")


def bloom_probe(spark, d):
    bloom = sketch.bloom_build(views.table(spark, d, "nation"), "n_name")
    names = views.table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(views.table(spark, d, "customer").select(F.col("c_name").alias("name")))
    return sketch.bloom_probe(names, "name", bloom).select("name", F.col("hit").cast("long").alias("hit"))


def fm_estimate(spark, d):
    return sketch.fm_estimate(views.table(spark, d, "customer"), "c_name").select("truth", F.round("estimate", 6).alias("estimate"))


def sliding_window_distinct(spark, d):
    return sketch.sliding_distinct(views.table(spark, d, "events"), "ts", "user_id", "6 hours", "2 hours")


def sliding_window_fm(spark, d):
    events = views.table(spark, d, "events").select(F.window("ts", "6 hours", "2 hours")["start"].alias("window_start"), F.col("user_id").cast("string").alias("user"))
    return sketch.fm_estimate(events, "user", ["window_start"]).select("window_start", "truth", F.round("estimate", 6).alias("estimate"))


def reservoir_sample(spark, d):
    return sketch.reservoir_sample(views.table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 100)


def trending_top3(spark, d):
    tag = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    return sketch.trending(views.table(spark, d, "events").groupBy(tag.alias("tag")).agg(F.count("*").alias("cnt")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ratings_avg, cf_item_similarity, cf_item_amplified, cf_user_similarity, cf_user_similarity_lsh, cf_item_predict, cf_user_predict, user_avg,
        business_avg, user_mean_of_means, hybrid_predict, hybrid_predict_all, cold_start_or, cold_start_and, rmse, basket_build, basket_build_by_item, basket_size_filter,
        frequent_itemsets, frequent_itemsets_by_item, frequent_itemsets_fpgrowth, frequent_itemsets_son, son_candidates, frequent_pairs_pcy, itemset_overlap, minhash_signatures,
        lsh_candidate_pairs, lsh_jaccard_pairs, exact_jaccard_pairs, tf, idf, tfidf_top200, user_profile, content_predict, graph_edges, graph_vertices,
        graph_degree, connected_components, modularity, label_propagation, edge_betweenness, girvan_newman, cluster_stats, nearest_centroid,
        mahalanobis_assign, kmeans, bfr_assign, bfr_rounds, nmi, bloom_build, bloom_probe, fm_estimate, sliding_window_distinct, sliding_window_fm,
        reservoir_sample, trending_top3, replay.stream_fm, replay.stream_trending, replay.stream_reservoir, replay.stream_tag_reports,
        replay.stream_bloom,
    )
}
