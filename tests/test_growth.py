"""What is shuffled and held grows with the input: the steps that pairs, predictions, itemsets and tag reports share."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, itemsets, pairs, recommend, similar
from quarry.plans import views
from quarry.streaming import replay


def shuffled(spark, run):
    """What ``run`` gives, and the number of rows it shuffles."""
    sc = spark.sparkContext
    empty = sc._gateway.jvm.java.util.ArrayList()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), empty)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    found = run()
    return found, total() - before


def rated(n_users=60, n_items=600, each=40, seed=3):
    """(user, item, stars) with many items, few of which a user has."""
    draw = random.Random(seed)
    return [(u, i, float(draw.randint(1, 5))) for u in range(n_users) for i in sorted(draw.sample(range(n_items), each))]


def sums_of(data, at_least):
    """Pairs of items with n, sx, sy, sxx, syy, sxy over common users."""
    by_user, out = {}, {}
    for u, i, s in data:
        by_user.setdefault(u, []).append((i, s))
    for own in by_user.values():
        for (a, x), (b, y) in combinations(sorted(own), 2):
            t = out.setdefault((a, b), [0] * 6)
            for k, v in enumerate((1, x, y, x * x, y * y, x * y)):
                t[k] += v
    return {k: v for k, v in out.items() if v[0] >= at_least}


@pytest.mark.parametrize("name", ["int", "string", "far", "values", "few"])
def test_met_pairs_against_plain_python(spark, monkeypatch, name):
    data = rated()
    if name == "values":
        data = [(u, i, s + k / 1024) for k, (u, i, s) in enumerate(data)]  # more values than a byte has
    if name != "few":
        monkeypatch.setattr(pairs, "FEW_KEYS", 0)
    of = {"string": lambda i: f"i{i:04}", "far": lambda i: i - (1 << 40)}.get(name, lambda i: i)
    df = spark.createDataFrame([(u, of(i), s) for u, i, s in data], f"u long, i {'string' if name == 'string' else 'long'}, s double")
    got = {(r["a"], r["b"]): r for r in pairs.met(df, "i", ["u"], "s", 2).collect()}
    want = {(of(a), of(b)): v for (a, b), v in sums_of(data, 2).items()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(x, y) for k, v in want.items() for x, y in zip(v, [got[k][c] for c in ("n", *pairs.SUMS)]))
    assert {k: r["n"] for k, r in got.items()} == {(r["a"], r["b"]): r["n"] for r in pairs.met(df, "i", ["u"], at_least=2).collect()}


def test_a_key_may_go_on_over_many_pieces(monkeypatch):
    monkeypatch.setattr(pairs, "HELD_PAIRS", 7)
    draw = random.Random(1)
    rows = sorted((a, draw.randint(1, 5), sorted(draw.sample(range(a + 1, 40), draw.randint(1, 9)))) for a in (1, 3, 4, 9) for _ in range(30))
    want, needs = Counter(), {1: 3, 3: 9, 4: 1, 9: 12}
    for a, _, bs in rows:
        want.update((a, b) for b in bs)
    for valued in (False, True):
        batches = []
        for k in range(0, len(rows), 11):
            part = rows[k : k + 11]
            cols = {"a": pa.array([r[0] for r in part], pa.int32()), "x": pa.array([r[1] for r in part], pa.float64()), "need": pa.array([needs[r[0]] for r in part], pa.int32()),
                "b": pa.array([r[2] for r in part], pa.list_(pa.int32())), "y": pa.array([[b / 2 for b in r[2]] for r in part], pa.list_(pa.float64()))}
            batches.append(pa.RecordBatch.from_pydict(cols))
        got = {(int(a), int(b)): n for x, y, sums in pairs._summed(iter(batches), valued, None, 1) for a, b, *n in zip(x, y, *sums)}
        assert {k: int(v[0]) for k, v in got.items()} == {k: n for k, n in want.items() if n >= needs[k[0]]}
        if valued:
            assert all(v[1] == sum(x for a, x, bs in rows if a == k[0] and k[1] in bs) and v[2] == np.float64(k[1] / 2 * v[0]) for k, v in got.items())


def test_pairs_are_no_rows_of_a_shuffle(spark, monkeypatch):
    """47,000 pairs of 2,400 ratings: before, each was a row."""
    monkeypatch.setattr(pairs, "FEW_KEYS", 0)
    data = rated()
    df = spark.createDataFrame(data, "user_id long, item_id long, stars double").repartition(4).persist()
    sets = df.select(F.col("item_id").alias("id"), F.col("user_id").alias("member")).persist()
    for run in (lambda: recommend.item_similarity(df).collect(), lambda: similar.exact_jaccard(sets, 0.4).count(), lambda: graph.co_interaction(sets, 3).count(),
                lambda: itemsets.frequent_itemsets(itemsets.basket_items(df, "user_id", "item_id"), 3)):
        assert shuffled(spark, run)[1] < 12 * len(data) < sum(v[0] for v in sums_of(data, 1).values())


def test_tasks_follow_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FEW_KEYS", 0)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1000)
    sets = spark.createDataFrame(rated(), "member long, id long, s double").select("id", "member")
    found = similar.common_members(sets)
    assert found.rdd.getNumPartitions() >= 47 and "hashpartitioning(a#" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert ", b#" not in "".join(line.split("hashpartitioning(")[1] for line in plan.split("\n") if "hashpartitioning(" in line)


def test_shuffles_are_spread_by_rows(spark, monkeypatch, tmp_path):
    key, path = "spark.sql.shuffle.partitions", f"{tmp_path}/lineitem.parquet"
    before = spark.conf.get(key)
    spark.range(1000).withColumnRenamed("id", "l_orderkey").write.parquet(path)
    try:
        views.spread(spark, str(tmp_path))
        assert spark.conf.get(key) == before
        monkeypatch.setattr(views, "TASK_ROWS", 90)
        views.spread(spark, str(tmp_path))
        assert spark.conf.get(key) == "12" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
    finally:
        spark.conf.set(key, before)


def test_candidates_first_or_similar_pairs_first(spark, monkeypatch):
    data = rated(each=60, n_items=300)
    df = spark.createDataFrame(data, "user_id long, item_id long, stars double")
    sets = df.select(F.col("item_id").alias("id"), F.col("user_id").alias("member"))
    found = {}
    for first in (True, False):
        for module in (similar, recommend):
            monkeypatch.setattr(module, "exact_is_cheaper", lambda *_: first)
        found[first] = [sorted(map(tuple, d.collect())) for d in (similar.lsh_jaccard(sets, 0.15), recommend.user_similarity_lsh(df))]
    assert found[True] == found[False] and all(len(f) > 5 for f in found[True])


def test_similar_pairs_first_unless_members_are_popular(spark):
    sparse = spark.createDataFrame(rated(), "member long, id long, s double").select("id", "member")
    assert similar.exact_is_cheaper(sparse, similar.signatures(sparse))
    popular = spark.createDataFrame([(i, m) for i in range(400) for m in (2121, *range(i * 6, i * 6 + 6, 2))], "id long, member long")
    assert not similar.exact_is_cheaper(popular, similar.signatures(popular, 1))


def predictions(test, data, model, default=None, k=9):
    """The weighted mean of the nearest rated items of each test pair, by the product of both."""
    sims = {**model, **{(b, a): s for (a, b), s in model.items()}}
    out = {}
    for u, i in set(test):
        near = sorted((-sims.get((i, y), default), y, s) for v, y, s in data if v == u and (default is not None or (i, y) in sims))[:k]
        if near:
            out[u, i] = sum(-w * s for w, _, s in near) / sum(-w for w, _, _ in near)
    return out


@pytest.mark.parametrize("share", [0.002, 0.4])
def test_predictions_without_the_product(spark, share):
    """Sparse and dense models; similarities under, at and over the default; half of the rows shuffled before."""
    draw = random.Random(5)
    data = rated(40, 120, 30)
    test = [(u, i) for u in range(45) for i in draw.sample(range(130), 25)]
    model = {(a, b): draw.choice([0.05, 0.2, 0.3, 0.9]) for a, b in combinations(range(120), 2) if draw.random() < share}
    frames = [spark.createDataFrame(test, "user_id long, item_id long"), spark.createDataFrame(data, "user_id long, item_id long, stars double").repartition(4).persist(),
        spark.createDataFrame([(*k, s) for k, s in model.items()], "a long, b long, sim double")]
    got = {(r[0], r[1]): r[2] for r in recommend.predict_by_items(*frames).collect()}
    assert got == {k: pytest.approx(v) for k, v in predictions(test, data, model).items()}
    # Averages of 1.5 and less let the prediction through: 0.6 of it and 0.4 of the average, rounded.
    low = frames[1].withColumn("stars", F.when(F.col("item_id") % 4 == 0, 3.0).otherwise(F.lit(0.25)))
    plain = [(u, i, 3.0 if i % 4 == 0 else 0.25) for u, i, _ in data]
    found, rows = shuffled(spark, lambda: recommend.predict_hybrid(frames[0], low, frames[2]).collect())
    mean = lambda key, v: float(np.mean([s for *k, s in plain if k[key] == v]))
    want = {}
    for (u, i), cf in predictions([t for t in test if t[1] < 120], plain, model, 0.2).items():
        avg = 0.625 * mean(1, i) + 0.375 * mean(0, u)
        want[u, i] = avg if avg > 1.5 else float(round(round(0.6 * cf + 0.4 * avg, 9)))
    assert {(r[0], r[1]): r[2] for r in found} == {k: pytest.approx(v) for k, v in want.items()}
    assert share > 0.1 or rows < len(want) * 30 / 2  # a test pair and a rated item were a row, twice


def test_equal_baskets_count_once_each(spark, monkeypatch):
    """3,000 baskets of 40 different ones; each was walked by itself."""
    draw = random.Random(2)
    kinds = [sorted(draw.sample("abcdefgh", draw.randint(1, 5))) for _ in range(40)]
    data = [(k, x) for k in range(3000) for x in kinds[k % 40]]
    df = spark.createDataFrame(data, "basket long, item string").repartition(4).persist()
    weighted = itemsets.parted(df, F.pmod("basket", F.lit(4)))
    assert weighted.select("part", "basket").distinct().count() == len({(k % 4, tuple(kinds[k])) for k in range(40)})
    want = Counter(",".join(c) for k in range(3000) for n in range(1, 6) for c in combinations(kinds[k % 40], n))
    want = {k: n for k, n in want.items() if n >= 300}
    named = lambda d: {",".join(r["items"]): r["freq"] for r in d.collect()}
    sets = itemsets.son_candidates(weighted, 300, F.col("part"))
    assert {tuple(r["items"]) for r in sets.collect()} == {tuple(r["items"]) for r in itemsets.son_candidates(df, 300, F.pmod("basket", F.lit(4))).collect()}
    found, rows = shuffled(spark, lambda: named(itemsets.counted(weighted, sets, 300)))
    assert found == want and len(want) > 20 and rows < len(data)
    monkeypatch.setattr(itemsets, "MERGED_ITEMS", 3)
    assert named(itemsets.frequent_itemsets(df, 300)) == want
    monkeypatch.setattr(itemsets, "FEW_ITEMS", 2)
    assert named(itemsets.frequent_itemsets(df, 300)) == want
    assert {tuple(r["items"]) for r in itemsets.son_candidates(df, 300, F.pmod("basket", F.lit(4))).collect()} == {tuple(r["items"]) for r in sets.collect()}


def test_tag_reports_of_batches_that_are_tables(spark, tmp_path):
    """No Python task gets the events of a batch: tasks number them, and the state goes from batch to batch by a file."""
    draw, path = random.Random(4), str(tmp_path / "reports")
    tags = {k: [f"t{draw.randint(0, 5)}"] * draw.randint(0, 2) for k in range(600)}
    reports = replay.TagReports(path, 20, 2, 9)
    for batch, ids in enumerate((range(0, 300), [], range(300, 600))):
        rows = [(k, tags[k]) for k in ids]
        draw.shuffle(rows)
        reports(spark.createDataFrame(rows, "event_id long, tags array<string>").repartition(3), batch)
    got = sorted(map(tuple, spark.read.parquet(f"{path}/part=*").select("seen", "event_id", "tag", "cnt").collect()))
    plain, kept, counts, want = replay.TagReservoir(20, 2, 9), [], Counter(), []
    for seen, k in enumerate((k for k in range(600) if tags[k]), 1):
        plain.take(seen, tags[k], kept, counts)
        want += [(seen, k, t, n) for t, n in plain.report(counts)]
    assert got == sorted(want)
