"""Hand-computed cases of the mining operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import hashing, similarity
from quarry.operators import cluster, graph, itemsets, recommend, similar, sketch, text


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


BASKETS = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([(i, x) for i, b in enumerate(BASKETS) for x in b], "basket long, item string").cache()


EXPECTED = [("a", 4), ("a,b", 3), ("a,c", 3), ("b", 4), ("b,c", 3), ("c", 4)]


def named(df):
    return sorted((",".join(r["items"]), r["freq"]) for r in df.collect())


def test_itemsets_agree(baskets):
    assert named(itemsets.frequent_itemsets(baskets, 3)) == EXPECTED
    assert named(itemsets.fp_growth(baskets, 3)) == EXPECTED
    candidates = itemsets.son_candidates(baskets, 3, F.pmod("basket", F.lit(2)))
    assert {x for x, _ in EXPECTED} <= {",".join(r["items"]) for r in candidates.collect()}
    assert named(itemsets.counted(baskets, candidates, 3)) == EXPECTED
    assert named(itemsets.frequent_pairs_pcy(baskets, 3)) == [x for x in EXPECTED if "," in x[0]]
    assert rows(itemsets.overlap(itemsets.frequent_itemsets(baskets, 3), itemsets.fp_growth(baskets, 4))) == [("both", 3), ("first", 6), ("second", 3)]


def test_itemsets_edges(spark, baskets):
    empty = baskets.where("false")
    assert named(itemsets.frequent_itemsets(empty, 1)) == []
    sizes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "basket long, item string")
    assert {r["basket"] for r in itemsets.larger_baskets(sizes, 2).collect()} == {2}


STARS = {"i1": (5, 3, 1), "i2": (4, 3, 2), "i3": (3, 3, 3), "i4": (1, 3, 5), "i5": (5, 4, 1)}


def test_pearson(spark):
    rated = spark.createDataFrame([(f"u{k}", i, float(s)) for i, v in STARS.items() for k, s in enumerate(v)], "user_id string, item_id string, stars double")
    sims = {(r["a"], r["b"]): r["sim"] for r in recommend.item_similarity(rated).collect()}
    assert sims["i1", "i2"] == 1.0
    assert sims["i1", "i5"] == pytest.approx(0.960769, abs=1e-6)
    assert ("i1", "i3") not in sims and ("i1", "i4") not in sims


def test_expressions(spark):
    one = spark.range(1)
    got = one.select(
        similarity.amplified(F.lit(0.5)), similarity.amplified(F.lit(-0.5)), similarity.jaccard(F.lit(2), F.lit(3), F.lit(3)),
        similarity.set_cosine(F.lit(2), F.lit(3), F.lit(4)), similarity.set_cosine(F.lit(0), F.lit(0), F.lit(4)),
        similarity.mahalanobis(F.array(F.lit(3.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0))),
    ).first()
    assert got[0] == pytest.approx(0.088388, abs=1e-6) and got[1] == pytest.approx(-0.088388, abs=1e-6)
    assert got[2] == 0.5 and got[3] == pytest.approx(0.577350, abs=1e-6) and got[4] == 0.0 and got[5] == 2.0


def test_hashing(spark):
    one = spark.range(1)
    x = int.from_bytes(b"Las Vegas", "big")
    got = one.select(hashing.text_mod(F.lit("Las Vegas"), 7000), sketch.bloom_positions(F.lit("Las Vegas")), *[hashing.trailing_zeros(F.lit(v)) for v in (40, 1, 0)]).first()
    assert got[0] == x % 7000 == 2307
    assert got[1] == [4843, 148, 4758, 2360, 4576, 2188, 4412]
    assert list(got[2:]) == [3, 0, 32]
    assert hashing.FAMILY[0] == (2, 229) and hashing.FAMILY[29] == (113, 73) and hashing.FAMILY[49] == (229, 2)


def test_bloom_has_no_false_negatives(spark):
    values = spark.createDataFrame([(f"city {k}",) for k in range(40)] + [("",), (None,)], "v string")
    hits = {r["v"]: r["hit"] for r in sketch.bloom_probe(values, "v", sketch.bloom_build(values, "v")).collect()}
    assert hits[""] == 0 and hits[None] == 0 and all(h == 1 for v, h in hits.items() if v)


def test_predictions(spark):
    model = spark.createDataFrame([("i", "p", 0.5), ("i", "q", 0.25)], "a string, b string, sim double")
    rated = spark.createDataFrame([("u", "p", 4.0), ("u", "q", 2.0)], "user_id string, item_id string, stars double")
    test = spark.createDataFrame([("u", "i"), ("u", "i"), ("x", "i")], "user_id string, item_id string")
    assert rows(recommend.predict_by_items(test, rated, model)) == [("u", "i", pytest.approx(10 / 3))]
    rated = spark.createDataFrame([("x", "m", 3.0), ("v", "i", 5.0), ("v", "n", 3.0), ("w", "i", 2.0), ("w", "n", 4.0)], "user_id string, item_id string, stars double")
    users = spark.createDataFrame([("v", "x", 0.5), ("w", "x", 0.5)], "a string, b string, sim double")
    assert rows(recommend.predict_by_users(spark.createDataFrame([("x", "i")], "user_id string, item_id string"), rated, users)) == [("x", "i", 3.0)]


def test_cold_pairs(spark):
    known = spark.createDataFrame([("u1", "b1", 3.0)], "user_id string, item_id string, stars double")
    pairs = spark.createDataFrame([("u1", "b1"), ("u1", "b9"), ("u9", "b1"), ("u9", "b9")], "user_id string, item_id string")
    assert [r[:2] for r in rows(recommend.cold_pairs(pairs, known, "or"))] == [("u1", "b9"), ("u9", "b1"), ("u9", "b9")]
    assert [r[:2] for r in rows(recommend.cold_pairs(pairs, known, "and"))] == [("u9", "b9")]


def test_hybrid_switch(spark):
    pairs = [("h", "hi"), ("m", "mi"), ("l", "lo")]
    data = [("h", "hi", 4.6), ("m", "mi", 3.2), ("l", "lo", 1.4)]
    ratings = spark.createDataFrame(data, "user_id string, item_id string, stars double")
    model = spark.createDataFrame([], "a string, b string, sim double")
    got = dict((r[0], r[2]) for r in rows(recommend.predict_hybrid(spark.createDataFrame(pairs, "user_id string, item_id string"), ratings, model)))
    assert got == {"h": 5.0, "m": pytest.approx(3.2), "l": 1.0}  # 0.6 * 1.4 + 0.4 * 1.4 rounds to 1


def test_hybrid_mixes_in_the_prediction(spark):
    """An average of 1.4 with a prediction of 3.0: 0.6 * 3.0 + 0.4 * 1.4 = 2.36 rounds to 2; and a tie rounds to even."""
    # The user's own ratings average 1.4; the item's, by another user, too.
    data = [("u", "x", 3.0), *[("u", f"y{k}", 1.0) for k in range(4)], ("v", "i", 1.4)]
    ratings = spark.createDataFrame(data, "user_id string, item_id string, stars double")
    model = spark.createDataFrame([("i", "x", 1.0), *[("i", f"y{k}", 1e-12) for k in range(4)]], "a string, b string, sim double")
    pair = spark.createDataFrame([("u", "i")], "user_id string, item_id string")
    assert rows(recommend.predict_hybrid(pair, ratings, model)) == [("u", "i", 2.0)]
    tie = spark.createDataFrame([("u", "x", 1.5), ("v", "i", 1.5)], "user_id string, item_id string, stars double")
    assert rows(recommend.predict_hybrid(pair, tie, model.where("b = 'x'"))) == [("u", "i", 2.0)]


def test_all_pairs_have_a_prediction(spark):
    known = spark.createDataFrame([("u1", "b1", 3.0), ("u1", "b2", 4.0), ("u2", "b1", 3.0)], "user_id string, item_id string, stars double")
    pairs = spark.createDataFrame([("u2", "b2"), ("u1", "b9"), ("u9", "b1"), ("u9", "b9")], "user_id string, item_id string")
    got = rows(recommend.predict_all(pairs, known, spark.createDataFrame([], "a string, b string, sim double")))
    assert [r[:2] for r in got] == [("u1", "b9"), ("u2", "b2"), ("u9", "b1"), ("u9", "b9")]
    assert {r[2] for r in got if "9" in r[0] + r[1]} == {recommend.GRAND_AVERAGE}


def test_last_item_profile(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, word string")
    seen = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, item_id string")
    assert rows(text.user_profiles(seen, items)) == [("u", "x"), ("u", "y")]
    assert rows(text.user_profiles(seen, items, mode="last")) == [("u", "y")]


def test_averages(spark):
    r = spark.createDataFrame([("u", "p", 1.0), ("u", "p", 3.0), ("u", "q", 5.0)], "user_id string, item_id string, stars double")
    assert recommend.user_means(recommend.averaged(r)).first()["mean"] == 3.5
    assert recommend.averages(r, "user_id").first()["mean"] == 3.0
    given = spark.createDataFrame([("u", 9.0), ("z", 1.0)], "user_id string, mean double")
    assert rows(recommend.averages(r, "user_id", given)) == [("u", 9.0), ("z", 1.0)]


def test_tfidf(spark):
    docs = spark.createDataFrame([("b1", "food food, FOOD good good!"), ("b2", "good good"), ("b3", "xx")], "item_id string, text string")
    got = {(r["key"], r["word"]): r["score"] for r in text.profiles(docs, "item_id", "text").collect()}
    assert got == {("b1", "food"): pytest.approx(1.098612, abs=1e-6), ("b1", "good"): pytest.approx(0.270310, abs=1e-6), ("b2", "good"): pytest.approx(0.405465, abs=1e-6)}


LINKS = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


@pytest.fixture(scope="module")
def two_triangles(spark):
    number = {c: i for i, c in enumerate("abcdef")}
    return spark.createDataFrame([(number[x], number[y]) for x, y in LINKS], "a long, b long").cache()


def test_betweenness(two_triangles):
    for found in (graph.betweenness(two_triangles), graph.betweenness_by_joins(two_triangles)):
        got = {(r["a"], r["b"]): r["score"] for r in found.collect()}
        assert got == pytest.approx({(2, 3): 9, (0, 2): 4, (1, 2): 4, (3, 4): 4, (3, 5): 4, (0, 1): 1, (4, 5): 1})


def test_girvan_newman(spark, two_triangles):
    want = [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert rows(graph.girvan_newman(two_triangles)) == want
    groups = spark.createDataFrame(want, "v long, component long")
    assert graph.modularity(two_triangles, groups).first()["q"] == pytest.approx(0.357143, abs=1e-6)
    empty = two_triangles.where("false")
    assert rows(graph.girvan_newman(empty)) == [] and graph.modularity(empty, groups.where("false")).first()["q"] == 0.0


def shortest_paths(edges):
    """Betweenness by listing all shortest paths of all pairs."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = dict.fromkeys(edges, 0.0)
    for s in near:
        paths = {s: [[s]]}
        front = {s}
        while front:
            new = {}
            for v in front:
                for w in near[v]:
                    if w not in paths:
                        new.setdefault(w, []).extend([*p, w] for p in paths[v])
            paths |= new
            front = set(new)
        for t, all_ in paths.items():
            if s < t:
                for p in all_:
                    for e in zip(p, p[1:]):
                        score[min(e), max(e)] += 1 / len(all_)
    return near, score


def brute_girvan_newman(edges):
    near, _ = shortest_paths(edges)
    m, degree = len(edges), {v: len(w) for v, w in near.items()}
    left, best, top = list(edges), None, None
    while True:
        group = {v: v for v in near}
        for _ in near:
            for a, b in left:
                group[a] = group[b] = min(group[a], group[b])
        q = sum((group[a] == group[b]) / m for a, b in edges) - sum(degree[v] * degree[w] / (2 * m) ** 2 for v in near for w in near if group[v] == group[w])
        if top is None or q >= top - 1e-12:
            best, top = group, max(q, top if top is not None else q)
        if not left:
            return sorted(best.items())
        score = {e: round(x, 9) for e, x in shortest_paths(left)[1].items()}
        left = [e for e in left if score[e] < max(score.values())]


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_with_text_ids_against_brute_force(spark, seed, monkeypatch):
    draw = random.Random(seed)
    name = lambda k: f"user {k * 7 % 30:02}"
    pairs = {tuple(sorted((name(x), name(y)))) for g in range(3) for x in range(8 * g, 8 * g + 8) for y in range(x) if draw.random() < (0.5 if y >= 8 * g else 0.04)}
    edges = sorted(pairs)
    frame = spark.createDataFrame(edges, "a string, b string")
    want = shortest_paths(edges)[1]
    found = {(r["a"], r["b"]): r["score"] for r in graph.betweenness(frame).collect()}
    assert found == pytest.approx(want)
    assert rows(graph.girvan_newman(frame)) == brute_girvan_newman(edges)
    monkeypatch.setattr(graph, "LOCAL_STEPS", 0)  # walks dealt to tasks
    assert rows(graph.girvan_newman(frame)) == brute_girvan_newman(edges)


def test_graphs_beyond_the_driver_give_the_same(spark, two_triangles, monkeypatch):
    here = rows(graph.girvan_newman(two_triangles)), rows(graph.betweenness(two_triangles))
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph, "WALK_EDGES", 0)
    assert (rows(graph.girvan_newman(two_triangles)), rows(graph.betweenness(two_triangles))) == here


def test_components_of_paths(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n) if k % 20 != 19], "a long, b long")
    got = dict(rows(graph.connected(edges, graph.vertices(edges))))
    assert got == {k: k // 20 * 20 for k in range(n)}


def test_label_propagation(two_triangles):
    labels = dict(rows(graph.label_propagation(two_triangles)))
    assert set(labels) == set(range(6)) and labels[0] == labels[1]


def test_cluster_stats(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [2.0, 4.0], 1)], "point_id long, coords array<double>, cluster int")
    assert rows(cluster.cluster_stats(pts)) == [(1, 0, 2, 2.0, 4.0, 1.0), (1, 1, 2, 4.0, 16.0, 2.0)]
    center = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0])], "cluster int, center array<double>, std array<double>")
    got = cluster.mahalanobis_assign(spark.createDataFrame([(9, [3.0, 2.0]), (10, [9.0, 2.0])], "point_id long, coords array<double>"), center)
    assert rows(got, "point_id", "cluster") == [(9, 1), (10, -1)]


def test_bfr_keeps_all_points(spark):
    pts = [(k, [float(k % 3 * 50 + k % 7), float(k % 3 * 50 + k % 5)], k % 4) for k in range(240)] + [(240, [900.0, -900.0], 3)]
    found = cluster.bfr(spark.createDataFrame(pts, "point_id long, coords array<double>, chunk int"), 3)
    got = rows(found.assignment)
    assert sorted(p for p, _ in got) == list(range(241))
    last = found.rounds[-1]
    assert last[2] + last[4] + last[5] == 241


def brute_kmeans(points, k, rounds=30):
    """Lloyd's steps in plain Python from the points of least hash."""
    near = lambda p, cs: min(range(len(cs)), key=lambda c: (round(sum((x - y) ** 2 for x, y in zip(p, cs[c])), 9), c))
    centers = list(dict.fromkeys(tuple(p) for _, p in sorted(points, key=lambda x: ((x[0] * 48271 + 11) % 2147483647, x[0]))[: 4 * k]))[:k]
    for _ in range(rounds + 1):
        groups = {}
        for _, p in points:
            groups.setdefault(near(p, centers), []).append(p)
        new = [tuple(sum(x) / len(g) for x in zip(*g)) for _, g in sorted(groups.items())]
        moved = sum(abs(x - y) for c, d in zip([centers[c] for c in sorted(groups)], new) for x, y in zip(c, d))
        done = moved < 0.01 and len(new) == len(centers)
        centers = new
        if done:
            break
    return {i: near(p, centers) for i, p in points}, centers


@pytest.mark.parametrize("k,cells", [(1, 0), (3, 0), (7, 0), (3, 10**6), (7, 10**6)])
def test_kmeans_against_brute_force(spark, k, cells, monkeypatch):
    monkeypatch.setattr(cluster, "LOCAL_CELLS", cells)
    draw = random.Random(k)
    pts = [(i, [round(draw.gauss(10 * (i % 4), 2), 3), round(draw.gauss(-5 * (i % 3), 1), 3)]) for i in range(150)] + [(200, [0.0, 0.0]), (201, [0.0, 0.0])]
    out, centers = cluster.kmeans(spark.createDataFrame(pts, "point_id long, coords array<double>"), k)
    want, middle = brute_kmeans(pts, k)
    assert dict(rows(out, "point_id", "cluster")) == want
    assert np.array(sorted(map(tuple, centers.tolist()))) == pytest.approx(np.array(sorted(middle)))


def test_first_centers_are_those_of_least_hash(spark):
    pts = [(i, [float(i % 50)]) for i in range(200)]
    order = list(dict.fromkeys(p[0] for _, p in sorted(pts, key=lambda x: (x[0] * 48271 + 11) % 2147483647)))
    got = cluster.first_centers(spark.createDataFrame(pts, "point_id long, coords array<double>"), 5)
    assert [c[0] for c in got.tolist()] == order[:5]


def brute_bfr(pts, k, share=0.2):
    """BFR over (id, coords, chunk) in plain Python, all points of a round judged by the clusters before it."""
    def grouped(ids, n):
        if not ids:
            return {}
        groups = {}
        for i, c in brute_kmeans([(i, place[i]) for i in ids], n)[0].items():
            groups.setdefault(c, []).append(i)
        return dict(sorted(groups.items()))

    place = {i: p for i, p, _ in pts}
    dims = len(pts[0][1])
    bar = 2 * math.sqrt(dims)

    def stats(ids):
        center = [sum(place[i][d] for i in ids) / len(ids) for d in range(dims)]
        return center, [max(math.sqrt(max(sum(place[i][d] ** 2 for i in ids) / len(ids) - center[d] ** 2, 0)), 1e-6) for d in range(dims)]

    def nearest(i, clusters):
        far = [(math.sqrt(sum(((x - c) / s) ** 2 for x, c, s in zip(place[i], *st))), name) for name, st in clusters.items()]
        return min(far)[1] if far and min(far)[0] <= bar else None

    first = [i for i, _, ch in pts if ch == 0]
    drawn = [i for i in first if i <= min(first) + share * (max(first) - min(first))]
    rough = grouped(drawn, 4 * k)
    inner = [i for g in rough.values() if len(g) > 2 for i in g] or drawn
    discard = dict(enumerate(grouped(inner, k).values()))
    compressed, retained, names = {}, [], iter(range(999))

    def settle(ids):
        alone = []
        for g in grouped(ids, 4 * k).values():
            if len(g) > 1:
                compressed[next(names)] = g
            else:
                alone += g
        return alone

    retained = settle([i for i in drawn if i not in inner])
    counts = lambda r: (r, len(discard), sum(map(len, discard.values())), len(compressed), sum(map(len, compressed.values())), len(retained))
    out = [counts(1)]
    for r in range(max(ch for _, _, ch in pts) + 1):
        now = [i for i, _, ch in pts if ch == r and i not in drawn]
        goes = {i: nearest(i, {c: stats(g) for c, g in discard.items()}) for i in now}
        waits = {i: nearest(i, {c: stats(g) for c, g in compressed.items()}) for i, c in goes.items() if c is None}
        for i, c in goes.items():
            if c is not None:
                discard[c].append(i)
        for i, c in waits.items():
            if c is not None:
                compressed[c].append(i)
        retained = retained + [i for i, c in waits.items() if c is None]
        if len(retained) > 4 * k:
            retained = settle(retained)
        order, x = list(compressed), 0
        while x < len(order):
            center, std = stats(compressed[order[x]])
            for y in range(x + 1, len(order)):
                if math.sqrt(sum(((u - v) / s) ** 2 for u, v, s in zip(stats(compressed[order[y]])[0], center, std))) < bar:
                    compressed[order[x]] += compressed.pop(order.pop(y))
                    break
            x += 1
        if r == max(ch for _, _, ch in pts):
            ends = {c: min(discard, key=lambda d: (math.dist(stats(discard[d])[0], stats(g)[0]), d)) for c, g in compressed.items()}
            for c, d in ends.items():
                discard[d] += compressed[c]
            compressed.clear()
        out.append(counts(r + 2))
    return out, sorted([(i, c) for c, g in discard.items() for i in g] + [(i, -1) for i in retained])


def test_bfr_against_brute_force(spark):
    draw = random.Random(4)
    middle = [(0, 0), (40, 10), (-30, 50)]
    pts = []
    for i in range(800):
        x, y = middle[draw.randrange(3)] if i % 10 else (draw.uniform(-200, 200), draw.uniform(-200, 200))
        if i % 25 == 24:
            x, y = 300, -300
        pts.append((i, [round(draw.gauss(x, 2), 3), round(draw.gauss(y, 3), 3)], i * 4 // 800))
    found = cluster.bfr(spark.createDataFrame(pts, "point_id long, coords array<double>, chunk int"), 3)
    counts, assigned = brute_bfr(pts, 3)
    assert found.rounds == counts
    assert rows(found.assignment, "point_id", "cluster") == assigned
    assert max(r[3] for r in counts) > 0 and any(c == -1 for _, c in assigned)


def test_bfr_draws_a_bounded_sample(spark):
    pts = [(i, [float(i % 3 * 50 + i % 7), float(i % 3 * 50 + i % 5)], i % 2) for i in range(400)]
    found = cluster.bfr(spark.createDataFrame(pts, "point_id long, coords array<double>, chunk int"), 3, sample=30)
    assert found.rounds[0][2] + found.rounds[0][4] + found.rounds[0][5] == 30
    assert sorted(r["point_id"] for r in found.assignment.collect()) == list(range(400))


def test_kmeans(spark):
    pts = [(k, [float(k % 2 * 100 + k % 5)]) for k in range(40)]
    out, centers = cluster.kmeans(spark.createDataFrame(pts, "point_id long, coords array<double>"), 2)
    got = dict(rows(out))
    assert len(centers) == 2 and len({got[k] for k in range(0, 40, 2)}) == 1 and got[0] != got[1]


def test_nmi(spark):
    same = spark.createDataFrame([(k % 3, k % 3) for k in range(9)], "x int, y int")
    assert cluster.nmi(same).first()[0] == pytest.approx(1.0)
    assert cluster.nmi(same.withColumn("y", F.lit(1))).first()[0] == 0.0


def test_trending(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 2), ("e", 1)], "tag string, cnt long")
    assert [r["tag"] for r in sketch.trending(counts).collect()] == ["a", "b", "c", "d"]


def test_reservoir_and_fm(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    assert sketch.reservoir_sample(df, "k", 100).count() == 100
    values = df.select(F.concat(F.lit("v"), "k").alias("v"))
    r = sketch.fm_estimate(values.union(values), "v").first()
    assert r["truth"] == 500 and 100 < r["estimate"] < 2500


def test_candidates_meet_their_own_members_only(spark):
    pairs = spark.createDataFrame([(i, m) for i in range(40) for m in range(i % 6, i % 6 + 5)], "id long, member long")
    few = spark.createDataFrame([(0, 1), (2, 9), (3, 4)], "a long, b long")
    want = [r for r in rows(similar.exact_jaccard(pairs, 0.1)) if (r[0], r[1]) in {(0, 1), (2, 9), (3, 4)}]
    assert rows(similar.exact_jaccard(pairs, 0.1, few)) == want
    rated = pairs.select(F.col("id").alias("user_id"), F.col("member").alias("item_id"), ((F.col("id") * F.col("member")) % 5 + 1).cast("double").alias("stars"))
    want = [r for r in rows(recommend.user_similarity(rated)) if r[:2] in {(0, 1), (2, 9), (3, 4)}]
    assert rows(recommend.user_similarity(rated, near=few)) == want


def test_lsh_is_part_of_exact(spark):
    pairs = spark.createDataFrame([(i, m) for i in range(30) for m in range(i % 6, i % 6 + 5)], "id long, member long")
    exact, near = set(rows(similar.exact_jaccard(pairs, 0.3), "a", "b")), set(rows(similar.lsh_jaccard(pairs, 0.3), "a", "b"))
    assert near <= exact and len(near) > len(exact) * 0.6
    assert math.isclose(similar.exact_jaccard(pairs, 0.99).where("a = 0 and b = 6").first()["sim"], 1.0)
