"""Graphs: co-interaction edges, degrees, label propagation, components, modularity, betweenness, Girvan-Newman.

Edges are undirected and stand once, as (a, b) with a < b. Ids are of any type that has an order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.dense import dense_ids
from quarry.operators.components import components
from quarry.operators.similar import common_members
from quarry.storage import stored

#: Edges up to this number are broadcast to the tasks that walk the graph, as arrays of some 24 bytes an edge; beyond
#: it, walks are joins.
WALK_EDGES = 2_000_000
#: Edges of a graph that Girvan-Newman splits on the driver, and roots times edges that it also walks there.
LOCAL_EDGES, LOCAL_STEPS = 50_000, 5_000_000


def co_interaction(pairs: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ids with that many common members or more; ``pairs``: distinct (id, member)."""
    return common_members(pairs, threshold).select("a", "b")


def vertices(edges: DataFrame) -> DataFrame:
    """(v) of all ends of edges."""
    return edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, component): the least vertex of each vertex's component; vertices without edges are their own."""
    roots = components(edges)
    return nodes.join(roots.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(v, label): each round, every vertex takes its neighbours' most frequent label, the least of several."""
    links = stored(both_ways(edges), "links")
    labels = vertices(edges).select("v", F.col("v").alias("label"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v"), "label").agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("v").orderBy(F.col("n").desc(), "label"))
        labels = stored(votes.withColumn("r", first).where("r = 1").select("v", "label"), "labels")
    return labels


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (q) for a partition (v, component) of the graph: sum over groups of L/m - (D/2m)^2; 0 without edges."""
    of = groups.select("v", "component")
    m = edges.agg(F.count("*").alias("m"))
    d = degrees(edges).join(of, "v").groupBy("component").agg(F.sum("degree").alias("d"))
    ends = edges.join(of.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count("*").alias("l"))
    parts = d.join(inner, "component", "left").join(F.broadcast(m))
    q = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), F.lit(2.0))
    return parts.agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("q"))


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices (v, idx) with dense numbers in their order, and the edges (a, b) in these numbers."""
    index = stored(dense_ids(vertices(edges), "v"), "vertices")
    ends = edges.select("a", "b").join(index.select(F.col("v").alias("a"), F.col("idx").alias("x")), "a").join(index.select(F.col("v").alias("b"), F.col("idx").alias("y")), "b")
    return index, stored(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "graph")


def decoded(df: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """``df`` with vertices instead of their numbers in these columns."""
    own = df.columns
    for c in columns:
        df = df.join(index.select(F.col("v").alias("_v"), F.col("idx").alias(c)), c).drop(c).withColumnRenamed("_v", c)
    return df.select(*own)


class Links:
    """A graph of numbered vertices: the neighbours of all vertices laid end to end, with the number of each edge."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.n = int(max(a.max(), b.max())) + 1 if len(a) else 0
        src, self.dst = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(src, kind="stable")
        self.dst, self.edge = self.dst[order].astype(np.int64), np.tile(np.arange(len(a)), 2)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=self.n))])

    def from_all(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vertex and place in ``dst`` of all links that start at some vertices."""
        size = self.first[at + 1] - self.first[at]
        start = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.repeat(at, size), start + np.arange(int(size.sum()))

    def credit(self, root: int, sums: np.ndarray) -> None:
        """Adds the credits of the shortest paths from a root to its edges: out level by level, then back."""
        level, paths = np.full(self.n, -1), np.zeros(self.n)
        level[root], paths[root] = 0, 1.0
        front, steps, depth = np.array([root]), [], 0
        while len(front):
            src, place = self.from_all(front)
            dst, depth = self.dst[place], depth + 1
            front = np.unique(dst[level[dst] < 0])
            level[front] = depth
            down = level[dst] == depth
            src, dst, place = src[down], dst[down], place[down]
            np.add.at(paths, dst, paths[src])
            steps.append((src, dst, place))
        credit = np.ones(self.n)
        for src, dst, place in reversed(steps):
            share = credit[dst] * paths[src] / paths[dst]
            sums[self.edge[place]] += share  # an edge stands once in a step
            np.add.at(credit, src, share)

    def scores(self, roots) -> np.ndarray:
        """The credits of all edges from these roots."""
        sums = np.zeros(len(self.a))
        for root in roots:
            self.credit(root, sums)
        return sums


def _arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) of a graph whose size was checked, as arrays on the driver."""
    table = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    return table.column("a").to_numpy(), table.column("b").to_numpy()


def _dealt_scores(spark, links: Links) -> DataFrame:
    """(edge, score) of a graph that tasks get as a broadcast; roots are dealt to the tasks."""
    shared = spark.sparkContext.broadcast((links.a, links.b))

    def walk(batches):
        graph, sums = Links(*shared.value), 0.0
        for batch in batches:
            sums = sums + graph.scores(batch.column("id").to_pylist())
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.asarray(sums)[found] if len(found) else [], pa.float64())], ["edge", "share"])

    return spark.range(links.n).mapInArrow(walk, "edge long, share double").groupBy("edge").agg((F.sum("share") / 2).alias("score"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(a, b, score): shortest paths over each edge, each pair of vertices counted once.

    Roots are dealt to tasks, which sum the credits of all their roots before the shuffle. The graph is broadcast
    behind a check of its size; a larger one is walked by joins.
    """
    index, e = coded(edges)
    return decoded(_scored(e), index, "a", "b")


def _scored(e: DataFrame) -> DataFrame:
    """(a, b, score) of edges between numbered vertices."""
    if e.count() > WALK_EDGES:
        return betweenness_by_joins(e)
    links = Links(*_arrays(e.orderBy("a", "b")))
    spark = e.sparkSession
    named = spark.createDataFrame(pa.table({"edge": np.arange(len(links.a)), "a": links.a, "b": links.b})) if len(links.a) else spark.createDataFrame([], "edge long, a long, b long")
    return named.join(_dealt_scores(spark, links), "edge").select("a", "b", "score")


def betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """The same by level-wise joins over (root, vertex) rows, for graphs beyond a broadcast."""
    links = stored(both_ways(edges), "links")
    front = stored(vertices(edges).select(F.col("v").alias("root"), "v", F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "front")
    levels, seen = [front], front.select("root", "v")
    while True:
        step = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("root", "dst").agg((F.first("level") + 1).alias("level"), F.sum("paths").alias("paths"))
        new = stored(step.withColumnRenamed("dst", "v").join(seen, ["root", "v"], "left_anti").select("root", "v", "level", "paths"), "front")
        if new.isEmpty():
            break
        levels.append(new)
        seen = stored(seen.unionByName(new.select("root", "v")), "seen")
    shares, credit = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("credit", F.lit(1.0)) if credit is None else levels[k].join(credit, ["root", "v"], "left").withColumn("credit", 1.0 + F.coalesce("more", F.lit(0.0))).drop("more")
        up = levels[k - 1].select("root", F.col("v").alias("dst"), F.col("paths").alias("above"))
        share = here.join(links, F.col("v") == F.col("src")).join(up, ["root", "dst"]).select("root", "v", F.col("dst").alias("parent"), (F.col("credit") * F.col("above") / F.col("paths")).alias("share"))
        share = stored(share, "credits")
        shares.append(share.select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"), "share"))
        credit = share.groupBy("root", F.col("parent").alias("v")).agg(F.sum("share").alias("more"))
    out = shares[0]
    for s in shares[1:]:
        out = out.unionByName(s)
    return out.groupBy("a", "b").agg((F.sum("share") / 2).alias("score"))


def _split(nodes: list, links: dict) -> dict:
    """The least node of each node's component."""
    out: dict = {}
    for start in sorted(nodes):
        if start not in out:
            out[start], todo = start, [start]
            while todo:
                for w in links[todo.pop()]:
                    if w not in out:
                        out[w] = start
                        todo.append(w)
    return out


def _removal_rounds(edges: list, scores) -> dict:
    """The best partition of a graph that fits on the driver; ``scores`` gives the betweenness of what is left."""
    links: dict = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    nodes, m = list(links), len(edges)
    degree = {v: len(w) for v, w in links.items()}
    best, top, left = None, None, list(edges)
    while True:
        groups = _split(nodes, links)
        inner, total = {}, {}
        for v in nodes:
            total[groups[v]] = total.get(groups[v], 0) + degree[v]
        for a, b in edges:
            if groups[a] == groups[b]:
                inner[groups[a]] = inner.get(groups[a], 0) + 1
        q = sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in total.items())
        if top is None or q >= top - 1e-12:
            best, top = groups, max(q, top if top is not None else q)
        if not left:
            return best
        found = {e: round(s, 9) for e, s in scores(left, links).items()}
        peak = max(found.values())
        for (a, b), s in found.items():
            if s == peak:
                links[a].discard(b)
                links[b].discard(a)
        left = [e for e in left if found[e] < peak]


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(v, component): the partition of highest modularity while the edges of most betweenness are removed.

    Each round removes all edges at the maximum (rounded to 1e-9); of equal modularities the later counts. Modularity
    is that of the first graph. Behind a check of its size the graph is kept on the driver, which splits it, while
    the walks are dealt to tasks unless they are few; a larger graph stays a table all the way.
    """
    index, first = coded(edges)
    spark, n = edges.sparkSession, first.count()
    if n > LOCAL_EDGES:
        return decoded(_girvan_newman_tables(first), index, "v", "component")

    def scores(left: list, _) -> dict:
        links = Links(*(np.array(x, dtype=np.int64) for x in zip(*left)))
        if links.n * len(left) > LOCAL_STEPS:
            found = np.zeros(len(left))
            for r in _dealt_scores(spark, links).collect():
                found[r["edge"]] = r["score"]
        else:
            found = links.scores(range(links.n)) / 2
        return dict(zip(left, found.tolist()))

    best = _removal_rounds(list(zip(*(x.tolist() for x in _arrays(first)))), scores) if n else {}
    return decoded(spark.createDataFrame(sorted(best.items()), "v long, component long"), index, "v", "component")


def _girvan_newman_tables(first: DataFrame) -> DataFrame:
    """The same with edges and partitions as tables; driver state is one number a round."""
    nodes, left, best, top = stored(vertices(first), "vertices"), first, None, None
    while True:
        groups = stored(connected(left, nodes), "partition")
        q = modularity(first, groups).first()[0]
        if top is None or q >= top - 1e-12:
            best, top = groups, max(q, top if top is not None else q)
        if left.isEmpty():
            return best
        scored = stored(_scored(left).withColumn("score", F.round("score", 9)), "betweenness")
        peak = scored.agg(F.max("score")).first()[0]
        left = stored(scored.where(F.col("score") < peak).select("a", "b"), "graph")
