"""Clustering of points (point_id, coords): statistics, nearest centroids, k-means and BFR.

Points stay distributed; what the driver holds is a few numbers for each cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.similarity import euclidean, mahalanobis
from quarry.storage import stored


#: Coordinates up to which k-means takes its steps on the driver.
LOCAL_CELLS = 2_000_000


def cluster_stats(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, dim, n, sum, sumsq, std): population statistics of each dimension."""
    long = points.select(F.col(cluster).alias("cluster"), F.posexplode("coords").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))
    var = F.col("sumsq") / F.col("n") - F.pow(F.col("sum") / F.col("n"), F.lit(2.0))
    return sums.withColumn("std", F.sqrt(F.greatest(var, F.lit(0.0))))


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(point_id, cluster, distance): the nearest of the centroids (cluster, center); ties go to the lesser cluster.

    Centroids are few by their meaning and come to each point as one array.
    """
    all_of = centroids.agg(F.collect_list(F.struct("cluster", "center")).alias("centers"))
    met = points.join(F.broadcast(all_of))
    scored = F.transform("centers", lambda c: F.struct(euclidean(F.col("coords"), c["center"]).alias("d"), c["cluster"].alias("cluster")))
    return met.select("point_id", F.array_min(scored).alias("m")).select("point_id", F.col("m.cluster").alias("cluster"), F.col("m.d").alias("distance"))


def mahalanobis_assign(points: DataFrame, clusters: DataFrame, limit: float | None = None) -> DataFrame:
    """(point_id, cluster, distance): the nearest cluster (cluster, center, std) within ``limit`` (2 sqrt d), else -1."""
    all_of = clusters.agg(F.collect_list(F.struct("cluster", "center", "std")).alias("centers"))
    met = points.join(F.broadcast(all_of))
    scored = F.transform("centers", lambda c: F.struct(mahalanobis(F.col("coords"), c["center"], c["std"]).alias("d"), c["cluster"].alias("cluster")))
    best = met.select("point_id", F.size("coords").alias("dims"), F.array_min(scored).alias("m"))
    bar = F.lit(limit) if limit is not None else 2 * F.sqrt(F.col("dims").cast("double"))
    inside = F.col("m.d") <= bar
    return best.select("point_id", F.when(inside, F.col("m.cluster")).otherwise(F.lit(-1)).alias("cluster"), F.col("m.d").alias("distance"))


def first_centers(points: DataFrame, k: int) -> np.ndarray:
    """Starting centers: the k points of least seeded hash, without repeats of a place among the first 4 k."""
    rows = points.orderBy(_draw(), "point_id").limit(4 * k).select("coords").collect()
    places = list(dict.fromkeys(tuple(map(float, r[0])) for r in rows))[:k]
    return np.array(places) if places else np.empty((0, 0))


def _draw():
    """The seeded hash of a point by which it is drawn: a multiplicative one, which any engine can compute."""
    return F.pmod(F.col("point_id").cast("long") * F.lit(48271) + F.lit(11), F.lit(2147483647))


def _nearest(centers: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def _coords(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("coords")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))


def kmeans(points: DataFrame, k: int, rounds: int = 30, tolerance: float = 0.01) -> tuple[DataFrame, np.ndarray]:
    """(point_id, cluster) and the centers, by Lloyd's steps; stops when the centers move by less than ``tolerance`` in L1.

    Each step is one pass with sums of each task; empty clusters vanish. Up to LOCAL_CELLS coordinates (16 MB) the steps are
    taken on the driver, the same ones: a job for each would cost more than its work.
    """
    points = points.select("point_id", F.col("coords").cast("array<double>").alias("coords"))
    centers = first_centers(points, k)
    if not len(centers):
        return points.select("point_id", F.lit(-1).alias("cluster")), centers
    if points.count() * centers.shape[1] <= LOCAL_CELLS:
        return _assigned(points, _lloyd(points, centers, rounds, tolerance))
    for _ in range(rounds + 1):
        now = centers

        def sums(batches, now=now):
            n, total = np.zeros(len(now)), np.zeros_like(now)
            for batch in batches:
                if batch.num_rows:
                    x = _coords(batch)
                    at = _nearest(now, x)
                    n += np.bincount(at, minlength=len(now))
                    np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], ["cluster", "n", "total"])

        parts = points.mapInArrow(sums, "cluster int, n double, total array<double>").select("cluster", "n", F.posexplode("total").alias("dim", "x"))
        rows = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > 0").orderBy("cluster", "dim").collect()
        alive = sorted({r["cluster"] for r in rows})
        new = np.array([r["x"] / r["n"] for r in rows]).reshape(len(alive), -1)
        moved = np.abs(new - now[alive]).sum()
        centers = new
        if moved < tolerance and len(alive) == len(now):
            break
    return _assigned(points, centers)


def _assigned(points: DataFrame, centers: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Points with their nearest centers, and the centers."""
    table = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    return nearest_centroid(points, table).select("point_id", "cluster"), centers


def _lloyd(points: DataFrame, centers: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Lloyd's steps over few points on the driver."""
    x = np.array([r[0] for r in points.orderBy("point_id").select("coords").collect()], dtype=float)
    for _ in range(rounds + 1):
        at = _nearest(centers, x)
        alive = np.unique(at)
        new = np.array([x[at == c].sum(axis=0) / (at == c).sum() for c in alive])
        moved = np.abs(new - centers[alive]).sum()
        done = moved < tolerance and len(alive) == len(centers)
        centers = new
        if done:
            break
    return centers


@dataclass
class Summary:
    """What BFR keeps of a cluster: count, sums and sums of squares."""

    n: int
    sum: np.ndarray
    sumsq: np.ndarray

    @property
    def center(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.sumsq / self.n - self.center**2, 0.0))

    def add(self, other: Summary) -> None:
        self.n += other.n
        self.sum = self.sum + other.sum
        self.sumsq = self.sumsq + other.sumsq


def summaries(assigned: DataFrame) -> dict[int, Summary]:
    """The summary of each cluster of (coords, cluster), summed up in the tasks."""
    parts: dict[int, list] = {}
    for r in cluster_stats(assigned).orderBy("cluster", "dim").collect():
        parts.setdefault(r["cluster"], []).append(r)
    return {c: Summary(v[0]["n"], np.array([r["sum"] for r in v]), np.array([r["sumsq"] for r in v])) for c, v in parts.items()}


def _grouped(points: DataFrame, k: int) -> tuple[DataFrame, dict[int, Summary]]:
    """(point_id, coords, cluster) by k-means, as a stored table, and the summaries of the clusters."""
    found, _ = kmeans(points, k)
    assigned = stored(points.select("point_id", "coords").join(found, "point_id"), "grouped")
    return assigned, summaries(assigned)


def _near(spark, points: DataFrame, clusters: dict[int, Summary], bar: float) -> DataFrame:
    """(point_id, coords, cluster): the nearest cluster within the bar, else -1."""
    table = spark.createDataFrame([(c, s.center.tolist(), s.std.tolist()) for c, s in clusters.items()], "cluster int, center array<double>, std array<double>")
    return stored(points.select("point_id", "coords").join(mahalanobis_assign(points, table, bar).drop("distance"), "point_id"), "near")


@dataclass
class Bfr:
    """The result of BFR: assignment (point_id, cluster), rounds of counts, and the summaries of the clusters."""

    assignment: DataFrame
    rounds: list[tuple]
    clusters: list[Summary]


def bfr(points: DataFrame, k: int, share: float = 0.2, most: float = 100.0, sample: int = 100_000) -> Bfr:
    """BFR over (point_id, coords, chunk): one chunk a round, in order.

    The first ``share`` of the first chunk's ids start the discard set (the ``sample`` of least seeded hash among them,
    if there are more; the rest is then assigned like all other points). Single points wait in the retained set, small
    clusters in the compression set, all by the Mahalanobis bar 2 sqrt(d) (and under ``most``). All points of a round
    are judged by the clusters before it. Points, the sample and the retained set stay tables; the driver holds the
    clusters' summaries only. At the end every compression cluster joins its nearest discard cluster, retained points
    are outliers (-1).
    """
    spark = points.sparkSession
    points = stored(points.select(F.col("point_id").cast("long"), F.col("coords").cast("array<double>").alias("coords"), "chunk"), "points")
    chunks_ = [r[0] for r in points.select("chunk").distinct().orderBy("chunk").collect()]
    if not chunks_:
        return Bfr(points.select("point_id", F.lit(-1).alias("cluster")), [], [])
    bar = min(2 * math.sqrt(len(points.first()["coords"])), most)
    first = points.where(F.col("chunk") == chunks_[0])
    low, high = first.agg(F.min("point_id"), F.max("point_id")).first()
    drawn = stored(first.where(F.col("point_id") <= low + share * (high - low)).orderBy(_draw(), "point_id").limit(sample).select("point_id", "coords"), "sample")

    rough, parts = _grouped(drawn, 4 * k)
    large = [c for c, s in parts.items() if s.n > 2] or list(parts)
    inner, found = _grouped(rough.where(F.col("cluster").isin(large)), k)
    name = {c: i for i, c in enumerate(sorted(found))}
    discard = {name[c]: s for c, s in found.items()}
    renamed = lambda df, names: df.join(F.broadcast(spark.createDataFrame(list(names.items()), "cluster int, named int")), "cluster").select("point_id", F.col("named").alias("cluster"))
    assigned = [renamed(inner, name)]
    compressed: dict[int, Summary] = {}
    held: list[DataFrame] = []  # (point_id, cluster) of compression clusters, by the names that these had at the time
    joins: dict[int, int] = {}  # names of merged compression clusters, and what they went into
    count = iter(range(1 << 30))

    def settle(waiting: DataFrame) -> DataFrame:
        """Clusters of two or more are compressed; the single points are returned."""
        grouped, found = _grouped(waiting, 4 * k)
        names = {c: next(count) for c, s in sorted(found.items()) if s.n > 1}
        compressed.update({names[c]: found[c] for c in names})
        if names:
            held.append(renamed(grouped, names))
        return grouped.where(~F.col("cluster").isin(list(names))).select("point_id", "coords")

    def final(c: int) -> int:
        while c in joins:
            c = joins[c]
        return c

    retained = settle(rough.where(~F.col("cluster").isin(large)).select("point_id", "coords"))
    rounds: list[tuple] = []

    def report(r: int) -> None:
        rounds.append((r, len(discard), sum(s.n for s in discard.values()), len(compressed), sum(s.n for s in compressed.values()), retained.count()))

    report(1)
    for r, chunk in enumerate(chunks_):
        now = points.where(F.col("chunk") == chunk)
        if r == 0:
            now = now.join(F.broadcast(drawn.select("point_id")), "point_id", "left_anti")  # ``sample`` ids at most
        near = _near(spark, now, discard, bar)
        for c, s in summaries(near.where("cluster >= 0")).items():
            discard[c].add(s)
        assigned.append(near.where("cluster >= 0").select("point_id", "cluster"))
        rest = _near(spark, near.where("cluster < 0"), compressed, bar)
        for c, s in summaries(rest.where("cluster >= 0")).items():
            compressed[c].add(s)
        held.append(rest.where("cluster >= 0").select("point_id", "cluster"))
        retained = stored(retained.unionByName(rest.where("cluster < 0").select("point_id", "coords")), "retained")
        if retained.count() > 4 * k:
            retained = stored(settle(retained), "retained")
        order = list(compressed)
        i = 0
        while i < len(order):  # merge compression clusters that are near; a merged one waits for the next pass
            s = compressed[order[i]]
            near_one = next((j for j in range(i + 1, len(order)) if np.sqrt((((compressed[order[j]].center - s.center) / np.maximum(s.std, 1e-6)) ** 2).sum()) < bar), None)
            if near_one is not None:
                gone = order.pop(near_one)
                s.add(compressed.pop(gone))
                joins[gone] = order[i]
            i += 1
        if r == len(chunks_) - 1:
            goes = {}
            for c, s in compressed.items():
                goes[c] = min(discard, key=lambda d: (np.linalg.norm(discard[d].center - s.center), d))
            for c, d in goes.items():
                discard[d].add(compressed[c])
            names = {c: goes[final(c)] for c in [*joins, *goes]}
            if names:
                assigned += [renamed(df, names) for df in held]
            compressed.clear()
        report(r + 2)
    out = retained.select("point_id", F.lit(-1).alias("cluster"))
    for part in assigned:
        out = out.unionByName(part)
    return Bfr(out, rounds, list(discard.values()))


def nmi(a: DataFrame) -> DataFrame:
    """One row (nmi): normalised mutual information of the columns x and y; 0 if either has one value only."""
    n = a.agg(F.count("*").cast("double").alias("n"))
    xy = a.groupBy("x", "y").agg(F.count("*").alias("c"))
    x, y = a.groupBy("x").agg(F.count("*").alias("cx")), a.groupBy("y").agg(F.count("*").alias("cy"))
    info = xy.join(x, "x").join(y, "y").join(F.broadcast(n)).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("i"))
    entropy = lambda t, c, name: t.join(F.broadcast(n)).agg((-F.sum(F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n")))).alias(name))
    both = info.join(F.broadcast(entropy(x, "cx", "hx"))).join(F.broadcast(entropy(y, "cy", "hy")))
    low = F.sqrt(F.col("hx") * F.col("hy"))
    return both.select(F.when(low < 1e-12, F.lit(0.0)).otherwise(F.col("i") / F.greatest(low, F.lit(1e-12))).alias("nmi"))
