"""Readers, writers and streams."""

import contextlib
import json
import os
import random
import socket
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import sketch
from quarry.sources import readers, writers
from quarry.streaming import replay


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "i.csv").write_text('user_id,business_id,more\nu1,"b,1",x\nu2,b2,y\n')
    assert [tuple(r) for r in readers.interactions_csv(spark, str(tmp_path / "i.csv")).collect()] == [("u1", "b,1"), ("u2", "b2")]
    (tmp_path / "r.json").write_text('{"user_id":"u","business_id":"b","stars":4}\n')
    assert tuple(readers.reviews_json(spark, str(tmp_path / "r.json")).first()) == ("u", "b", 4.0, None)
    (tmp_path / "c.json").write_text('{"city":"X"}\n{"city":""}\n{}\n')
    assert readers.cities_json(spark, str(tmp_path / "c.json")).count() == 1


def test_points(spark, tmp_path):
    (tmp_path / "b.txt").write_text("2,1.5,2\n")
    (tmp_path / "a.txt").write_text("1,0,1\n")
    (tmp_path / "skip.csv").write_text("3,0,1\n")
    got = sorted((r["point_id"], r["coords"], r["chunk"]) for r in readers.points_text(spark, str(tmp_path)).collect())
    assert got == [(1, [0.0, 1.0], 0), (2, [1.5, 2.0], 1)]


def test_models(spark, tmp_path):
    means = spark.createDataFrame([("u", 3.5), ("v", 1.0)], "key string, mean double")
    writers.single_object(means, "key", "mean", str(tmp_path / "avg"))
    assert sorted(tuple(r) for r in readers.average_model(spark, str(tmp_path / "avg")).collect()) == [("u", 3.5), ("v", 1.0)]
    sets = spark.createDataFrame([(["b", "a"],), (["c"],)], "items array<string>")
    writers.itemsets_joined(sets, str(tmp_path / "sets"))
    assert sorted(r["items"] for r in readers.itemsets_text(spark, str(tmp_path / "sets")).collect()) == [["a", "b"], ["c"]]
    writers.json_lines(spark.createDataFrame([("x", "y", 0.5)], "b1 string, b2 string, sim double"), str(tmp_path / "m"))
    assert tuple(readers.similarity_model(spark, str(tmp_path / "m")).first()) == ("x", "y", 0.5)


def test_reports(spark):
    sets = spark.createDataFrame([(["a"],), (["b"],), (["b", "a"],)], "items array<string>")
    assert writers.itemset_report(sets, sets.where("size(items) = 1")) == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')"
    assert writers.itemset_report(sets.where("false"), sets.where("false")).startswith("Candidates:")
    groups = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "v string, component int")
    assert writers.communities_report(groups) == "'z'\n'x', 'y'"
    assert writers.hits_line(spark.createDataFrame([(2, 0), (1, 1)], "k int, hit int"), "k") == "1 0"


def events(spark, folder, n=60):
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"), F.pmod("id", F.lit(7)).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.pmod("id", F.lit(3)), F.lit("}")).alias("props"))
    df.coalesce(1).write.parquet(f"{folder}/raw")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{folder}/raw/part-*.parquet")[0], f"{folder}/events.parquet")
    return spark.read.parquet(f"{folder}/events.parquet")


def test_streams_agree_with_batch(spark, tmp_path):
    table = events(spark, str(tmp_path))
    table = table
    batch = {r["window_start"]: r["truth"] for r in sketch.sliding_distinct(table, "ts", "user_id", "6 hours", "2 hours").collect()}
    stream = {r["window_start"]: r["truth"] for r in replay.stream_fm(spark, str(tmp_path)).collect()}
    assert stream == batch
    assert {r["tag"]: r["cnt"] for r in replay.stream_trending(spark, str(tmp_path)).collect()} == {"view:0": 20, "view:1": 20, "view:2": 20}
    kept = replay.stream_reservoir(spark, str(tmp_path)).collect()
    assert sorted(r["event_id"] for r in kept) == list(range(60))  # fewer than the reservoirs hold


def test_stream_reservoir_is_one_uniform_sample(spark, tmp_path):
    table = events(spark, str(tmp_path), 700)
    want = {r["event_id"] for r in sketch.reservoir_sample(table.select("event_id"), "event_id", 100).collect()}
    assert {r["event_id"] for r in replay.stream_reservoir(spark, str(tmp_path)).collect()} == want and len(want) == 100


def test_tag_reports_against_plain_python(spark, tmp_path):
    events(spark, str(tmp_path), 250)
    got = [tuple(r) for r in replay.stream_tag_reports(spark, str(tmp_path)).orderBy("seen", F.col("cnt").desc(), "tag").select("seen", "event_id", "tag", "cnt").collect()]
    kept, want = [], []
    for n in range(1, 251):
        draw, tag = random.Random(1_000_003 + n), f"view:{(n - 1) % 3}"
        if len(kept) < 100:
            kept.append(tag)
        elif draw.randint(1, n) <= 100:
            kept[draw.randrange(100)] = tag
        counts = Counter(kept) + Counter({"view": len(kept)})
        top = sorted(set(counts.values()), reverse=True)[:3]
        want += [(n, n - 1, t, c) for t, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c in top]
    assert got == want


def test_tags_of_an_evicted_event_are_taken_back():
    state, kept, counts = replay.TagReservoir(2, 3, 5), [], Counter()
    for n in range(1, 200):
        state.take(n, [f"t{n % 4}", "all"], kept, counts)
        assert counts == Counter(t for tags in kept for t in tags) and 0 not in counts.values() and len(kept) == min(n, 2)


def test_stream_bloom_agrees_with_batch(spark, tmp_path):
    table = events(spark, str(tmp_path))
    spark.createDataFrame([(1, "BUILDING"), (4, "BUILDING"), (5, "OTHER")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["event_id"]: r["hit"] for r in replay.stream_bloom(spark, str(tmp_path)).collect()}
    users = spark.createDataFrame([("1",), ("4",)], "user string")
    probes = sketch.bloom_probe(table.select("event_id", F.col("user_id").cast("string").alias("user")), "user", sketch.bloom_build(users, "user"))
    assert got == {r["event_id"]: r["hit"] for r in probes.collect()} and {got[k] for k in got if k % 7 in (1, 4)} == {1}


def test_track_filter(spark):
    posts = spark.createDataFrame([("Stay at HOME now", "en"), ("#stay: home", "en"), ("homestay", "en"), ("home", "en"), ("stay home", "fr"), (None, "en")], "text string, lang string")
    found = replay.track(posts, "text", ["stay home", "covid"], ["en"])
    assert [r["text"] for r in found.collect()] == ["Stay at HOME now", "#stay: home"]
    assert replay.track(posts, "text", ["stay home"]).count() == 3


def test_an_error_ends_the_stream(spark, tmp_path):
    events(spark, str(tmp_path))
    heard = []
    policy = replay.ErrorPolicy(heard.append)
    spark.streams.addListener(policy)

    def each(df, batch):
        raise ValueError("no more")

    try:
        with pytest.raises(Exception, match="no more"):
            replay.run_available(replay.file_events(spark, str(tmp_path)), each)
        for _ in range(100):
            if policy.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(policy)
    assert len(heard) == len(policy.errors) == 1 and "no more" in heard[0] and not spark.streams.active


def test_socket_lines(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for _ in range(2):
            with contextlib.suppress(OSError):
                link, _ = server.accept()
                link.sendall(b'{"city":"X"}\n{"city":""}\n{"city":"Y"}\n')
                links.append(link)

    links = []
    threading.Thread(target=serve, daemon=True).start()
    lines = replay.json_field(replay.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), "city")
    query = lines.writeStream.format("memory").queryName("cities").start()
    try:
        for _ in range(100):
            query.processAllAvailable()
            if spark.table("cities").count() == 2:
                break
            time.sleep(0.1)
        assert sorted(r["city"] for r in spark.table("cities").collect()) == ["X", "Y"]
    finally:
        query.stop()
        server.close()


def test_window_rows_are_appended(spark, tmp_path):
    each = writers.append_windows(str(tmp_path / "out"))
    frame = spark.sql("SELECT timestamp '2024-01-02 03:04:05' AS window_start, 7L AS truth, 6.5D AS estimate")
    each(frame, 0)
    each(frame.where("false"), 1)
    each(frame, 2)
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.columns == ["Time", "Ground Truth", "Estimation"] and [tuple(r) for r in got.collect()] == [("2024-01-02 03:04:05", "7", "6.5")] * 2


def test_more_reports(spark, tmp_path):
    scores = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 9.0), ("a", "c", 1.0)], "a string, b string, score double")
    assert writers.betweenness_report(scores) == "('c', 'd'), 9.0\n('a', 'b'), 1.0\n('a', 'c'), 1.0"
    counts = spark.createDataFrame([("first", 6), ("second", 3), ("both", 2)], "name string, n long")
    assert writers.overlap_report(counts) == "Task2,6\nTask3,3\nIntersection,2"
    tags = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "tag string, cnt long")
    assert writers.trending_report(9, tags) == "The number of tweets with tags from the beginning: 9\nc : 5\na : 2\nb : 2\n"
    writers.csv_with_header(tags, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("a", "2"), ("b", "2"), ("c", "5")]
    writers.model_tables({"tags": tags, "counts": counts}, str(tmp_path / "model"))
    assert readers.model_table(spark, str(tmp_path / "model"), "counts").count() == 3
    (tmp_path / "stop").write_text("the\n\n and \nthe\n")
    assert sorted(readers.stopwords(spark, str(tmp_path / "stop"))) == ["and", "the"]


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())
    Context.master = "local[4]"
    assert storage.shared_dir(Session())


def test_stored_tables_can_be_released(spark):
    kept = list(storage._written)
    storage._written.clear()
    try:
        df = storage.stored(spark.range(3).toDF("id"), "probe")
        path = storage._written[0]
        assert df.count() == 3 and os.path.isdir(path)
        storage.release(spark)
        assert not os.path.isdir(path) and not storage._written
        frames = [storage.stored(spark.range(k).toDF("id"), "probe") for k in range(1, 5)]
        paths = list(storage._written)
        storage.release(spark, since=1, but_last=1)
        assert storage._written == [paths[0], paths[3]] and [os.path.isdir(p) for p in paths] == [True, False, False, True]
        assert storage.stored_so_far() == 2 and frames[3].count() == 4
        storage.release(spark)
    finally:
        storage._written[:] = kept


def test_json_stream_fields(spark):
    lines = spark.createDataFrame([(json.dumps({"city": "X"}),), (json.dumps({"city": ""}),), ("{}",)], "value string")
    assert [r[0] for r in replay.json_field(lines, "city").collect()] == ["X"]
    assert replay.track(lines, "value", ["CITY"]).count() == 2
