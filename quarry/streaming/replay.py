"""Structured Streaming twins of the sketches: any streaming source in, tables out.

``socket_lines`` and ``file_events`` are the sources; a query reads all there is (``availableNow``) or runs on. State
lives in checkpoints under the shared folder, so a lost executor or a restart loses nothing.
"""

from __future__ import annotations

import bisect
import heapq
import json
import random
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from quarry.functions.hashing import affine
from quarry.operators.sketch import bloom_build, bloom_probe, fm_estimate, reservoir_sample, trending
from quarry.storage import shared_dir, stored

#: The hash by which rows are drawn: (a x + b) mod m.
DRAW = (48271, 11, 2147483647)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A text stream of lines from a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the event table called ``name``, a file or a folder of files; files that arrive later come as well."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(EVENT)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def json_field(lines: DataFrame, field: str) -> DataFrame:
    """The non-empty values of a field of JSON lines."""
    value = F.get_json_object("value", f"$.{field}")
    return lines.select(value.alias(field)).where(value.isNotNull() & (value != ""))


def track(stream: DataFrame, column: str, phrases: list[str], languages: list[str] = (), language: str = "lang") -> DataFrame:
    """The rows that a track source gives: all words of one of the phrases stand in the text as whole words, whatever
    their case and order, with or without # or @; and the row is in one of the languages, if any are named."""
    said = F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}_]+")
    any_of: Column = F.lit(False)
    for phrase in phrases:
        any_of = any_of | F.forall(F.array(*[F.lit(w) for w in phrase.lower().split()]), lambda w: F.array_contains(said, w))
    return stream.where(any_of & F.col(language).isin(list(languages)) if languages else any_of)


class ErrorPolicy(StreamingQueryListener):
    """Listens to a session's queries: keeps the errors that ended some, and calls ``then`` with each; no restart."""

    def __init__(self, then: Callable[[str], None] | None = None):
        self.errors: list[str] = []
        self.ended, self.then = 0, then

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
        if event.exception is not None:
            self.errors.append(event.exception)
            if self.then:
                self.then(event.exception)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off all that a stream has, batch by batch; any error stops the query and is raised."""
    where = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(each).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def windowed_sets(events: DataFrame, ts: str, column: str, width: str, step: str, late: str) -> DataFrame:
    """Distinct (window_start, value) of sliding windows; state of windows older than ``late`` is dropped."""
    spread = events.withWatermark(ts, late).select(F.window(ts, width, step).alias("w"), F.col(column).cast("string").alias("v"))
    return spread.groupBy("w", "v").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "v")


class Reservoir(StatefulProcessor):
    """The ``size`` rows of least seeded hash of a group, the same as ``sketch.reservoir_sample`` takes, and how many rows
    were seen; emits the kept rows after each batch."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reservoir", "seen long, kept string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen, kept = (lambda s: (s[0], json.loads(s[1])) if s else (0, []))(self.state.get())
        for pdf in rows:
            seen += len(pdf)
            kept = heapq.nsmallest(self.size, [*kept, *map(list, zip(pdf["draw"].tolist(), pdf["event_id"].tolist(), pdf["user_id"].tolist(), pdf["event_type"].tolist()))], key=lambda r: r[:2])
        self.state.update((seen, json.dumps(kept)))
        yield pd.DataFrame([[key[0], seen, *r[1:]] for r in kept], columns=["lane", "seen", "event_id", "user_id", "event_type"])

    def close(self) -> None:
        pass


def reservoir(events: DataFrame, size: int = 100, lanes: int = 8) -> DataFrame:
    """(lane, seen, event_id, user_id, event_type): a reservoir for each of some lanes that rows are dealt to, so no task
    sees all rows. ``merged`` makes one of them."""
    rows = events.select("event_id", "user_id", "event_type", affine(F.col("event_id"), *DRAW).alias("draw"))
    return rows.withColumn("lane", F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int")).groupBy("lane").transformWithStateInPandas(
        statefulProcessor=Reservoir(size), outputStructType="lane int, seen long, event_id long, user_id long, event_type string", outputMode="Update", timeMode="None"
    )


def merged(lanes: DataFrame, size: int = 100) -> DataFrame:
    """One reservoir of all rows from the lanes' reservoirs: the rows of least hash among them are those of all."""
    return reservoir_sample(lanes.select("event_id", "user_id", "event_type"), "event_id", size, *DRAW)


class TagReservoir:
    """One reservoir of ``size`` tagged events, with the counts of their tags, which fall when an event is evicted.

    The n-th tagged event is kept while n <= size, then with a chance of size / n, in place of a random one. Every
    tagged event, kept or not, gives a report: the tags whose count is among the ``top`` highest distinct counts.
    """

    def __init__(self, size: int, top: int, seed: int):
        self.size, self.top, self.seed = size, top, seed

    def keeps(self, seen: int) -> bool:
        """Whether the event of this number is kept, which hangs on the number alone."""
        return seen <= self.size or random.Random(self.seed * 1_000_003 + seen).randint(1, seen) <= self.size

    def report(self, counts: Counter) -> list[tuple[str, int]]:
        highest = sorted(set(counts.values()), reverse=True)[: self.top]
        return [(t, n) for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n in highest]

    def take(self, seen: int, tags: list, kept: list, counts: Counter) -> None:
        """Keep the event or not, and the counts with it."""
        draw = random.Random(self.seed * 1_000_003 + seen)
        if len(kept) < self.size:
            kept.append(tags)
        elif draw.randint(1, seen) <= self.size:
            slot = draw.randrange(self.size)
            counts.subtract(kept[slot])
            kept[slot] = tags
        else:
            return
        counts.update(tags)
        for t in [t for t, n in counts.items() if n == 0]:
            del counts[t]


class TagReports:
    """Writes (seen, event_id, tag, cnt), the trending tags of the reservoir after each tagged event, batch by batch.

    Events of a batch come in the order of their ids. Which numbers are kept hangs on the numbers alone, so tasks number the
    events and draw; only the kept ones, some size x ln(n), are played through on the driver. Between two of them the report
    stays the same, so tasks write it for all events of the stretch. The state after each batch is a file.
    """

    def __init__(self, path: str, size: int = 100, top: int = 3, seed: int = 1):
        self.reservoir, self.path, self.state = TagReservoir(size, top, seed), path, f"{path}-state"

    def after(self, spark: SparkSession, batch: int) -> tuple[int, list]:
        """How many events were seen and which tags are kept after a batch."""
        if batch < 0:
            return 0, []
        found = spark.read.schema("seen long, kept string").parquet(f"{self.state}/{batch}").first()
        return found["seen"], json.loads(found["kept"])

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark, reservoir = events.sparkSession, self.reservoir
        before, kept = self.after(spark, batch - 1)
        rows = stored(events.where(F.size("tags") > 0).select("event_id", "tags"), "tagged")
        numbered = stored(_numbered(rows, before), "numbered")
        keeps = F.udf(reservoir.keeps, "boolean")
        drawn = numbered.where((F.col("seen") <= reservoir.size) | keeps("seen")).orderBy("seen").collect()
        counts = Counter(t for tags in kept for t in tags)
        reports = [(before + 1, t, n) for t, n in reservoir.report(counts)] if not drawn or drawn[0]["seen"] > before + 1 else []
        starts = [before + 1] if reports else []
        for row in drawn:
            reservoir.take(row["seen"], list(row["tags"]), kept, counts)
            starts.append(row["seen"])
            reports += [(row["seen"], t, n) for t, n in reservoir.report(counts)]
        total = before + rows.count()
        # The last start at or before an event's number.
        places = spark.sparkContext.broadcast(starts)
        start = F.pandas_udf(lambda seen: pd.Series([places.value[k - 1] if k else 0 for k in (bisect.bisect_right(places.value, x) for x in seen)]), "long")
        stretches = spark.createDataFrame(reports, "start long, tag string, cnt long")
        out = numbered.select("seen", "event_id", start("seen").alias("start")).join(F.broadcast(stretches), "start").select("seen", "event_id", "tag", "cnt")
        out.write.mode("overwrite").parquet(f"{self.path}/part={batch}")
        spark.createDataFrame([(total, json.dumps(kept))], "seen long, kept string").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/{batch}")


def _numbered(rows: DataFrame, before: int) -> DataFrame:
    """(seen, event_id, tags): the rows numbered in the order of their ids, from ``before`` + 1 on; no task has all of them.

    Rows are dealt to ranges of ids and numbered within; the numbers before a range come from a table of the ranges' sizes.
    """
    parts = stored(rows.repartitionByRange("event_id", F.xxhash64("tags")).withColumn("range", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("range").orderBy("event_id", F.xxhash64("tags")))
    sizes, first = parts.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect(), []
    for r in sizes:
        first.append((r["range"], before))
        before += r["n"]
    ahead = rows.sparkSession.createDataFrame(first, "range int, ahead long")
    return parts.withColumn("within", within).join(F.broadcast(ahead), "range").select((F.col("ahead") + F.col("within")).alias("seen"), "event_id", "tags")


def tag_reports(events: DataFrame, size: int = 100, top: int = 3, seed: int = 1) -> DataFrame:
    """(seen, event_id, tag, cnt): the trending tags of the reservoir after each tagged event of a stream (event_id, tags)."""
    spark = events.sparkSession
    path = f"{shared_dir(spark)}/stream-tags-{uuid.uuid4().hex}"
    run_available(events, TagReports(path, size, top, seed))
    return spark.read.schema("seen long, event_id long, tag string, cnt long").parquet(f"{path}/part=*")


def _collected(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """All that a stream gives, as a table in the shared folder; of an updated key the last batch is to be taken."""
    path = f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    run_available(stream, lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path), mode)
    return stream.sparkSession.read.parquet(path)


def stream_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_start, truth, estimate) of sliding windows over the event stream."""
    sets = windowed_sets(file_events(spark, sf_dir), "ts", "user_id", "6 hours", "2 hours", "1 day")
    seen = _collected(sets, "update", "stream-fm").select("window_start", "v").distinct()
    return fm_estimate(seen, "v", ["window_start"]).select("window_start", "truth", F.round("estimate", 6).alias("estimate"))


def stream_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, cnt): tags of the event stream whose count is among the three highest."""
    tag = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    counts = file_events(spark, sf_dir).groupBy(tag.alias("tag")).agg(F.count("*").alias("cnt"))
    last = _collected(counts, "update", "stream-trending").groupBy("tag").agg(F.max_by("cnt", "batch").alias("cnt"))
    return trending(last)


@contextmanager
def rocks_db(spark: SparkSession):
    """The state store that keyed state needs, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type): a uniform sample of 100 rows of the event stream."""
    with rocks_db(spark):
        rows = _collected(reservoir(file_events(spark, sf_dir)), "update", "stream-reservoir")
    last = rows.groupBy("lane").agg(F.max("batch").alias("batch"))
    return merged(rows.join(last, ["lane", "batch"]))


def tags_of(events: DataFrame) -> DataFrame:
    """(event_id, tags): the type, and the type with its property, of each event that has one."""
    tag = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    return events.where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.array("event_type", tag).alias("tags"))


def stream_tag_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seen, event_id, tag, cnt): the trending report after every tagged event of the stream."""
    return tag_reports(tags_of(file_events(spark, sf_dir)))


def stream_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, hit): events of the stream whose user may be among the customers of one market segment."""
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("user"))
    asked = file_events(spark, sf_dir).select("event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"))
    found = bloom_probe(asked, "user", bloom_build(known, "user").transform(lambda b: stored(b, "bloom")))
    return _collected(found.select("event_id", F.col("hit").cast("long").alias("hit")), "append", "stream-bloom").drop("batch")
