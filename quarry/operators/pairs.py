"""Pairs of keys that meet in common groups, counted without a shuffle of pairs.

A group's keys are one sorted list. Each key gets the rest of the list behind it, so what is moved for a pair is one
number of 4 bytes (and its value) instead of a row. All that a key gets is in one task, sorted by key, and is counted
piece by piece: a task holds some million pairs and the neighbours of one key, whatever the size of the tables. The
number of tasks follows the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dense import dense_ids
from quarry.storage import stored

#: Pairs that a task counts and that a task deals out (unless one key has more), and pairs that a worker holds at once.
TASK_PAIRS, DEALT_PAIRS, HELD_PAIRS = 4_000_000, 8_000_000, 1 << 20
#: Up to this many keys, pairs are counted in the tasks that have the lists, before any shuffle.
FEW_KEYS = 500
#: Up to this many different values a value is moved as one byte.
BYTE_VALUES = 256
MOST_TASKS = 20_000

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
SUMS = ("sx", "sy", "sxx", "syy", "sxy")


def load(groups: DataFrame, by: list[str]) -> int:
    """How many pairs the groups have, a pair counting once for each group it is in."""
    n = F.col("_n").cast("double")
    return int(groups.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()[0])


def met(rows: DataFrame, key: str, by: list[str], value: str | None = None, at_least: int = 1, share: float | None = None) -> DataFrame:
    """(a, b, n) of the pairs a < b of ``key`` that have ``at_least`` groups ``by`` in common; ``rows``: distinct (by, key).

    With ``value`` also the sums sx, sy, sxx, syy, sxy of the values x of a and y of b over the common groups; nulls add nothing. With
    ``share`` only pairs whose common groups are that share of all groups of a, or more.
    """
    kind, spark = rows.schema[key].dataType, rows.sparkSession
    rows = rows.select(*by, F.col(key).alias("_key"), *([F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value")] if value else [])).where(F.col("_key").isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    index, lists = None, None
    if kind.simpleString() in INTEGRAL:
        lists = _lists(rows, by, value, share)
        low, high, pairs = _extent(lists)
        if low < 0 or high >= 1 << 31:
            lists = None
    if lists is None:
        rows = stored(rows, "grouped")
        index = stored(dense_ids(rows, "_key"), "keys")
        lists = _lists(rows.join(index, "_key").drop("_key").withColumnRenamed("idx", "_key"), by, value, share)
        low, high, pairs = _extent(lists)
    levels = _levels_of(lists) if value else None
    out = _counted_at_once(lists, value, at_least, share) if high - low < FEW_KEYS else _dealt(lists, pairs, value, levels, at_least, share)
    columns = ["n", *(SUMS if value else ())]
    if index is None:
        return out.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), *columns)
    ends = [index.select(F.col("_key").alias(f"_{c}"), F.col("idx").alias(c)) for c in "ab"]
    return out.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), *columns)


def _lists(rows: DataFrame, by: list[str], value: str | None, share: float | None) -> DataFrame:
    """The groups of two keys or more, as a table of sorted lists: keys, their values and their numbers of groups."""
    if share is not None:
        sizes = rows.groupBy("_key").agg(F.count("*").cast("int").alias("_size"))
        rows = rows.join(sizes, "_key")
    parts = [F.col("_key").cast("long").alias("k"), *([F.col("_value").alias("v")] if value else []), *([F.col("_size").alias("s")] if share is not None else [])]
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("l")).where(F.size("l") > 1)
    wanted = {"k": "keys", **({"v": "values"} if value else {}), **({"s": "sizes"} if share is not None else {})}
    return stored(lists.select(F.xxhash64(*by).alias("group"), *[F.col("l")[c].alias(name) for c, name in wanted.items()]), "lists")


def _extent(lists: DataFrame) -> tuple[int, int, int]:
    """Least and greatest key, and the number of pairs."""
    n = F.size("keys").cast("double")
    found = lists.agg(F.min(F.col("keys")[0]), F.max(F.element_at("keys", -1)), F.sum(n * (n - 1) / 2)).first()
    return (0, 0, 0) if found[0] is None else (int(found[0]), int(found[1]), int(found[2]))


def _levels_of(lists: DataFrame) -> list[float] | None:
    """The different values, if they are few."""
    found = [r[0] for r in lists.select(F.explode("values").alias("v")).distinct().limit(BYTE_VALUES + 1).collect()]
    return None if len(found) > BYTE_VALUES or any(v != v for v in found) else sorted(found)


def _sums() -> list:
    x, y = F.col("x"), F.col("y")
    return [F.sum(e).alias(c) for c, e in zip(SUMS, (x, y, x * x, y * y, x * y))]


def _rest(column: str):
    return F.slice(column, F.col("i") + 1, F.size(column))


def _counted_at_once(lists: DataFrame, value: str | None, at_least: int, share: float | None) -> DataFrame:
    """Few keys have few pairs, which the tasks that have the lists sum up before the shuffle."""
    at = lists.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("keys") - 1)))
    one = at.select(F.element_at("keys", F.col("i")).alias("a"), *([F.element_at("values", F.col("i")).alias("x")] if value else []),
        *([F.element_at("sizes", F.col("i")).alias("size")] if share is not None else []), F.inline(F.arrays_zip(_rest("keys").alias("b"), *([_rest("values").alias("y")] if value else []))))
    kept = one.groupBy("a", "b").agg(F.count("*").alias("n"), *(_sums() if value else []), *([F.first("size").alias("size")] if share is not None else [])).where(F.col("n") >= at_least)
    return kept if share is None else kept.where(F.col("n") >= F.col("size") * share - 1e-6)


def _dealt(lists: DataFrame, pairs: int, value: str | None, levels: list | None, at_least: int, share: float | None) -> DataFrame:
    """Each key gets the rest of its lists; the tasks count."""
    spark = lists.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    maps, tasks = (min(MOST_TASKS, max(least, -(-pairs // most))) for most in (DEALT_PAIRS, TASK_PAIRS))
    columns = ["group", F.col("keys").cast("array<int>").alias("keys")]
    if value:
        code = lambda v: (F.array_position(F.array(*[F.lit(x) for x in levels]), v) - 129).cast("tinyint")
        columns.append((F.transform("values", code) if levels else F.col("values")).alias("values"))
    if share is not None:
        columns.append("sizes")
    # Places of a long list are dealt out as well, so that no task has all pairs of it.
    step = F.greatest(F.lit(1), F.floor(F.lit(DEALT_PAIRS / 8) / F.size("keys"))).cast("int")
    pieces = lists.select(*columns).withColumn("step", step).withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("keys") - 1, F.col("step")))).repartition(maps, "group", "begin")
    until = F.least(F.col("begin") + F.col("step") - 1, F.size("keys") - 1)
    at = pieces.select(*pieces.columns, F.explode(F.sequence("begin", until)).alias("i"))
    given = at.select(F.element_at("keys", F.col("i")).alias("a"), *([F.element_at("values", F.col("i")).alias("x")] if value else []),
        *([F.greatest(F.lit(at_least), F.ceil(F.element_at("sizes", F.col("i")) * share - 1e-6).cast("int")).alias("need")] if share is not None else []),
        _rest("keys").alias("b"), *([_rest("values").alias("y")] if value else []))
    dealt = given.repartition(tasks, "a").sortWithinPartitions("a")
    names = ["n", *(SUMS if value else ())]
    table = np.array(levels) if levels else None
    schema = "a int, b int, n long" + "".join(f", {c} double" for c in names[1:])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, sums in _summed(batches, bool(value), table, at_least):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, sums)], ["a", "b", *names])

    return dealt.mapInArrow(count, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and members, end to end, of a column of lists."""
    return np.diff(np.asarray(column.offsets)), column.flatten().to_numpy(zero_copy_only=False)


def _totals(code: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different codes in order, and the sums of the columns over each."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], [np.add.reduceat(c[order], first) for c in columns]


def _numbers(codes: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    return codes if levels is None else levels[codes.astype(np.int64) + 128]


def _aggregate(held: list, valued: bool, levels: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of what is held, by pair."""
    a, sizes, b = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
    code = (np.repeat(a.astype(np.int64), sizes) << 32) | b
    if not valued:
        code.sort()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[first], [np.diff(np.append(first, len(code)))]
    x = np.repeat(_numbers(np.concatenate([h[3] for h in held]), levels), sizes)
    y = _numbers(np.concatenate([h[4] for h in held]), levels)
    return _totals(code, [np.ones(len(code), dtype=np.int64), x, y, x * x, y * y, x * y])


def _summed(batches: Iterator[pa.RecordBatch], valued: bool, levels: np.ndarray | None, at_least: int):
    """(a, b, sums) of the pairs with enough common groups; batches come in the order of a."""
    held, size, rest, needs = [], 0, None, None

    def flush(last: bool):
        nonlocal held, size, rest, needs
        if held:
            code, sums = _aggregate(held, valued, levels)
            if needs is not None:
                needs = (np.concatenate([needs[0], *[h[0] for h in held]]), np.concatenate([needs[1], *[h[5] for h in held]]))
            if rest is not None:
                # The key that went on from the last piece comes first.
                same = int(np.searchsorted(code, ((rest[0][0] >> 32) + 1) << 32))
                head, tops = _totals(np.concatenate([rest[0], code[:same]]), [np.concatenate(c) for c in zip(rest[1], [s[:same] for s in sums])])
                code, sums = np.concatenate([head, code[same:]]), [np.concatenate([t, s[same:]]) for t, s in zip(tops, sums)]
        elif rest is not None:
            code, sums = rest
        else:
            return None
        held, size, rest = [], 0, None
        if not last:
            cut = int(np.searchsorted(code, (code[-1] >> 32) << 32))
            rest, code, sums = (code[cut:], [s[cut:] for s in sums]), code[:cut], [s[:cut] for s in sums]
        need = at_least
        if needs is not None:
            need = needs[1][np.searchsorted(needs[0], code >> 32)]
            needs = (needs[0][-1:], needs[1][-1:])
        kept = sums[0] >= need
        code, sums = code[kept], [s[kept] for s in sums]
        return (code >> 32).astype(np.int32), (code & 0x7FFFFFFF).astype(np.int32), sums

    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, b = _flat(batch.column("b"))
            extra = [batch.column("x").to_numpy(zero_copy_only=False), _flat(batch.column("y"))[1]] if valued else [None, None]
            asked = batch.column("need").to_numpy() if "need" in batch.schema.names else None
            if asked is not None and needs is None:
                needs = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
            a = batch.column("a").to_numpy()
            # A batch of very long lists is cut at rows, so that no more is held than a piece and one list.
            ends = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < len(a):
                begin = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, begin + HELD_PAIRS - size, side="right")))
                stop = int(ends[to - 1])
                held.append((a[at:to], sizes[at:to], b[begin:stop], extra[0][at:to] if valued else None, extra[1][begin:stop] if valued else None, asked[at:to] if asked is not None else None))
                size, at = size + stop - begin, to
                if size >= HELD_PAIRS * 7 // 8 and (found := flush(False)) and len(found[0]):
                    yield found
        if (found := flush(True)) and len(found[0]):
            yield found
    finally:
        pa.default_memory_pool().release_unused()
