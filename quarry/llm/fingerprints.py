"""Fingerprints of word sequences, and which of them several owners share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Its odd multiples tell the places in a word sequence apart.
ODD = 0x9E3779B97F4A7C15
#: Hashes of words that a worker remembers, and fingerprints that it packs before it hands them on.
WORDS_KEPT, PACKED = 100_000, 300_000


class WordHashes(dict):
    """64-bit hashes of words; starts anew beyond WORDS_KEPT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out += mixed(hashes[k : k + count] + np.uint64(ODD * (2 * k + 1) % 2**64))
    return mixed(out)


def bucket_count(df: DataFrame) -> int:
    """Buckets for fingerprints: a few for each shuffle partition, which users size to their data."""
    return 4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


PACKED_SCHEMA = "bucket int, keys binary, owners binary, sizes binary"
#: Bytes of a fingerprint that are handed on, its highest ones; with the bucket they tell fingerprints apart.
KEY_BYTES = 5


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Fingerprints as handed on: the highest KEY_BYTES bytes, and the bucket. That two fingerprints become one is rare,
    and only lets owners meet that need not."""
    return ((keys >> np.uint64(64 - 8 * KEY_BYTES)) << np.uint64(23) | keys % np.uint64(buckets)).view(np.int64)


class Packer:
    """Collects (fingerprint, owner, size below 2**16) and hands them on as one row of packed integers for each bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys.astype(np.uint64), owners.astype(np.int64), sizes.astype(np.uint16)))
        self.n += len(keys)
        if self.n >= PACKED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, owners, sizes = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        owners, sizes = owners[order], sizes[order]
        keys = (keys[order] >> np.uint64(64 - 8 * KEY_BYTES)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = [(b, keys[x:y].tobytes(), owners[x:y].tobytes(), sizes[x:y].tobytes()) for b, (x, y) in enumerate(zip(at, at[1:])) if y > x]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["bucket", "keys", "owners", "sizes"])


def unpacked(raw: bytes) -> np.ndarray:
    """The packed bytes of fingerprints as integers."""
    out = np.zeros((len(raw) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view(np.uint64)


def shared(packed: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The (key, owner) of fingerprints that two or more owners have, each once; keys are ``short``.

    ``near``: tells from the sizes of two neighbours, in order of size, whether they may belong together; an owner is
    returned only if it has such a neighbour.
    """

    def find(table: pa.Table) -> pa.Table:
        joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        keys, owners, sizes = unpacked(b"".join(table.column("keys").to_pylist())), joined("owners", np.int64), joined("sizes", np.uint16)
        bucket = np.uint64(table.column("bucket")[0].as_py() if table.num_rows else 0)
        order = np.lexsort((owners, sizes, keys))
        keys, owners, sizes = keys[order], owners[order], sizes[order]
        if len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
            keys, owners, sizes = keys[new], owners[new], sizes[new]
        pair = (keys[1:] == keys[:-1]) & (owners[1:] != owners[:-1])
        if near is not None:
            pair &= near(sizes[:-1], sizes[1:])
        kept = np.zeros(len(keys), dtype=bool)
        kept[1:] |= pair
        kept[:-1] |= pair
        return pa.table({"key": pa.array((keys[kept] << np.uint64(23) | bucket).view(np.int64)), "owner": pa.array(owners[kept])})

    return packed.groupBy("bucket").applyInArrow(find, "key long, owner long")
