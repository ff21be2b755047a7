"""Substring dedup by relative Lempel-Ziv parsing.

What a document repeats of documents with smaller ids is found by parsing it greedily into factors copied from
reference blocks. The corpus is split into blocks by content, so that a document need not meet blocks that cannot
hold a copy of any of its windows: each window of WINDOW words picks the least hash among its runs of GRAM words, and
like windows pick alike. A block is the index of all stretches whose windows picked hashes of one bucket; stretches
whose hash occurs in one document only are left out, as nothing can be copied from them.

A task hands on each stretch once: one that a smaller document of the task has word for word is a factor as it is. So a
passage that a third of all documents share reaches its block as often as there are tasks, not as there are documents.

In a block, stretches come in order of doc_id. A factor starts where the next WINDOW words stand in the index and is
the longest run of words from there that stands in any reference stretch; factors are at least WINDOW words. Windows across the
end of a factor are checked anew, since another source may hold them. All factors together cover just the windows that
some smaller document has.

Defined results: a null or empty text has no words, nothing is removed; a null doc_id is neither judged nor a source;
rows of the same doc_id are no source for one another and are judged each by itself, whatever their texts; an empty
table gives an empty result; texts of any length are parsed whole; columns of the input called like a new one are
replaced. Hashes of 64 bits tell the texts of one doc_id apart and choose what is looked at; windows are compared word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.llm.arrow import bounded, byte_list, chunks
from quarry.llm.fingerprints import PACKED_SCHEMA, Packer, WordHashes, bucket_count, grams, shared, short

WINDOW, GRAM = 13, 5
#: Windows in a stretch at most; a longer run of one hash, as in a text that repeats a phrase, is several stretches.
MOST_WINDOWS = 48
#: Stretches that a task remembers, so that it hands each on once; it starts anew beyond.
STRETCHES_KEPT = 100_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def stretches(hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of neighbouring windows that pick the same hash, over documents laid end to end.

    ``sizes``: words of each document. Returns the hash, the document, and the first and last window of each run.
    """
    count = len(hashes) - window + 1
    if count <= 0:
        empty = np.empty(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    g = grams(hashes, gram)
    width = window - gram + 1
    low, have = g, 1
    while have < width:  # least of ``have`` neighbours, doubled
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, np.arange(count), side="right")
    valid = np.arange(count) + window <= ends[doc]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    if len(starts):
        inside = np.arange(count) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        first |= valid & (inside % MOST_WINDOWS == 0)
        starts = np.flatnonzero(first)
    last = np.append(valid[1:] & first[1:] | ~valid[1:], True) & valid
    return low[starts], doc[starts], starts, np.flatnonzero(last)


class Batch:
    """The words of a batch's documents, laid end to end."""

    def __init__(self, batch: pa.RecordBatch, known: WordHashes, text: str):
        self.words = [t.split() for t in byte_list(batch, text)]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = [w for ws in self.words for w in ws]
        self.runs = stretches(known.of(flat), self.sizes)


class Block:
    """A reference block: a trie of all that starts with a window of a stretch so far; windows are its first nodes."""

    def __init__(self, window: int = WINDOW):
        self.window, self.windows, self.after, self.known, self.waiting = window, {}, {}, set(), []

    def admit(self) -> None:
        """Index what the last document brought."""
        windows, after = self.windows, self.after
        for text, words, keys in self.waiting:
            if text in self.known:
                continue
            self.known.add(text)
            for i, key in enumerate(keys):
                node = windows.setdefault(key, len(windows) + len(after))
                for word in words[i + self.window :]:
                    node = after.setdefault((node, word), len(windows) + len(after))
        self.waiting.clear()

    def factors(self, text: bytes) -> list[tuple[int, int]]:
        """The factors of a stretch that are a window or longer, as (first word, word after the last)."""
        words = text.split(b" ")
        n, get = self.window, self.after.get
        keys = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        self.waiting.append((text, words, keys))
        if text in self.known:
            return [(0, len(words))]
        out, i = [], 0
        while i < len(keys):
            if (node := self.windows.get(keys[i])) is None:
                i += 1
                continue
            end = i + n
            while end < len(words) and (node := get((node, words[end]))) is not None:
                end += 1
            out.append((i, end))
            i = end - n + 1  # the first window across the end of the factor
        return out


def identified(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    """_id, _text and _row, which tells the texts of one id apart."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"), *more).withColumn("_row", F.xxhash64("_id", "_text"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, array of (row, first, after) in words, of documents that repeat windows of smaller documents;
    ``row`` is the xxhash64 of doc_id and text."""
    bounded(docs.sparkSession)
    return _spans(identified(docs, doc_id, text)).select(F.col("_id").alias(doc_id), "spans")


def _spans(rows: DataFrame) -> DataFrame:
    buckets = bucket_count(rows)

    def sign(batches):
        known, packer = WordHashes(), Packer(buckets)
        for batch in chunks(batches, "_text"):
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            keys, doc, _, _ = Batch(batch, known, "_text").runs
            yield from packer.add(keys, ids[doc], np.zeros(len(keys)))
        yield from packer.flush()

    common = shared(rows.select("_id", "_text").where("_id is not null").mapInArrow(sign, PACKED_SCHEMA))
    wanted = common.groupBy(F.col("owner").alias("_id")).agg(F.collect_list("key").alias("keys"))  # as bounded as a document
    # All columns and a left join keep this side's plan like that of dedup()'s last join: Spark shuffles the texts once
    # and reuses the exchange.
    met = rows.join(wanted.hint("merge"), "_id", "left")

    def cut(batches):
        known, least = WordHashes(), {}
        for batch in chunks(batches, "_text"):
            batch = batch.filter(pa.compute.is_valid(batch.column("keys")))
            if not batch.num_rows:
                continue
            own = Batch(batch, known, "_text")
            keys, doc, first, last = own.runs
            lists = batch.column("keys").combine_chunks() if isinstance(batch.column("keys"), pa.ChunkedArray) else batch.column("keys")
            offsets = lists.offsets.to_numpy()
            values, ids_of_keys = lists.values.to_numpy(), short(keys, buckets)
            hit = np.zeros(len(keys), dtype=bool)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                a, b = bounds[d], bounds[d + 1]
                hit[a:b] = np.isin(ids_of_keys[a:b], values[offsets[d] : offsets[d + 1]])
            keys, doc, first, last = keys[hit], doc[hit], first[hit], last[hit]
            starts = first - own.before[doc]
            texts = [b" ".join(own.words[d][a : a + n]) for d, a, n in zip(doc.tolist(), starts.tolist(), (last - first + WINDOW).tolist())]
            ids, rows_ = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("_id", "_row"))
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            if len(least) > STRETCHES_KEPT:
                least.clear()
            for k, (text, d) in enumerate(zip(texts, ids.tolist())):
                if least.setdefault(text, d) < d:
                    # A smaller document of this task has it: a factor as it is, which any block may pass on.
                    texts[k], bucket[k] = None, (rows_[k] ^ starts[k]) % buckets
                else:
                    least[text] = d
            after = starts + last - first + WINDOW
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(ids), pa.array(rows_), pa.array(starts.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(texts, pa.binary())],
                ["bucket", "_id", "row", "start", "after", "words"],
            )

    def parse(batches):
        block, bucket, doc = Block(), None, None
        for batch in batches:
            ids, rows_, starts, out = [], [], [], []
            for b, d, row, start, after, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "_id", "row", "start", "after", "words"))):
                if words is None:
                    ids.append(d)
                    rows_.append(row)
                    starts.append(start)
                    out.append(after)
                    continue
                if b != bucket:
                    block, bucket, doc = Block(), b, d
                elif d != doc:
                    block.admit()
                    doc = d
                for first, end in block.factors(words):
                    ids.append(d)
                    rows_.append(row)
                    starts.append(start + first)
                    out.append(start + end)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows_, pa.int64()), pa.array(starts, pa.int32()), pa.array(out, pa.int32())], ["_id", "row", "first", "after"])

    pieces = met.mapInArrow(cut, "bucket int, _id long, row long, start int, after int, words binary")
    found = pieces.repartition(F.col("bucket")).sortWithinPartitions("bucket", "_id").mapInArrow(parse, "_id long, row long, first int, after int")
    return found.groupBy("_id").agg(F.collect_set(F.struct("row", "first", "after")).alias("spans"))


def covered(n: int, row: int, found) -> np.ndarray:
    """Which of ``n`` words lie in spans of that row."""
    out = np.zeros(n, dtype=bool)
    for s in found or ():
        if s["row"] == row:
            out[s["first"] : s["after"]] = True
    return out


def cut_out(text: bytes, gone: np.ndarray) -> bytes:
    """A text without the words that are gone and the white space before each; the rest stays as it is."""
    out, last = [], 0
    for k, m in enumerate(WORD.finditer(text)):
        if not gone[k]:
            out.append(text[last : m.end()])
        last = m.end()
    return b"".join(out).lstrip(b" \t\n\v\f\r")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_space: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the kept words joined by one space or, with ``keep_space``, the
    text without the removed words. The text itself is not returned."""
    bounded(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_text")]
    # The columns passed by go in one struct, so that no name can clash.
    rows = identified(docs, doc_id, text, F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"))
    found = _spans(rows)

    def remove(batches):
        for batch in chunks(batches, "_text"):
            counts, removed, kept = [], [], []
            for raw, row, s in zip(byte_list(batch, "_text"), batch.column("_row").to_pylist(), batch.column("spans").to_pylist()):
                words = raw.split()
                counts.append(len(words))
                if not s:
                    removed.append(0)
                    kept.append(raw if keep_space else b" ".join(words))
                    continue
                gone = covered(len(words), row, s)
                removed.append(int(gone.sum()))
                kept.append(cut_out(raw, gone) if keep_space else b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *new], ["own", "n_words", "n_removed", "kept_text"])

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    return rows.join(found.hint("merge"), "_id", "left").mapInArrow(remove, StructType([rows.schema["own"], *added])).select("own.*", "n_words", "n_removed", "kept_text")
