"""Benchmark decontamination: an FM-index for each training shard, searched backward for every benchmark phrase.

A shard is a run of documents of one partition with about SHARD_WORDS words. Its words become integers: one for each
word of the benchmark, 0 for all others, which end every match. Stretches of benchmark words that are shorter than the
shortest phrase cannot hold one and are left out; the rest is indexed: suffix array, Burrows-Wheeler transform in a
wavelet tree with rank tables, and suffix positions sampled at every SAMPLE-th place. All phrases are searched at once,
symbol by symbol from their ends; occurrences are located by walking to a sampled position; overlapping occurrences
are merged to the spans to remove.

The phrases are broadcast in blocks of BLOCK_WORDS words. A worker holds one index and one block at a time whatever the
size of the benchmark: it lets go of a block before it reads the next one from the executor's disk; a single block is
kept. Documents are never shuffled.

Defined results: null and empty texts have no words and no hits; an item without words has no phrase; a null item_id
counts as an empty string; equal item_ids count once; repeated documents are each judged; an empty table of either
kind gives no hits; columns of the input called like a new one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import bounded, byte_list, chunks

WIDTH = 10
SHARD_WORDS, BLOCK_WORDS, SAMPLE = 700_000, 2_000_000, 8
#: Lower-cases A-Z and turns every other ASCII character but letters and digits into a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split_words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return text.translate(FOLD).split()


class WaveletTree:
    """Symbols below 2**bits, one bit vector a level (highest bit first), each with counts of the ones before."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] - ones[at]
            out = out << 1 | one
            at = np.where(one == 1, self.zeros[k] + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling the compared length."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Counts and locates phrases of symbols 1..top in a text of symbols 0..top."""

    def __init__(self, text: np.ndarray, top: int):
        # A last 0 below everything else makes the transform one cycle; shift symbols to keep it apart.
        text = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_array(text)
        counts = np.bincount(text, minlength=top + 3)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(text[order - 1], max(1, int(top + 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.n = len(text)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of the suffix array that start with each phrase (right-aligned, 0-filled)."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            c = phrases[live, -back] + 1
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start."""
        steps, out = np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows[live]]
            hit = live[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            live = live[~done]
            c = self.tree.symbol(rows[live])
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return out


def phrase_blocks(bench: DataFrame, width: int, item: str = "item_id", text: str = "text"):
    """Blocks of (item, words of a phrase): windows of ``width`` words of each item, or the whole shorter item."""
    block, size = [], 0
    rows = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t"))
    for i, t in rows.toLocalIterator(prefetchPartitions=True):
        words = split_words(bytes(t or b""))
        for a in range(max(1, len(words) - width + 1) if words else 0):
            block.append((i, tuple(words[a : a + width])))
            size += width
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


class Phrases:
    """The distinct phrases of a block as integers, and the items of each."""

    def __init__(self, block: list[tuple[str, tuple[bytes, ...]]], width: int):
        items: dict[tuple[bytes, ...], set[str]] = {}
        for i, words in block:
            items.setdefault(words, set()).add(i)
        self.items = [sorted(x) for x in items.values()]
        self.ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for p in items for w in p))}
        self.lengths = np.array([len(p) for p in items], dtype=np.int64)
        self.codes = np.zeros((len(items), width), dtype=np.int64)
        for k, p in enumerate(items):
            self.codes[k, width - len(p) :] = [self.ids[w] for w in p]

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences in a shard: document, first word, length, phrase."""
        get = self.ids.get
        ends = np.cumsum([len(d) + 1 for d in docs])
        text = np.zeros(int(ends[-1]) if len(docs) else 0, dtype=np.int64)
        for d, end in zip(docs, ends):
            text[end - 1 - len(d) : end - 1] = [get(w, 0) for w in d]
        shortest = int(self.lengths.min())
        known = np.concatenate([[0], (text > 0).astype(np.int8), [0]])
        starts, stops = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = stops - starts >= shortest
        starts, stops = starts[long], stops[long]
        if not len(starts):
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, empty, empty
        size = stops - starts + 1  # each stretch with the 0 after it
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        index = FmIndex(text[at], len(self.ids))
        low, high = index.ranges(self.codes, self.lengths)
        found = np.flatnonzero(high > low)
        n = (high - low)[found]
        phrase = np.repeat(found, n)
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        place = at[index.locate(rows)]
        doc = np.searchsorted(ends, place, side="right")
        first = place - np.concatenate([[0], ends])[doc]
        return doc, first, self.lengths[phrase], phrase


def each_block(blocks: list, width: int, kept: dict) -> Iterator[Phrases]:
    """The phrases of one broadcast block after the other; what a block took is free again before the next one is read."""
    for b in blocks:
        if len(blocks) > 1:
            yield Phrases(b.value, width)
            vars(b).pop("_value", None)  # else the worker would keep all blocks
        else:
            if not kept:
                kept[0] = Phrases(b.value, width)
            yield kept[0]


def merged(first: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching occurrences as spans (first word, word after the last)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), (first + length).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words in the spans, from the first letter of each span to its last."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


NEW = {"n_words": "long", "n_hit": "long", "spans": "array<struct<first:int,after:int>>", "items": "array<string>", "clean_text": "string"}


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH, text: str = "text", clean: bool = False) -> DataFrame:
    """``docs`` without its text, with n_words, n_hit (words inside occurrences), spans (in words), items (ids of the
    benchmark items with occurrences, in string order) and, if ``clean``, clean_text: the text without the spans (null
    where there are none)."""
    bounded(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in phrase_blocks(bench, width)]
    new = {k: v for k, v in NEW.items() if clean or k != "clean_text"}
    own = [c for c in docs.columns if c not in (text, *new)]

    def shard(part: list[pa.RecordBatch], kept: dict):
        whole = pa.Table.from_batches(part)
        raw = [t for b in part for t in byte_list(b, text)]
        words = [split_words(t) for t in raw]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        found: dict[int, tuple[list, list, set]] = {}
        for phrases in each_block(blocks, width, kept):
            for d, f, n, p in zip(*(x.tolist() for x in phrases.find(words))):
                firsts, lengths, items = found.setdefault(d, ([], [], set()))
                firsts.append(f)
                lengths.append(n)
                items.update(phrases.items[p])
        spans = {d: merged(np.array(f), np.array(n)) for d, (f, n, _) in found.items()}
        columns = [
            pa.array(counts, pa.int64()),
            pa.array([sum(b - a for a, b in spans.get(d, ())) for d in range(len(raw))], pa.int64()),
            pa.array([[{"first": a, "after": b} for a, b in spans.get(d, ())] for d in range(len(raw))], pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
            pa.array([sorted(found[d][2]) if d in found else [] for d in range(len(raw))], pa.list_(pa.string())),
        ]
        if clean:
            columns.append(pa.array([without(raw[d], spans[d]).decode() if d in spans else None for d in range(len(raw))], pa.string()))
        kept = whole.select(own).combine_chunks()
        yield from pa.Table.from_arrays([*kept.columns, *columns], [*own, *new]).combine_chunks().to_batches()

    def run(batches):
        part, size, kept = [], 0, {}
        for batch in chunks(batches, text):
            part.append(batch)
            size += batch.nbytes
            if size >= SHARD_WORDS * 6:
                yield from shard(part, kept)
                part, size = [], 0
        if part:
            yield from shard(part, kept)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own], *[f"`{k}` {v}" for k, v in new.items()]])
    return docs.select(*[f"`{c}`" for c in own], f"`{text}`").mapInArrow(run, schema)
