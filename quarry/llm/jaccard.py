"""N-gram Jaccard join: documents whose sets of word shingles are alike, found by R-trees over count vectors.

A document is the set of its 5-word shingles, as 64-bit hashes. Equal sets are one class. Hashes fall into power-of-two
groups; the counts of a class by group are its point. Larger sets have more groups, always a power of two, so that
points fold to fewer groups where sets of two resolutions meet. Two sets share at most the sum over all groups of the smaller
count, so an R-tree over points, whose nodes keep the largest count of each group, bounds the overlap of a set with
all sets below a node. Pairs that pass the bound are verified on the sets themselves.

How the work is dealt out without all pairs:

1. Two sets with Jaccard >= t share at least k of the first n - ceil(t n) + k hashes of each, in order of hash. Classes
   that share fewer of these with classes of fitting size are linked with nothing and drop out.
2. Rounds of leaders: the rest is dealt by a min-hash. In a group, in order of size, each class is verified against
   the leaders that the R-tree gives; linked ones follow, others become leaders. Large groups are salted, and met again
   by the leaders that are left. This links most of what is alike, at a cost in proportion to the classes.
3. The exact round: the hashes of step 1 that classes of different components share are put together by the least
   class that has them. A class thus meets the others once for each such class, not once for each hash. Every such
   neighbourhood has its R-tree over points; classes for which no class of another component passes the bound drop out.
   The sets of the rest meet in the same neighbourhoods: pairs that pass the bound are verified at once and only links
   that connect what the neighbourhood had not connected yet are handed on, fewer than it has classes. Neighbourhoods of
   over CELL shingles are cut into parts, and each two parts of fitting sizes meet in a task of their own. No link
   between components is lost.

Defined results: a null text has an empty set; empty sets are linked with nothing and are their own component; texts
of fewer than 5 words are one shingle; repeated texts are one class; rows with a null doc_id are linked like others,
but a null never names a component (one that has nothing but null ids has a null name); an empty table gives an empty result; further columns are not
read. Hashes of 64 bits stand for shingles and sets: about N^2 / 2^65 of N documents would be mistaken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import bounded, byte_list, chunks
from quarry.llm.common import joined, stored
from quarry.llm.fingerprints import PACKED_SCHEMA, Packer, WordHashes, bucket_count, grams, mixed, shared
from quarry.operators.components import components

SHINGLE, PERCENT, FAN = 5, 80, 32
#: Groups of hashes: a power of two from the least to the most, at least twice a set's size between.
LEAST_GROUPS, MOST_GROUPS = 64, 32768
#: Sizes are handed on as logarithms in steps of this factor.
STEP = 1.002
#: Hashes by which prefixes are longer than they had to be, in percent of the set, so that more of them must agree.
EXTRA = 5
#: Orders of hashes for the rounds of leaders, classes in a group above which it is salted, and rounds of an order at most.
ORDERS, SALTED, ROUNDS = (0, 0x5DEECE66D1234567), 512, 3
#: Shingles in a neighbourhood of the exact round above which it is cut into parts, of half as many each.
CELL = 2_000_000
#: Classes that a task remembers in order to hand each on once.
CLASSES_KEPT = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], known: WordHashes, width: int = SHINGLE) -> list[np.ndarray]:
    """The set of shingle hashes of each text, in order."""
    words = [t.translate(LOWER).split() for t in texts]
    flat = known.of([w for ws in words for w in ws])
    all_grams = grams(flat, width)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(all_grams[at : at + n - width + 1]))
        elif n:
            out.append(grams(flat[at : at + n], n))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out


def groups_for(size: int) -> int:
    """The groups that a set of that size is counted in."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 2 << size.bit_length()))


def point(shingles: np.ndarray) -> np.ndarray:
    """The counts of a set by group of hashes."""
    groups = groups_for(len(shingles))
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def packed_point(shingles: np.ndarray) -> bytes:
    """A point as one bit a group, and the groups of all shingles but the first of each group."""
    counts = point(shingles)
    return np.packbits(counts > 0).tobytes() + np.repeat(np.arange(len(counts), dtype=np.uint16), np.maximum(counts - 1, 0)).tobytes()


def unpacked_point(raw: bytes, size: int) -> np.ndarray:
    groups = groups_for(size)
    more = np.frombuffer(raw, dtype=np.uint16, offset=groups // 8)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=groups // 8)).astype(np.int32) + np.bincount(more, minlength=groups).astype(np.int32)


def octave_of(size: int) -> int:
    """Sizes whose quotient is 100 / PERCENT at most lie in the same octave or in neighbours."""
    return int(math.floor(math.log(size) / math.log(100 / PERCENT) + 1e-9))


def octave_groups(octave: int) -> int:
    """The groups in which the sets of an octave and of the one below meet: those of the smallest such set."""
    return groups_for(int((100 / PERCENT) ** (octave - 1) * 0.99))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer groups."""
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def prefix(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least hashes of a set, of which every set that is alike has many in its own: see ``least_shared``."""
    n = len(shingles)
    return shingles[: n - -(-percent * n // 100) + 1 + EXTRA * n // 100]


def least_shared(n):
    """How many hashes of its prefix a set of ``n`` shares with the prefix of each set that is alike, at least.

    The k-th common hash stands among the first n - ceil(t n) + k of both sets. The other set may be smaller by t.
    """
    return 1 + (n * (EXTRA * PERCENT) - n * (EXTRA * PERCENT) % 10000) / 10000


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets in order have that Jaccard similarity, in percent, or more."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class CountTree:
    """An R-tree over count vectors that come in order of size, packed from left to right with fan-out FAN.

    Level 0 has the points; a node above has the largest count of each group below it. Sizes are in order, so a node's
    smallest size is its first point's.
    """

    def __init__(self, groups: int):
        self.n = 0
        self.sizes = np.zeros(FAN, dtype=np.int64)
        #: A mark of each point, such as the component that it is in.
        self.marks = np.zeros(FAN, dtype=np.int64)
        self.levels = [np.zeros((FAN, groups), dtype=np.int32)]

    def append(self, counts: np.ndarray, size: int, mark: int = 0) -> None:
        if self.n == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
        self.sizes[self.n], self.marks[self.n] = size, mark
        node, level = self.n, 0
        while True:
            if level == len(self.levels):  # a root above: it holds what the old root had
                self.levels.append(np.zeros((FAN, counts.size), dtype=np.int32))
                self.levels[level][0] = self.levels[level - 1][:FAN].max(axis=0)
            corners = self.levels[level]
            if node >= len(corners):
                corners = self.levels[level] = np.concatenate([corners, np.zeros_like(corners)])
            np.maximum(corners[node], counts, out=corners[node])
            if self.n < FAN ** (level + 1):
                break
            node, level = node // FAN, level + 1
        self.n += 1

    def query(self, counts: np.ndarray, size: int, percent: int = PERCENT, other_than: int | None = None) -> np.ndarray:
        """Points of no larger size whose overlap with ``counts`` may be enough for the similarity, but for those of
        the mark ``other_than``."""
        low = int(np.searchsorted(self.sizes[: self.n], -(-percent * size // 100)))
        if low >= self.n:
            return np.empty(0, dtype=np.int64)
        level = len(self.levels) - 1
        span = FAN**level
        nodes = np.arange(low // span, (self.n - 1) // span + 1)
        while True:
            if level == 0 and other_than is not None:
                nodes = nodes[self.marks[nodes] != other_than]
            # common >= percent / (100 + percent) * (both sizes)
            least = self.sizes[np.maximum(nodes * span, low)]
            bound = np.minimum(self.levels[level][nodes], counts).sum(axis=1, dtype=np.int64)
            nodes = nodes[(100 + percent) * bound >= percent * (least + size)]
            if level == 0 or not len(nodes):
                return nodes
            level, span = level - 1, span // FAN
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[((nodes + 1) * span > low) & (nodes * span < self.n)]


SIGNED = "doc_id long, row long, n_shingles int, class long, prefix binary, counts binary, head0 long, head1 long"


def row_of(doc_id, text):
    """What tells a row from others of its id: equal for equal rows only."""
    return F.xxhash64(doc_id.cast("long"), text)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, class (null for an empty set), prefix, point and min-hashes of every document."""

    def run(batches):
        known = WordHashes()
        for batch in chunks(batches):
            sets = shingle_sets(byte_list(batch), known)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([prefix(s).tobytes() for s in sets], pa.binary()),
                    pa.array([packed_point(s) for s in sets], pa.binary()),
                    *[pa.array([head(s, order) for s in sets], pa.int64()) for order in ORDERS],
                ],
                ["doc_id", "row", "n_shingles", "class", "prefix", "counts", "head0", "head1"],
            )

    return docs.select(F.col("doc_id").cast("long"), row_of(F.col("doc_id"), F.col("text")).alias("row"), "text").mapInArrow(run, SIGNED)


def head(shingles: np.ndarray, order: int) -> int | None:
    """The min-hash of a set in an order of hashes."""
    if not len(shingles):
        return None
    return int((mixed(shingles ^ np.uint64(order)) if order else shingles).min().view(np.int64))


def set_class(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def size_steps(n: np.ndarray) -> np.ndarray:
    """Logarithms of sizes, rounded down."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(STEP))


def fitting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a <= b, as ``size_steps``, can be alike."""
    return b.astype(np.int64) - a.astype(np.int64) <= math.log(100 / PERCENT) / math.log(STEP) + 2


def sharing(signs: DataFrame) -> DataFrame:
    """(key, owner): hashes of prefixes that classes of fitting sizes share, and those classes."""
    buckets = bucket_count(signs)

    def post(batches):
        packer, seen = Packer(buckets), set()
        for batch in batches:
            new = []
            for k, c in enumerate(batch.column("class").to_pylist()):
                if c not in seen:  # of the copies that a task has, one
                    seen.add(c)
                    new.append(k)
            if len(seen) > CLASSES_KEPT:
                seen.clear()
            if new:
                batch = batch.take(pa.array(new))
                parts = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("prefix").to_pylist()]
                sizes = np.array([len(x) for x in parts])
                owners = np.repeat(batch.column("class").to_numpy(zero_copy_only=False), sizes)
                yield from packer.add(np.concatenate(parts), owners, np.repeat(size_steps(batch.column("n_shingles").to_numpy()), sizes))
        yield from packer.flush()

    rows = signs.where("class is not null").select("class", "n_shingles", "prefix")
    return shared(rows.mapInArrow(post, PACKED_SCHEMA), fitting)


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (a stored table with rep, the row that stands for a class) with the text instead of it."""
    return joined(docs.select(row_of(F.col("doc_id"), F.col("text")).alias("rep"), "text"), wanted, "rep").drop("rep")


def round_of_leaders(docs: DataFrame, classes: DataFrame, order: str, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b): links of followers to their leaders, among classes (class, rep, n, min-hashes) of one min-hash ``order``;
    and (head) the groups that were salted. ``again``: only these groups.

    Only texts of classes that have company are read; groups of more than SALTED classes are split by a salt.
    """
    company = classes.groupBy(F.col(order).alias("head")).agg(F.count("*").alias("size")).where("size > 1")
    company = stored(company if again is None else joined(company, again, "head", "left_semi"), "jaccard-company")
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / SALTED)).cast("int")
    dealt = joined(classes.withColumnRenamed(order, "head"), company, "head").select("class", "rep", "head", salt.alias("salt"), "n")
    dealt = with_texts(docs, stored(dealt, "jaccard-dealt"))

    def follow(batches):
        known, group = WordHashes(), None
        for batch in chunks(batches):
            sets = shingle_sets(byte_list(batch), known)
            followers, leaders = [], []
            for head_, salt_, c, s in zip(*(batch.column(x).to_pylist() for x in ("head", "salt", "class")), sets):
                if (head_, salt_) != group:
                    group, trees, last = (head_, salt_), {}, None
                if c == last or not len(s) or set_class(s) != c:
                    continue  # a row that came twice, or another row of the same hash
                last, counts, octave, found = c, point(s), octave_of(len(s)), False
                for o in (octave, octave + 1):
                    trees.setdefault(o, (CountTree(octave_groups(o)), []))
                tree, led_by = trees[octave]
                for k in tree.query(folded(counts, octave_groups(octave)), len(s)).tolist():
                    if alike(s, led_by[k][1]):
                        followers.append(c)
                        leaders.append(led_by[k][0])
                        found = True
                if not found:
                    for o in (octave, octave + 1):
                        trees[o][0].append(folded(counts, octave_groups(o)), len(s))
                        trees[o][1].append((c, s))
            yield pa.RecordBatch.from_arrays([pa.array(followers, pa.int64()), pa.array(leaders, pa.int64())], ["a", "b"])

    links = dealt.repartition(F.col("head"), F.col("salt")).sortWithinPartitions("head", "salt", "n", "class").mapInArrow(follow, "a long, b long")
    return stored(links, "jaccard-links"), company.where(F.col("size") > SALTED).select("head")


def neighbourhoods(active: DataFrame, asked: DataFrame, roots: DataFrame) -> DataFrame:
    """(hub, owner, n, rep, root): for each hash (``active``: key, owner) that classes of different components share, its
    owners meet at the least of them, the hub; once however many hashes have that hub."""
    placed = joined(active, asked.select(F.col("class").alias("owner"), "n", "rep"), "owner")
    placed = joined(placed, roots.select(F.col("node").alias("owner"), "root"), "owner", "left").withColumn("root", F.coalesce("root", "owner"))
    placed = stored(placed, "jaccard-placed")
    hubs = placed.groupBy("key").agg(F.min("owner").alias("hub"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key", "hub")
    return placed.join(hubs.hint("merge"), "key").select("hub", "owner", "n", "rep", "root").distinct()


def cells(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows (a stored table: hub, owner, n, rep, root) with the cells that they go to: hub, cell, side.

    A hub with ``most`` shingles or fewer is one cell, all of side 0, who meet one another. A larger one is cut by
    octave of size (a factor of 100 / PERCENT) and by hash into parts of half as many. A part is a cell of its own, and
    so are each two parts of one octave or of neighbouring ones; there, side 1 meets side 2.
    """
    most = CELL if most is None else most
    octave = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT)) + 1e-9).cast("int")
    rows = rows.withColumn("o", octave)
    loads = rows.groupBy("hub", "o").agg(F.sum("n").alias("load"))
    # A hub has as many loads as sizes have octaves.
    hubs = loads.groupBy("hub").agg(F.sum("load").alias("whole"), F.map_from_entries(F.collect_list(F.struct("o", F.ceil(F.col("load") / (most / 2)).cast("int").alias("parts")))).alias("parts"))
    large = stored(hubs.where(F.col("whole") > most).select("hub", "parts"), "jaccard-hubs")
    rows = joined(rows, large, "hub", "left")
    parts = lambda o: F.coalesce(F.try_element_at("parts", o), F.lit(0))
    each = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(F.array().cast("array<struct<cell:string,side:int>>"))
    cell = lambda o, i, p, j, side: F.struct(F.concat_ws("/", o, i, p, j).alias("cell"), side.cast("int").alias("side"))
    o, i = F.col("o"), F.col("i")
    rows = rows.withColumn("i", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("owner"), parts(o)).cast("int")))
    same = each(parts(o), lambda j: cell(o, F.least(i, j), o, F.greatest(i, j), F.when(i == j, 0).when(i < j, 1).otherwise(2)))
    above = each(parts(o + 1), lambda j: cell(o, i, o + 1, j, F.lit(1)))
    below = each(parts(o - 1), lambda j: cell(o - 1, j, o, i, F.lit(2)))
    whole = F.array(F.struct(F.lit("").alias("cell"), F.lit(0).alias("side")))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(F.concat(same, above, below))))
    return dealt.select("hub", "at.cell", "at.side", "owner", "n", "rep", "root")


class Probe:
    """The points of a cell that came so far, by side and octave, and which of them are near one of another component."""

    def __init__(self):
        self.trees: dict[tuple[int, int], tuple[CountTree, list[int]]] = {}
        self.rows: list[tuple] = []
        self.near: set[int] = set()

    def add(self, row: tuple, side: int, root: int, counts: np.ndarray, size: int) -> None:
        at, octave = len(self.rows), octave_of(size)
        self.rows.append(row)
        if met := self.trees.get((3 - side if side else 0, octave)):
            tree, members = met
            found = tree.query(folded(counts, octave_groups(octave)), size, other_than=root).tolist()
            if found:
                self.near.add(at)
                self.near.update([members[k] for k in found])
        for o in (octave, octave + 1):
            if (side, o) not in self.trees:
                self.trees[side, o] = CountTree(octave_groups(o)), []
            tree, members = self.trees[side, o]
            tree.append(folded(counts, octave_groups(o)), size, root)
            members.append(at)


DEALT = "hub long, cell string, side int, owner long, n int, rep long, root long"


def near_others(signs: DataFrame, dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` (a stored table) for which a class of another component in their cell passes the bound."""
    names = [f.split(" ")[0] for f in DEALT.split(", ")]

    def rows(cell: Probe) -> pa.RecordBatch:
        columns = list(zip(*(cell.rows[k] for k in sorted(cell.near)))) or [[]] * len(names)
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def meet(batches):
        group, cell = None, Probe()
        for batch in batches:
            for *row, counts in zip(*(batch.column(x).to_pylist() for x in (*names, "counts"))):
                hub, name, side, owner, n, _, root = row
                if (hub, name) != group:
                    yield rows(cell)
                    group, cell, last = (hub, name), Probe(), None
                if owner != last:
                    last = owner
                    cell.add(row, side, root, unpacked_point(counts, n), n)
        yield rows(cell)

    points = signs.select(F.col("row").alias("rep"), F.col("class").alias("owner"), "counts")
    placed = joined(points, dealt, ["rep", "owner"]).select(*names, "counts")
    return placed.repartition(F.col("hub"), F.col("cell")).sortWithinPartitions("hub", "cell", "n", "owner").mapInArrow(meet, DEALT)


class Cell:
    """The classes of a cell that came so far, by side and octave, and which components they have turned out to be."""

    def __init__(self):
        self.trees: dict[tuple[int, int], tuple[CountTree, list]] = {}
        self.now: dict[int, int] = {}

    def add(self, owner: int, side: int, root: int, s: np.ndarray) -> list[int]:
        """Takes a class in; returns classes that it is linked with, one for each component that was another before."""
        counts, octave, out = point(s), octave_of(len(s)), []
        mark = self.now.setdefault(root, root)
        met = self.trees.get((3 - side if side else 0, octave))
        if met:
            tree, members = met
            for k in tree.query(folded(counts, octave_groups(octave)), len(s), other_than=mark).tolist():
                if (other := int(tree.marks[k])) != mark and alike(s, members[k][1]):
                    out.append(members[k][0])
                    for r, m in self.now.items():
                        if m == other:
                            self.now[r] = mark
                    for t, _ in self.trees.values():
                        t.marks[: t.n][t.marks[: t.n] == other] = mark
        for o in (octave, octave + 1):
            if (side, o) not in self.trees:
                self.trees[side, o] = CountTree(octave_groups(o)), []
            tree, members = self.trees[side, o]
            tree.append(folded(counts, octave_groups(o)), len(s), mark)
            members.append((owner, s))
        return out


def cell_links(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """(a, b): links that connect components, found in each cell of ``dealt`` (a stored table) from the sets themselves."""

    def meet(batches):
        known, group = WordHashes(), None
        for batch in chunks(batches):
            sets = shingle_sets(byte_list(batch), known)
            a, b = [], []
            for hub, name, side, owner, root, s in zip(*(batch.column(x).to_pylist() for x in ("hub", "cell", "side", "owner", "root")), sets):
                if (hub, name) != group:
                    group, cell, last = (hub, name), Cell(), None
                if owner == last or not len(s) or set_class(s) != owner:
                    continue  # a row that came twice, or another row of the same hash
                last = owner
                for other in cell.add(owner, side, root, s):
                    a.append(owner)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = with_texts(docs, dealt).select("hub", "cell", "n", "owner", "side", "root", "text")
    return rows.repartition(F.col("hub"), F.col("cell")).sortWithinPartitions("hub", "cell", "n", "owner").mapInArrow(meet, "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to), group_id (a name of the component that no
    other has even if ids are repeated; null for an empty set) and row (``row_of``) of every row of ``docs``."""
    bounded(docs.sparkSession)
    signs = stored(signed(docs), "jaccard-signs")
    heads = [f"head{k}" for k in range(len(ORDERS))]
    classes = signs.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("row").alias("rep"), F.min("n_shingles").alias("n"), *[F.min(h).alias(h) for h in heads])
    classes = stored(classes, "jaccard-classes")
    active = stored(sharing(signs), "jaccard-active")
    met = stored(active.groupBy(F.col("owner").alias("class")).agg(F.count("*").alias("met")), "jaccard-met")
    asked = stored(joined(classes.drop("least"), met, "class").where(F.col("met") >= least_shared(F.col("n").cast("long")).cast("long")).drop("met"), "jaccard-asked")
    edges, left = None, asked
    for order in heads:
        again = None
        for _ in range(ROUNDS):
            links, again = round_of_leaders(docs, left.drop(*[h for h in heads if h != order]), order, again)
            edges = links if edges is None else edges.unionByName(links)
            followers = stored(links.select(F.col("a").alias("class")).distinct(), "jaccard-followers")
            left = stored(joined(left, followers, "class", "left_anti"), "jaccard-left")
            if again.isEmpty() or links.isEmpty():
                break
    roots = stored(components(edges), "jaccard-roots")
    dealt = stored(cells(stored(neighbourhoods(active, asked, roots), "jaccard-rows")), "jaccard-cells")
    close = stored(near_others(signs, dealt), "jaccard-close")
    more = stored(cell_links(docs, close), "jaccard-links")
    # Components found so far count as links of their nodes to their roots.
    roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "jaccard-roots")
    named = joined(classes.select("class", "least"), roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Only components of two classes or more have to be named; others have the name of their one class.
    name = stored(joined(named, roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("name")), "jaccard-names")
    of_class = stored(joined(named, name, "root", "left").select("class", F.coalesce("name", "least").alias("component_id"), "root"), "jaccard-components")
    out = joined(signs.select("doc_id", "row", "n_shingles", "class"), of_class, "class", "left")
    name = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), name.alias("component_id"), F.col("root").alias("group_id"), "row")


def one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null after all others), of several such rows
    one; rows with an empty set are all kept."""
    links = stored(linked(docs.select("doc_id", "text")).where("group_id is not null").select("doc_id", "row", "group_id"), "jaccard-linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = stored(links.groupBy("group_id").agg(F.count("*").alias("size"), first).where("size > 1").select("group_id", F.col("first.row").alias("first")), "jaccard-groups")
    # Rows that go, and rows of which one stays: few against the rest, which are passed by without a shuffle.
    rows = joined(links, groups, "group_id").groupBy("row").agg(F.count("*").alias("n"), F.min((F.col("row") == F.col("first")).cast("int")).alias("stays"))
    marks = stored(rows.where("n > 1 or stays = 0").select(F.col("row").alias("_row"), "stays"), "jaccard-marks")
    own = docs.columns
    marked = joined(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_all"), row_of(F.col("doc_id"), F.col("text")).alias("_row")), marks, "_row", "left")
    single = marked.where("stays = 1").groupBy("_row").agg(F.first("_all").alias("_all")).select("_all")
    return marked.where("stays is null").select("_all").unionByName(single).select("_all.*")
