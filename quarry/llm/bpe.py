"""Byte pair encoding and decoding; merges are found by a segment tree over the ranks of adjacent pairs.

The vocabulary file is a parameter and is read on the driver; workers get it as a broadcast of fixed size. Text is cut
at blanks and line ends, which no token crosses; each distinct piece is encoded once and remembered. A worker's memory
is bounded: beyond it, what the batch at hand does not use is forgotten. Ids are decoded for a whole batch at once.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty string; texts of any
length are encoded whole; repeated rows give repeated results; an empty table gives an empty result; columns of the
input that are called like a new column are replaced.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from quarry.llm.arrow import bounded, chunks, text_list

NO_RANK = 1 << 30
NO_PAIR = NO_RANK << 32
#: Pieces, and words, that a worker remembers before it forgets those out of use, their characters, and tree leaves that it builds at once.
MEMORY, MEMORY_CHARS, FOREST_CELLS = 90_000, 6_000_000, 150_000
#: Symbols of a word beyond which it has a tree for itself.
LONG = 256


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return out


class Forest:
    """Segment trees over the ranks of adjacent pairs, one row for each word, advanced together.

    A leaf stands for the pair that starts at a symbol and holds (rank, position), or NO_PAIR; an inner node holds the
    lower of its two children, so the root is the leftmost pair of lowest rank. A merge changes the leaves of three
    pairs and the nodes above them: logarithmic in the length of the word.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, size: int, bpe: Bpe):
        """``symbols``: the ids of all words' symbols, laid end to end; ``size``: a power of two, no word is longer."""
        n = len(lengths)
        self.bpe, self.size = bpe, size
        at = np.arange(size)
        inside = at < lengths[:, None]
        self.ids = np.full((n, size + 1), -1, dtype=np.int64)
        self.ids[:, :size][inside] = symbols
        self.after = np.where(at + 1 < lengths[:, None], at + 1, size)  # size: past the end
        self.before = np.tile(np.arange(-1, size), (n, 1))
        self.tree = np.full((n, 2 * size), NO_PAIR, dtype=np.int64)
        ranks = bpe.rank_of(self.ids[:, :size], np.where(at + 1 < lengths[:, None], self.ids[:, 1:], -1))
        self.tree[:, size:] = np.where(ranks < NO_RANK, ranks << 32 | at, NO_PAIR)
        level = size
        while level > 1:
            level //= 2
            self.tree[:, level : 2 * level] = self.tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(axis=2)

    def put(self, row: np.ndarray, leaf: np.ndarray, rank: np.ndarray | None) -> None:
        """Set leaves and renew the nodes above them."""
        tree, k = self.tree, self.size + leaf
        tree[row, k] = NO_PAIR if rank is None else np.where(rank < NO_RANK, rank << 32 | leaf, NO_PAIR)
        for _ in range(self.size.bit_length() - 1):
            k = k >> 1
            tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, laid end to end, once no pair is left to merge; and where each word ends."""
        ids, after, before, size = self.ids, self.after, self.before, self.size
        while len(row := np.flatnonzero(self.tree[:, 1] < NO_PAIR)):
            top = self.tree[row, 1]
            i = top & 0xFFFFFFFF
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = self.bpe.made[top >> 32]
            ids[row, j] = -1
            after[row, i] = k
            inner = k < size
            before[row[inner], k[inner]] = i[inner]
            self.put(row, j, None)
            self.put(row, i, self.bpe.rank_of(ids[row, i], np.where(inner, ids[row, k], -1)))
            h = before[row, i]
            left = h >= 0
            row, h, i = row[left], h[left], i[left]
            self.put(row, h, self.bpe.rank_of(ids[row, h], ids[row, i]))
        kept = ids >= 0
        return ids[kept].astype(np.int32), np.cumsum(kept.sum(axis=1))


class LongWord:
    """The same segment tree over one long word, which takes all pairs of the lowest rank at once.

    A merge makes a symbol that no earlier rank can have in a pair, so the pairs of one rank are what the root would
    yield one after the other; of pairs that overlap, every second one from the left.
    """

    def __init__(self, symbols: np.ndarray, bpe: Bpe):
        n = len(symbols)
        self.bpe, self.size = bpe, 1 << max(1, (n - 1).bit_length())
        self.ids = np.append(symbols.astype(np.int64), -1)  # the last: past the end
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n)
        self.tree = np.full(2 * self.size, NO_PAIR, dtype=np.int64)
        self.put(np.arange(n), bpe.rank_of(self.ids[:n], self.ids[1:]))

    def put(self, leaf: np.ndarray, rank: np.ndarray | None) -> None:
        """Set leaves and renew the nodes above them."""
        k = self.size + leaf
        self.tree[k] = NO_PAIR if rank is None else np.where(rank < NO_RANK, rank << 32 | leaf, NO_PAIR)
        while len(k) and k[0] > 1:
            k = k >> 1
            k = k[np.append(True, k[1:] != k[:-1])]
            self.tree[k] = np.minimum(self.tree[2 * k], self.tree[2 * k + 1])

    def lowest(self) -> np.ndarray:
        """The leaves of the root's rank, from left to right, without those that overlap one that is taken."""
        rank, nodes = self.tree[1] >> 32, np.array([1])
        while nodes[0] < self.size:
            nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
            nodes = nodes[self.tree[nodes] >> 32 == rank]
        at = nodes - self.size
        fresh = np.append(True, self.after[at[:-1]] != at[1:])
        place = np.arange(len(at))
        return at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]

    def merged(self) -> np.ndarray:
        """The ids once no pair is left to merge."""
        n = len(self.after)
        while (top := int(self.tree[1])) < NO_PAIR:
            i = self.lowest()
            j = self.after[i]
            k = self.after[j]
            self.ids[i], self.ids[j] = self.bpe.made[top >> 32], -1
            self.after[i] = k
            inner = k < n
            self.before[k[inner]] = i[inner]
            self.put(j, None)
            self.put(i, self.bpe.rank_of(self.ids[i], self.ids[self.after[i]]))
            h = self.before[i]
            h = h[h >= 0]
            self.put(h, self.bpe.rank_of(self.ids[h], self.ids[self.after[h]]))
        return self.ids[self.ids >= 0].astype(np.int32)


class Bpe:
    """A byte-level vocabulary with ends of words, from the JSON text of its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.spec, self.library = text, None
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        tokens = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.tokens = pa.array(tokens, pa.string())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], dtype=np.int64)
        #: Pairs in order of their key, with the rank of each; and the id that the merge of each rank makes.
        self.keys, first = np.unique(keys, return_index=True)
        self.rank = first.astype(np.int64)
        self.made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        #: The id of each byte, inside a word and at its end.
        self.inner = np.array([self.ids[c] for _, c in sorted(byte_symbols().items())], dtype=np.int64)
        self.final = np.array([self.ids[c + self.suffix] for _, c in sorted(byte_symbols().items())], dtype=np.int64)
        self.piece_ids: dict[str, bytes] = {}
        self.words: dict = {}
        self.forget_pieces(())
        self.forget_words(())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NO_RANK where a pair can't be merged or has no right side."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], NO_RANK)

    def forget_pieces(self, used) -> None:
        """Keep the ids (32 bits each) of those texts between blanks only that are used."""
        known = self.piece_ids
        self.piece_ids = {p: known[p] for p in used if p in known}
        self.piece_ids[""] = b""
        self.chars = sum(map(len, self.piece_ids))

    def forget_words(self, used) -> None:
        """Keep the ids of those words only that are used, and of special tokens."""
        known = self.words
        self.words = {w: known[w] for w in used if w in known and w.__class__ is str}
        self.word_chars = sum(map(len, self.words))
        self.words |= {i: np.int32(i).tobytes() for i in self.special.values()}

    def merge(self, words: list[str]) -> None:
        """Encode pre-tokens and remember them; words of like length share a forest."""
        coded = [w.encode() for w in words]
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(coded):
            sizes.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for size, group in sizes.items():
            if size > LONG:
                for k in group:
                    text = np.frombuffer(coded[k], dtype=np.uint8)
                    ids = LongWord(np.append(self.inner[text[:-1]], self.final[text[-1]]), self).merged()
                    self.words[words[k]] = ids.tobytes()
                continue
            step = max(1, FOREST_CELLS // size)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                lengths = np.array([len(coded[k]) for k in part], dtype=np.int64)
                text = np.frombuffer(b"".join([coded[k] for k in part]), dtype=np.uint8)
                symbols, last = self.inner[text], np.cumsum(lengths) - 1
                symbols[last] = self.final[text[last]]
                ids, ends = Forest(symbols, lengths, size, self).merged()
                data, x = ids.tobytes(), 0
                for k, y in zip(part, (4 * ends).tolist()):
                    self.words[words[k]] = data[x:y]
                    x = y

    def normal(self, text: str) -> str:
        """Composed and lower-cased, letter by letter."""
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def all_pretokens(self, pieces: list[str]) -> list[list]:
        """``pretokens`` of each piece. Those of known printable characters and without special tokens are made normal
        together, with line ends between them, which nothing composes with."""
        plain = [p for p in pieces if p.isascii() or p.isprintable()]
        if self.split_special and self.split_special.search("\n".join(plain)):
            plain = [p for p in plain if not self.split_special.search(p)]
        texts = self.normal("\n".join(plain)).split("\n") if plain else []
        findall = self.pattern.findall
        out = dict(zip(plain, [[t] if t.isalpha() else findall(t) for t in texts]))
        return [out[p] if p in out else self.pretokens(p) for p in pieces]

    def pretokens(self, piece: str) -> list:
        """The pre-tokens of a text between blanks; a special token is its id."""
        if not self.split_special or not self.split_special.search(piece):
            return self.split_words(piece)
        out: list = []
        for k, part in enumerate(self.split_special.split(piece)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self.split_words(part)
        return out

    def split_words(self, part: str) -> list[str]:
        """Normal text cut by the vocabulary's pattern. Characters that this Python's Unicode does not know yet are left
        to the tokenizers library's own normaliser and pattern, as its tables decide what they are."""
        if not part.isascii() and not part.isprintable() and any(unicodedata.category(c) == "Cn" for c in part):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.spec)
            text = self.library.normalizer.normalize_str(part)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = self.normal(part)
        return [text] if text.isalpha() else self.pattern.findall(text)

    def learn(self, pieces: list[str]) -> None:
        """Encode texts between blanks and remember them."""
        parts = self.all_pretokens(pieces)
        used = set().union(*parts)
        if len(self.words) > MEMORY or self.word_chars > MEMORY_CHARS:
            self.forget_words(used)
        new = [x for x in used if x not in self.words]
        self.merge(new)
        self.word_chars += sum(map(len, new))
        words = self.words
        self.piece_ids.update(zip(pieces, [words[row[0]] if len(row) == 1 else b"".join([words[x] for x in row]) for row in parts]))
        self.chars += sum(map(len, pieces))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        used = set().union(*split)
        if len(self.piece_ids) > MEMORY or self.chars > MEMORY_CHARS:
            self.forget_pieces(used)
        if new := [p for p in used if p not in self.piece_ids]:
            self.learn(new)
        ids = self.piece_ids.__getitem__
        return [b"".join(map(ids, row)) for row in split]

    def columns(self, texts: list[str]) -> tuple[pa.ListArray, pa.Array]:
        """Ids of each text, and the text that they decode to."""
        found = self.ids_of(texts)
        data = b"".join(found)
        ends = pa.array(np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32))
        ids = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
        decoded = pa.compute.binary_join(pa.ListArray.from_arrays(ends, self.tokens.take(ids)), " ")
        return pa.ListArray.from_arrays(ends, ids), decoded

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text as 32-bit integers, and the text that they decode to."""
        ids, decoded = self.columns(texts)
        data, ends = ids.values.to_numpy(), ids.offsets.to_pylist()
        return [(data[a:b].tobytes(), t) for a, b, t in zip(ends, ends[1:], decoded.to_pylist())]

    def decode(self, ids) -> str:
        """The tokens joined by a space: the vocabulary has no decoder of its own."""
        return " ".join([self.token[i] for i in ids])


_loaded: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One vocabulary a worker process."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(shared.value)
    return _loaded[key]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (array<int>) and decoded (the text that the ids decode to) of each whole text.

    ``path``: a vocabulary file on the driver. The text column itself is not returned.
    """
    bounded(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [c for c in docs.columns if c not in (text, "token_ids", "decoded")]

    def run(batches):
        bpe = _bpe(shared)
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *bpe.columns(text_list(batch, text))], [*own, "token_ids", "decoded"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own], "token_ids array<int>", "decoded string"])
    return docs.select(*[f"`{c}`" for c in own], f"`{text}`").mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of an array of ids; a null array decodes to an empty text."""
    bounded(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [c for c in docs.columns if c != out]

    def run(batches):
        bpe = _bpe(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.select(own).columns, pa.array([bpe.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.string())], [*own, out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own], f"`{out}` string"])
    return docs.select(*[f"`{c}`" for c in own]).mapInArrow(run, schema)
