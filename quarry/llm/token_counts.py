"""Token counts by a unigram model: one dynamic program over a trie of the distinct pre-tokens.

Pre-tokens are the words between white space, each with the word mark in front. The distinct ones of a batch go into
a radix trie: in order, each with how much it shares with the one before and the one after, so that an edge is the rest
of a pre-token and a walk along the order is the trie depth first. The forward score of a trie node, the best sum of
piece scores over all ways to cut the prefix that it spells, depends on its ancestors only, so it is computed once
however many pre-tokens share the prefix. A terminal node keeps the number of pieces of its best cut; a document's count
is the sum over its pre-tokens. Scores are kept only where a later pre-token branches off, so a single word of many
megabytes takes no more memory than itself.

Ties go to fewer pieces. Characters that no piece covers cost one token for each UTF-8 byte.

Defined results: a null or empty text has no tokens; texts of any length are counted whole; repeated rows give
repeated results; an empty table gives an empty result; columns of the input called like a new one are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.arrow import bounded, chunks, text_list

MARK = "▁"
#: Cost of one byte of an uncovered character, in millionths of a nat: dearer than any piece.
BYTE_COST = 30_000_000
#: Counts that a worker remembers, and characters of their pre-tokens; beyond it starts anew. Longer ones are not kept.
MEMORY, LONGEST_KEPT = 400_000, 100


def costs(pieces: list[str]) -> dict[str, int]:
    """Piece costs from their order: -ln p in millionths of a nat with p ~ 1 / (rank + 2)."""
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    out: dict[str, int] = {}
    for r, piece in enumerate(pieces):
        out.setdefault(piece, round(1_000_000 * (math.log(r + 2) + total)))
    return out


def shared_prefix(a: str, b: str) -> int:
    """How many characters two texts have in common from their starts."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 8
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """Forward scores over the radix trie of distinct pre-tokens.

    A forward score is one integer, cost times 2**32 plus pieces, so that the lesser cost wins and then fewer pieces.
    """

    def __init__(self, cost: dict[str, int]):
        self.cost = {piece: (c << 32) + 1 for piece, c in cost.items()}
        self.longest = max(map(len, cost), default=1)

    def count(self, pretokens) -> dict[str, int]:
        """Pieces of the best cut of each pre-token; forward scores are shared along common prefixes."""
        order = sorted(pretokens)
        edges = [0, *[shared_prefix(a, b) for a, b in zip(order, order[1:])], 0]
        out: dict[str, int] = {}
        get, longest, unknown = self.cost.get, self.longest, (BYTE_COST << 32) + 1
        # best[i] is the score of the prefix of length i, as far as the next pre-token shares it.
        best = [0]
        for word, depth, keep in zip(order, edges, edges[1:]):
            del best[depth + 1 :]
            near = best[-longest:]  # the scores of the prefixes before the place at hand, up to ``longest`` of them
            for end in range(depth + 1, len(word) + 1):
                last = word[end - 1]
                low = near[-1] + (unknown if last < "\x80" else unknown * len(last.encode()))
                start = end - len(near)
                for score in near:
                    if (x := get(word[start:end])) is not None and score + x < low:
                        low = score + x
                    start += 1
                near.append(low)
                if len(near) > longest:
                    del near[0]
                if end <= keep:
                    best.append(low)
            out[word] = near[-1] & 0xFFFFFFFF
        return out


#: What a worker process remembers from task to task, by vocabulary.
_known: dict[int, dict[str, int]] = {}


def piece_list(path: str) -> list[str]:
    """The pieces of a sentencepiece model file, in order, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def count_tokens(docs: DataFrame, pieces: list[str] | dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_pretokens and n_tokens of each whole text.

    ``pieces``: a unigram vocabulary, as ln p by piece, or as a list in order of frequency, whose costs are then those of
    ``costs``; workers get it as a broadcast of fixed size.
    """
    bounded(docs.sparkSession)
    given = {p: round(-1_000_000 * x) for p, x in pieces.items()} if isinstance(pieces, dict) else costs(pieces)
    name = hash(tuple(given.items()))
    shared = docs.sparkSession.sparkContext.broadcast(given)
    own = [c for c in docs.columns if c not in (text, "n_pretokens", "n_tokens")]

    def run(batches):
        trie = Trie(shared.value)
        known = _known.setdefault(name, {})
        for batch in chunks(batches, text):
            split = [t.split() for t in text_list(batch, text)]
            if len(known) > MEMORY:
                known.clear()
            new = {MARK + w for ws in split for w in set(ws) if w not in known}
            found = trie.count(new)
            known.update((w[1:], n) for w, n in found.items())
            n_tokens = [sum(map(known.__getitem__, ws)) for ws in split]
            for w in found:
                if len(w) > LONGEST_KEPT:
                    del known[w[1:]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(list(map(len, split)), pa.int64()), pa.array(n_tokens, pa.int64())], [*own, "n_pretokens", "n_tokens"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own], "n_pretokens long", "n_tokens long"])
    return docs.select(*[f"`{c}`" for c in own], f"`{text}`").mapInArrow(run, schema)
