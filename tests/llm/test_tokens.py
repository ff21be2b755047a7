"""Token counts and BPE against plain versions and the tokenizers library."""

import hashlib
import os
import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
HARD = [
    "Hello<|endoftext|>World <|startoftext|> it's we'LL'S", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ é ẛ̣", "a\x85b\xa0c d\x1cE f", "日本語123 ١٢ ½", "", "  \n\n", "'s't 're''", "\U0001f600‍\U0001f469",
    "x" * 3000, "<|endoftext|><|endoftext|>", " ̈a", "\x00\x01", "ab" * 700 + "é" * 300, "<|endoftext", "don't DON'T", "á́b",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def texts():
    draw = random.Random(3)
    pool = "abcdefghijkl éàüßñ çΣσς123.,;|#'\n\t-_<>|ÅÖ日本́😀"
    return HARD + ["".join(draw.choice(pool) for _ in range(draw.choice([3, 30, 300]))) for _ in range(150)]


def test_bpe_equals_library(library):
    own = bpe.Bpe(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    for text, (ids, decoded) in zip(texts(), own.encode(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=np.int32).tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want), text


def test_long_words_equal_library_in_time(library):
    own = bpe.Bpe(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (257, 300, 1000, 5000)]
    words += ["a" * n for n in (258, 259, 4001)] + ["ab" * 600 + "a", "the" * 3000, "é日" * 500, "abc" * 171 + "aab" * 90]
    for word, (ids, _) in zip(words, own.encode(words)):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode(word, add_special_tokens=False).ids, word[:20]
    long = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    ids, _ = own.encode([long])[0]
    assert time.time() - began < 60
    assert "".join(own.token[i] for i in np.frombuffer(ids, dtype=np.int32).tolist()).replace("</w>", "") == long


def test_long_word_is_counted_in_little_memory():
    pieces = token_counts.piece_list(queries.tokenizer_path("piece_bpe_32k.model"))
    draw = random.Random(6)
    word = token_counts.MARK + "".join(draw.choice("abcdefghijklmnop日本語") for _ in range(400_000))
    trie = token_counts.Trie(token_counts.costs(pieces))
    tracemalloc.start()
    n = trie.count({word, word[:100_000], word[:100_000] + "x"})[word]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < n < len(word) * 3 and peak < 20_000_000


def test_shared_prefix():
    draw = random.Random(7)
    for _ in range(500):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randrange(9))) for _ in range(2))
        p = "c" * draw.randrange(60)
        assert token_counts.shared_prefix(p + a, p + b) == len(os.path.commonprefix([p + a, p + b]))


OWN = []


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_bpe_on_any_text(library, text):
    if not OWN:
        OWN.append(bpe.Bpe(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()))
    text = text.encode("utf-8", "ignore").decode()  # no lone surrogates
    ids, decoded = OWN[0].encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, dtype=np.int32).tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False)


def test_pieces_in_use_are_learned_once(library, monkeypatch):
    own = bpe.Bpe(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    monkeypatch.setattr(bpe, "MEMORY", 60)
    learned, learn = [], own.learn
    monkeypatch.setattr(own, "learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    common = "the <|endoftext|> river, Ärger ΑΣ it's " + "z" * 300
    for k in range(30):
        batch = [f"{common} new{k}x{j}" for j in range(20)]
        for text, (ids, _) in zip(batch, own.encode(batch)):
            assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.piece_ids) < 60 + 60 and len(own.words) < 60 + 80
    assert len(learned) == len(set(learned)) == len(common.split()) + 30 * 20


SMALL = []


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab'sΣé\u0301\u0085\xa0日1<|"), st.characters()), max_size=30), max_size=6))
def test_bpe_of_many_texts_in_little_memory(library, monkeypatch, some):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    if not SMALL:
        SMALL.append(bpe.Bpe(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()))
    some = [t.encode("utf-8", "ignore").decode() for t in some] + ["again and<|endoftext|> again"]
    for text, (ids, decoded) in zip(some, SMALL[0].encode(some)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=np.int32).tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_query_digests(spark, documents, library, tmp_path):
    rows = [*enumerate(texts()), (900, None), (901, "again"), (901, "again"), (None, "no id")]
    documents(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_round_trip_and_odd_rows(spark, odd):
    path = queries.tokenizer_path("word_bpe_49k.json")
    coded = bpe.encode(odd, path)
    assert coded.count() == odd.count() and set(odd.columns) - {"text"} <= set(coded.columns)
    again = bpe.decode(coded.withColumnRenamed("decoded", "before"), path).collect()
    assert all(r["before"] == r["decoded"] for r in again)
    assert bpe.encode(odd.where("false"), path).count() == 0


def brute_count(word, cost):
    """Best (cost, pieces) over all cuts, one pre-token by itself."""
    best = [(0, 0)]
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + token_counts.BYTE_COST * n, best[j - 1][1] + n)]
        options += [(best[i][0] + cost[word[i:j]], best[i][1] + 1) for i in range(j) if word[i:j] in cost]
        best.append(min(options))
    return best[-1][1]


def test_token_counts_against_brute_force(spark, documents):
    pieces = token_counts.piece_list(queries.tokenizer_path("piece_bpe_32k.model"))
    cost = token_counts.costs(pieces)
    rows = [*enumerate(texts()), (900, None)]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(documents(rows).select("doc_id", "text"), pieces).collect()}
    for i, t in rows:
        words = (t or "").split()
        assert got[i] == (len(words), sum(brute_count(token_counts.MARK + w, cost) for w in words)), t


def test_token_counts_with_given_scores(spark, documents):
    docs = documents([(1, "aab ab"), (2, "")]).select("doc_id", "text")
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -1.5, "aab": -9.0}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, scores).collect()}
    assert got == {1: 2 + 2, 2: 0}  # _a ab; _a b at 3.5 before _ ab at 4


def test_token_counts_odd_rows(spark, odd):
    pieces = ["▁", "a", "lo", "ng", "l", "o", "n", "g"]
    out = token_counts.count_tokens(odd, pieces)
    assert out.count() == odd.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[5]["n_pretokens"] == 60000 and got[5]["n_tokens"] == 60000 * 3 and got[1]["n_tokens"] == 0
    assert token_counts.count_tokens(odd.where("false"), pieces).count() == 0
