"""Decontamination, substring dedup and Jaccard join against brute force on small corpora."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import decontam, jaccard, queries, substring

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=120, vocabulary=400):
    """Documents with exact and near copies, shared passages, and odd rows."""
    draw = random.Random(seed)
    words = [f"{draw.choice('abcdé')}{k}" for k in range(vocabulary)]
    text = lambda m: " ".join(draw.choice(words) for _ in range(m))
    passage, base = text(40), [text(draw.choice([0, 1, 3, 5, 12, 13, 14, 40, 200])) for _ in range(n)]
    rows = []
    for t in base:
        w = t.split()
        kind = draw.randrange(6)
        if kind == 0 and w:
            w[draw.randrange(len(w))] = "changed"
        elif kind == 1:
            cut = draw.randint(0, len(w))
            w[cut:cut] = passage.split()
        elif kind == 2:
            w = w + w[: len(w) // 3]
        rows += [t, draw.choice([" ", "\n", "  \t"]).join(w)]
    draw.shuffle(rows)
    return [*enumerate(rows), (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, passage), (len(rows) + 3, "one"), (len(rows) + 4, "ONE")]


def brute_decontaminate(docs, bench, width=10):
    windows = {}
    for i, t in bench:
        w = WORD.findall((t or "").translate(FOLD))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(i) if i is not None else "")
    out = {}
    for i, t in docs:
        w, hit, items = WORD.findall((t or "").translate(FOLD)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def write(spark, tmp_path, documents, rows, bench=None):
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if bench is not None:
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decontamination_against_brute_force(spark, documents, tmp_path):
    rows = corpus(1)
    source = [t for _, t in rows if t and len(t.split()) > 30]
    bench = [(k, " ".join(source[k].upper().split()[3:25])) for k in range(8)] + [(90, "Changed, a1"), (91, None), (92, "--"), (93, source[0]), (93, source[1]), (10, "c2")]
    got = queries.op3_decontamination(spark, write(spark, tmp_path, documents, rows, bench)).collect()
    want = brute_decontaminate(rows, bench)
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == want and sum(v[4] for v in want.values()) > 10


def test_decontamination_in_blocks_and_shards(spark, documents, monkeypatch):
    rows, bench = corpus(2, 60), [(k, f"a{k} b{k + 1}") for k in range(60)]
    frame = spark.createDataFrame(bench, "item_id long, text string")
    whole = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.decontaminate(documents(rows), frame).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 50)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 40)
    parts = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.decontaminate(documents(rows), frame).collect()}
    assert parts == whole


def test_one_block_at_a_time_is_kept():
    class Shared:
        """Stands for a broadcast: reads its value when asked and keeps it."""

        def __init__(self, block):
            self.block = block

        @property
        def value(self):
            if not hasattr(self, "_value"):
                self._value = list(self.block)
            return self._value

    blocks = [Shared([(str(k), (b"a", b"b%d" % k))]) for k in range(3)]
    for k, _ in enumerate(decontam.each_block(blocks, 2, {})):
        assert [hasattr(b, "_value") for b in blocks] == [j == k for j in range(3)]
    kept = {}
    assert next(decontam.each_block(blocks[:1], 2, kept)) is next(decontam.each_block(blocks[:1], 2, kept))


def test_fm_index():
    draw = np.random.default_rng(3)
    for top, n in ((1, 50), (3, 400), (40, 900)):
        text = draw.integers(0, top + 1, n)
        index = decontam.FmIndex(text, top)
        phrases = draw.integers(1, top + 1, (50, 4))
        lengths = draw.integers(1, 5, 50)
        low, high = index.ranges(phrases, lengths)
        for p, m, a, b in zip(phrases, lengths, low, high):
            want = [k for k in range(n - m + 1) if (text[k : k + m] == p[4 - m :]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_clean_text(spark, documents):
    docs = documents([(1, "Keep this. A bad, Phrase here! Tail"), (2, "nothing")])
    out = {r["doc_id"]: r["clean_text"] for r in decontam.decontaminate(docs, spark.createDataFrame([(1, "bad phrase HERE")], "item_id long, text string"), clean=True).collect()}
    assert out == {1: "Keep this. A ! Tail", 2: None}


def brute_substrings(docs, window=13):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,vocabulary", [(4, 400), (5, 3)])
def test_substrings_against_brute_force(spark, documents, tmp_path, seed, vocabulary):
    rows = corpus(seed, 80, vocabulary)
    rows += [(7, "w " * 30), (7, "w " * 40), (None, rows[3][1]), (500, (rows[0][1] or "") + " tail")]
    got = sorted((tuple(r) for r in queries.op4_substring_dedup(spark, write(spark, tmp_path, documents, rows)).collect()), key=str)
    want = brute_substrings(rows)
    assert got == want and sum(r[2] for r in want) > 100


def run_sql(sql, path, tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return sorted((tuple(r) for r in con.execute(sql).fetchall()), key=str)


def test_substrings_of_rows_with_one_id(spark, documents, tmp_path):
    w = [f"w{k}" for k in range(40)]
    z = [f"z{k}" for k in range(40)]
    rows = [(1, " ".join(w[:13])), (5, " ".join(w[:13] + ["tail"])), (5, " ".join(z[:20])), (5, " ".join(z[:20])), (5, " ".join(["head", *w[:13], *z[5:30]])), (9, " ".join(z[3:30])), (9, " ".join(w[5:30]))]
    path = write(spark, tmp_path, documents, rows)
    got = sorted((tuple(r) for r in queries.op4_substring_dedup(spark, path).collect()), key=str)
    assert got == brute_substrings(rows) == run_sql(queries.ORACLE_SQL["op4_substring_dedup"], path, ["documents"])
    assert [r[2] for r in got if r[0] == 5].count(0) == 2


def test_substrings_when_a_task_forgets(spark, documents, tmp_path, monkeypatch):
    """A passage in most documents, in any order of ids, whether or not tasks remember what they handed on."""
    draw = random.Random(17)
    passage = [f"p{k}" for k in range(50)]
    rows = []
    for k in draw.sample(range(1000), 80):
        w = [f"x{draw.randrange(10**6)}" for _ in range(draw.randint(0, 30))]
        w[len(w) // 2 : len(w) // 2] = passage[draw.randrange(5) : 50 - draw.randrange(5)]
        rows.append((k, " ".join(w)))
    path = write(spark, tmp_path, documents, rows)
    found = lambda: sorted((tuple(r) for r in queries.op4_substring_dedup(spark, path).collect()), key=str)
    assert found() == brute_substrings(rows)
    monkeypatch.setattr(substring, "STRETCHES_KEPT", 0)
    assert found() == brute_substrings(rows)


def test_factors_are_the_longest_of_the_block():
    draw = random.Random(16)
    block, seen = substring.Block(3), []
    for _ in range(200):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(3, 9))]
        runs = {tuple(s[i:j]) for s in seen for i in range(len(s)) for j in range(i + 3, len(s) + 1)}
        i, want = 0, []
        while i + 3 <= len(words):
            if tuple(words[i : i + 3]) not in runs:
                i += 1
                continue
            end = max(j for j in range(i + 3, len(words) + 1) if tuple(words[i:j]) in runs)
            want.append((i, end))
            i = end - 2
        assert block.factors(b" ".join(words)) == want
        block.admit()
        seen.append(words)


def test_substring_text_keeps_its_space(spark, documents):
    copy = " ".join(f"w{k}" for k in range(13))
    out = {r["doc_id"]: r["kept_text"] for r in substring.dedup(documents([(1, copy), (2, f"Head\nline  {copy}\n tail  x")]), keep_space=True).collect()}
    assert out == {1: copy, 2: "Head\nline\n tail  x"}


def brute_components(docs):
    sets, parent = [], list(range(len(docs)))
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in docs:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


def near_copies(seed):
    draw = random.Random(seed)
    out = []
    for g in range(12):
        base = [f"g{g}w{draw.randrange(200)}" for _ in range(draw.choice([4, 6, 12, 60, 150]))]
        for _ in range(draw.randint(1, 12)):
            w = list(base)
            for _ in range(draw.randint(0, max(1, len(w) // 25))):
                w[draw.randrange(len(w))] = f"x{draw.randrange(50)}"
            out.append(" ".join(w))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [6, 7])
def test_jaccard_against_brute_force(spark, documents, tmp_path, seed):
    rows = corpus(seed, 40) + [(1000 + k, t) for k, t in enumerate(near_copies(seed))] + [(None, "only a null id here"), (3, "two rows"), (3, "TWO rows")]
    got = sorted((tuple(r) for r in queries.op5_ngram_jaccard(spark, write(spark, tmp_path, documents, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_exact_round_finds_what_leaders_miss(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "SALTED", 1)
    rows = list(enumerate(near_copies(8)))
    got = sorted((tuple(r) for r in queries.op5_ngram_jaccard(spark, write(spark, tmp_path, documents, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_neighbourhoods_in_parts(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "SALTED", 2)
    monkeypatch.setattr(jaccard, "CELL", 300)
    rows = [*enumerate(near_copies(9)), (5000, "one two three four"), (5001, "one two three four")]
    got = sorted((tuple(r) for r in queries.op5_ngram_jaccard(spark, write(spark, tmp_path, documents, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_cells_let_all_fitting_pairs_meet(spark):
    draw = random.Random(10)
    rows = [(h, 100 * h + k, draw.randint(20, 60), k, 100 * h + k) for h in range(3) for k in range(10 * h + 2)]
    frame = spark.createDataFrame(rows, "hub long, owner long, n long, rep long, root long")
    met = {}
    for r in jaccard.cells(frame, most=250).collect():
        met.setdefault((r["hub"], r["cell"]), []).append((r["owner"], r["side"]))
    assert len(met) > 20
    pairs = {frozenset([x, y]) for v in met.values() for x, p in v for y, q in v if x != y and (p, q) in ((0, 0), (1, 2), (2, 1))}
    fit = {frozenset([x[1], y[1]]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2])}
    assert fit <= pairs


def test_points_are_packed_without_loss():
    draw = np.random.default_rng(12)
    for n in (1, 2, 30, 64, 500, 20000, 70000):
        s = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        assert (jaccard.unpacked_point(jaccard.packed_point(s), len(s)) == jaccard.point(s)).all()


def test_sizes_that_fit_are_never_told_apart():
    n = np.arange(1, 5000)
    for small in (1, 4, 79, 80, 81, 800, 3999):
        big = n[(n >= small) & (100 * small >= 80 * n)]
        assert jaccard.fitting(jaccard.size_steps(np.full(len(big), small)), jaccard.size_steps(big)).all()


def test_fingerprints_in_fewer_bytes():
    from quarry.llm import fingerprints

    keys = np.random.default_rng(13).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    packer = fingerprints.Packer(7)
    batches = [*packer.add(keys, np.arange(5000), np.zeros(5000)), *packer.flush()]
    for row in batches[0].to_pylist():
        owners = np.frombuffer(row["owners"], dtype=np.int64)
        got = (fingerprints.unpacked(row["keys"]) << np.uint64(23) | np.uint64(row["bucket"])).view(np.int64)
        assert (got == fingerprints.short(keys[owners], 7)).all()


def test_jaccard_hands_on_fewer_links_than_classes(spark, documents):
    """Copies of one text with a few words changed: each class of a neighbourhood costs one link at most."""
    draw = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(draw.randint(2, 5)):
            w[draw.randrange(300)] = f"x{draw.randrange(9999)}"
        texts.append(" ".join(w).encode())
    cell, links = jaccard.Cell(), 0
    for k, s in enumerate(sorted(jaccard.shingle_sets(texts, jaccard.WordHashes()), key=len)):
        links += len(cell.add(k, 0, k, s))
    linked = [g for _, _, g in brute_components([(k, t.decode()) for k, t in enumerate(texts)])]
    assert links == 60 - len(set(linked)) and links > 5


def test_count_tree():
    draw = np.random.default_rng(9)
    sets = sorted((np.unique(draw.integers(0, 2**63, draw.integers(1, 200)).astype(np.uint64)) for _ in range(3000)), key=len)
    tree = jaccard.CountTree(64)
    points = [jaccard.folded(jaccard.point(s), 64) for s in sets]
    for k, (p, s) in enumerate(zip(points, sets)):
        if k % 97 == 0 and k:
            got = set(tree.query(p, len(s)).tolist())
            bound = np.minimum(np.array(points[:k]), p).sum(axis=1)
            sizes = np.array([len(x) for x in sets[:k]])
            tree.marks[:k] = np.arange(k) % 3
            assert set(tree.query(p, len(s), other_than=1).tolist()) == {x for x in got if x % 3 != 1}
            assert got == set(np.flatnonzero((180 * bound >= 80 * (sizes + len(s))) & (100 * sizes >= 80 * len(s))).tolist())
        tree.append(p, len(s))


def test_odd_rows(spark, odd, tmp_path):
    bench = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    for out in (decontam.decontaminate(odd, bench, clean=True), substring.dedup(odd)):
        assert out.count() == odd.count()
    assert decontam.decontaminate(odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert jaccard.linked(odd).count() == odd.count()
    none = odd.where("false")
    assert decontam.decontaminate(none, bench).count() == substring.dedup(none).count() == jaccard.linked(none).count() == 0
