"""The pipeline against the operators' brute-force versions, stage by stage."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quarry.llm import queries
from tests.llm.test_quality_sharding_urls import brute_quality
from tests.llm.test_text_matching import WORD, brute_components


def words(draw, n):
    return [f"{draw.choice('bcdfg')}{draw.randrange(900)}" for _ in range(n)]


def tables(spark, path):
    draw = random.Random(21)
    passage, item = words(draw, 60), words(draw, 25)
    docs = []
    for k in range(60):
        w = words(draw, draw.choice([30, 80, 200]))
        if k % 9 == 1:
            w[10:10] = passage
        if k % 9 == 2:
            w[5:5] = item
        docs.append((k, " ".join(w)))
    docs += [(100 + k, docs[k][1]) for k in range(0, 20, 3)] + [(200, "too short"), (201, None), (202, "again and again and so on we go " * 8)]
    docs += [(300, docs[4][1] + " tail"), (301, " ".join(item)), (302, " ".join(passage))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, [(i, q) for i, q, _ in labels], item, passage


def test_stages(spark, tmp_path):
    docs, labels, item, passage = tables(spark, str(tmp_path))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(corpus_pipeline.STAGES) == 5
    now = queries.table(spark, str(tmp_path), "documents")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == columns
            assert now.where(F.length("text") != F.col("n_chars")).count() == 0
        seen.append({r["doc_id"]: r for r in now.collect()})
    first, second, third, fourth, last = seen
    quality = brute_quality(docs, labels)
    assert set(first) == {i for i, _ in docs if quality[i][6]}
    groups = {i: c for i, _, c in brute_components([(i, first[i]["text"]) for i in first])}
    assert set(second) == {i for i in groups if groups[i] == i}
    for i, r in third.items():  # a repeated passage stays where it came first
        inside = " ".join(passage) in r["text"]
        assert not inside or i == min(k for k in second if " ".join(passage) in second[k]["text"])
    assert all(" ".join(item) not in " ".join(WORD.findall(r["text"])) for r in fourth.values())
    clean = [i for i in second if i < 60 and i % 9 not in (1, 2)]
    assert clean and all(fourth[i]["text"] == dict(docs)[i] for i in clean)
    assert set(last) == set(fourth) and all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in last.values())


def test_run_equals_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and out.count() > 30


def test_one_row_of_a_group_stays(spark, documents):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(4, text(4)), (4, text(4)), (9, text(4)), (None, text(4) + " more"), (None, text(5)), (None, text(5)), (6, text(6)), (6, text(7)), (8, text(7)), (3, ""), (3, None)]
    out = corpus_pipeline.near_duplicates(spark, documents(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted({(4, text(4)), (None, text(5)), (6, text(6)), (6, text(7)), (3, ""), (3, None)}, key=str)
    assert corpus_pipeline.near_duplicates(spark, documents(rows).where("false"), "").count() == 0


def test_stages_take_rows_of_one_id_apart(spark, documents):
    words_ = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(words_)), (5, " ".join(["head", *words_[3:25], *(f"z{k}" for k in range(30))])), (5, " ".join(f"y{k}" for k in range(30)))]
    got = sorted(r["text"] for r in corpus_pipeline.repeated_substrings(spark, documents(rows), "").collect())
    assert got == sorted([rows[0][1], rows[2][1], " ".join(["head", *(f"z{k}" for k in range(30))])])
