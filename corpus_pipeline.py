"""A training corpus from raw documents: five stages, each written and read again before the next.

1. quality rules: rejected documents go;
2. n-gram Jaccard join: of each group of near copies the document with the least doc_id stays, once;
3. substring dedup: words that repeat windows of smaller documents are cut out; documents with nothing left go;
4. benchmark decontamination: spans of benchmark phrases are cut out; documents with nothing left go;
5. BPE: the text of each document as token ids.

Each stage works on all rows that the one before kept. All but the last return the columns of ``documents``; n_chars
is brought up to date where a text changes. Rows whose doc_id is null are judged like others; in a group of near copies
they come after all others. Rows of one doc_id with different texts are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontam, jaccard, quality, substring
from quarry.llm.common import stored
from quarry.llm.queries import table, tokenizer_path
from quarry.storage import release, stored_so_far

#: The stages cut texts by counts over the whole corpus that SQL cannot express at this length; tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_only(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_each(docs)


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text; rows without words in it go."""
    out = docs.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(substring.dedup(docs, keep_space=True), "kept_text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = docs.withColumn("whole", F.col("text"))
    found = decontam.decontaminate(kept, table(spark, sf_dir, "benchmark"), clean=True)
    return _with_text(found.withColumn("new", F.coalesce("clean_text", "whole")), "new")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = stored_so_far()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        # The stage is written: what it and the one before left behind is not read any more.
        release(spark, since=before, but_last=1)
    return docs
