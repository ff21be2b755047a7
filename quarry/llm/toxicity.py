"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes disguises: case, letters of other scripts that look Latin, full-width letters, digits and signs put for
letters, invisible characters. The lexicon is learned from all labelled training rows: whole words and beginnings of
words, each weighted by its log-odds between toxic and clean documents. Words inside an exception phrase do not count.
A document's matched weight, taken as it is and in relation to its length, goes through a logistic curve fitted on the
training rows.

An entry must occur in MIN_SHARE of the toxic documents, so the lexicon has at most (words a document) / MIN_SHARE
entries whatever the size of the corpus; no entry is cut off beyond that.

Defined results: a null or empty text has weight 0 and gets the score of that; a null id counts as held out; labels of
repeated ids are merged, toxic if one of them is, and rows without a label are not learned from; without both toxic
and clean labels every score is 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import bounded, chunks, text_list
from quarry.llm.common import joined, stored

#: Look-alikes of Latin letters and the letters they stand for.
LOOKS = (
    "аa вb еe ѕs іi ӏl јj кk мm нh оo рp сc тt уy хx һh ԁd ԛq ԝw ѵv гr пn"
    " αa βb εe ηn κk νv οo ρp τt υu χx ωw ιi γy σo"
    " ıi ɡg ɑa ʟl ɪi ʀr ꜱs ᴀa ᴄc ᴅd ᴇe ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz"
)
#: Digits and signs put for letters.
DIGITS = "0o 1i 3e 4a 5s 7t 8b @a $s"
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "take out the trash", "class clown", "clown fish", "circus clown", "pond scum", "soap scum")
FOLD = str.maketrans(
    {p[0]: p[1] for p in LOOKS.split() if p[1].isascii()}
    | {p[0]: p[1] for p in DIGITS.split()}
    | {chr(0xFF21 + k): chr(97 + k) for k in range(26)}
    | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
    | dict.fromkeys(INVISIBLE, "")
)
BETWEEN = re.compile(r"[\W_]+")
PREFIX = (4, 8)
MIN_SHARE, MIN_DOCS, MIN_WEIGHT = 0.005, 5, 1.5


def folded(text: str) -> str:
    """The words of a text, disguises undone, each between blanks."""
    return f" {BETWEEN.sub(' ', text.lower().translate(FOLD)).strip()} "


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: a fifth of the ids, by checksum."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches):
    """Toxic and clean documents with each word, summed in each task."""
    toxic, clean = Counter(), Counter()

    def out():
        words = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    for batch in chunks(batches):
        for text, x in zip(text_list(batch), batch.column("toxic").to_pylist()):
            (toxic if x else clean).update(set(folded(text).split()))
        if len(toxic) + len(clean) > 500_000:
            yield from out()
            toxic, clean = Counter(), Counter()
    yield from out()


def learn(train: DataFrame, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS, min_weight: float = MIN_WEIGHT) -> dict[str, float]:
    """The lexicon from labelled rows (text, toxic): weights of whole words (blank, word, blank) and beginnings (blank, letters)."""
    n_toxic, n_clean = train.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_toxic or not n_clean:
        return {}
    words = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "word string, toxic long, clean long")
    low, high = PREFIX
    # A word's entries: itself and its beginnings; summed over words, and partly before the shuffle.
    begins = F.transform(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))), lambda n: F.concat(F.lit(" "), F.substring("word", F.lit(1), n)))
    whole = F.array(F.concat(F.lit(" "), "word", F.lit(" ")))
    entries = words.select(F.explode(F.when(F.length("word") >= low, F.concat(whole, begins)).otherwise(whole)).alias("entry"), "toxic", "clean")
    sums = entries.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    found = sums.where(F.col("toxic") >= max(min_docs, math.ceil(min_share * n_toxic))).select("entry", weight.alias("weight")).where(F.col("weight") >= min_weight)
    return {r["entry"]: r["weight"] for r in found.collect()}


class Lexicon:
    """An Aho-Corasick automaton of entries and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.automaton.add_word(entry, (len(entry), w))
        for phrase in exceptions:
            entry = folded(phrase)
            self.automaton.add_word(entry, (len(entry), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[int, int, float]:
        """Words, matched words and the sum of their weights; a word counts with its heaviest entry."""
        text = folded(text)
        n = text.count(" ") - 1 if len(text) > 2 else 0
        if not len(self.automaton) or not n:
            return n, 0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(text):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        for a, b in spared:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        return n, len(best), math.fsum(best.values())


def weigh(docs: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, n_words, n_matched and weight of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, exceptions))

    def run(batches):
        lexicon = Lexicon(*shared.value)
        for batch in chunks(batches):
            n, hits, sums = zip(*map(lexicon.weigh, text_list(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_words", "n_matched", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_matched long, weight double")


def features() -> dict[str, Column]:
    """What the logistic curve sees: the matched weight, and the weight in relation to the length."""
    return {
        "f_weight": F.log1p("weight"),
        "f_density": F.col("weight") / F.sqrt(F.col("n_words") + 1.0),
        "f_share": F.log1p(100 * F.col("n_matched") / (F.col("n_words") + 10.0)),
    }


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, with n_words, n_matched and weight."""
    bounded(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    train = joined(docs.select("doc_id", "text"), known, "doc_id")
    weights = learn(train)
    seen = stored(weigh(docs, weights), "toxicity")
    rows = joined(seen, known, "doc_id").withColumns(features())
    names = list(features())
    z = None
    if weights:
        model = LogisticRegression(labelCol="toxic", featuresCol="f", regParam=1e-4, maxIter=50).fit(VectorAssembler(inputCols=names, outputCol="f").transform(rows).select("f", F.col("toxic").cast("double").alias("toxic")))
        z = F.lit(float(model.intercept))
        for name, c in zip(names, model.coefficients.toArray()):
            z = z + features()[name] * float(c)
    value = F.lit(0.0) if z is None else 1 / (1 + F.exp(-z))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "n_words", "n_matched", "weight")
