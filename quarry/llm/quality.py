"""Quality rules: base heuristics, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Native: DataFrame functions only. Words and pairs of neighbouring words are hashed into buckets. Two multinomials are
counted over all distinct texts: the trusted one over texts labelled good, the raw one over everything. A document's
score is the mean of ln p_trusted(bucket) - ln p_raw(bucket) over its n-grams, so it does not depend on length. Every
document is kept or rejected by comparing the score with one fixed threshold; nothing is sampled.

Defined results: a null or empty text has no words, scores 0 and fails the base rules; a null doc_id is judged like
any other and has no label; rows of one text are judged alike and count once in both models, trusted if a row of them is
labelled and no label of them is bad; without labelled
documents the trusted model is the raw one and every score is 0; an empty table gives an empty result; of further
columns none is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import joined, let, small, stored, words

BUCKETS = 16384
#: Occurrences that each bucket is taken to have besides its own, as likely trusted as the corpus at large: a bucket
#: with few occurrences says little, whatever they are.
PRIOR = 100.0
#: The prior without a fixed number: this share of the mean count of a bucket, over the trusted share of all n-grams. So
#: neither the size of the corpus nor the number of labels decides what a count says. ``kept_only`` takes no less than
#: PRIOR: on a corpus with few occurrences a bucket, which can say little of any document, it rejects little.
PRIOR_SHARE = 0.5
#: Nats an n-gram below which a document is rejected.
THRESHOLD = -0.04
#: Labelled ids up to this number are broadcast (16 MB); more are joined by shuffle.
TRUSTED_ROWS = 1_000_000
#: Repeated or trusted texts up to this number are broadcast (20 MB, two hashes a text); more are joined by shuffle.
TEXT_ROWS = 250_000
SYMBOLS = "#*$%&|<>"


def buckets(w: Column, n: int = BUCKETS) -> Column:
    """The buckets of all words and all pairs of neighbours, in text order; ``w`` is an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int"))
    return F.when(F.size(w) < 2, one).otherwise(F.concat(one, pairs))


def fit(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, prior: float | None = PRIOR, least: float = 0.0) -> list[float]:
    """ln p_trusted - ln p_raw for each bucket, from counts over all distinct texts, both smoothed by the same prior.

    With ``prior`` None it is ``PRIOR_SHARE`` of the mean count over the trusted share, at ``least`` so much: all counts
    multiplied by one number give the same ratios, and the fewer texts are trusted, the nearer the ratios are to 0. Trusted are texts all of whose labels have quality 1. A text with c rows adds c times its n-grams to the counts of
    the texts with c rows, which are then divided by c without a remainder; so no text is moved to count it once. The
    counts are pre-aggregated in each task; the driver gets the ``n`` totals.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    side = F.broadcast(said) if small(said, TRUSTED_ROWS) else said.hint("merge")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k"))
    texts = keyed.drop("text").join(side, "doc_id", "left").groupBy("h", "k").agg(F.count("*").alias("c"), F.min("q").alias("q"))
    texts = stored(texts.where("c > 1 or q = 1").select("h", "k", "c", F.when(F.col("q") == 1, 1).alias("t")), "quality-texts")
    rows = joined(keyed.drop("doc_id"), texts, ["h", "k"], "left", rows=TEXT_ROWS)
    grams = rows.select(F.coalesce("c", F.lit(1).cast("long")).alias("c"), "t", F.explode(let(words(F.col("text")), lambda w: buckets(w, n))).alias("b"))
    by_copies = grams.groupBy("b", "c").agg(F.count("*").alias("raw"), F.count("t").alias("good"))
    counts = by_copies.groupBy("b").agg(F.sum(F.expr("raw div c")).alias("raw"), F.sum(F.expr("good div c")).alias("good")).collect()
    raw, good = [0] * n, [0] * n
    for b, r, g in counts:
        raw[b], good[b] = r, g
    if not sum(good):
        return [0.0] * n
    share = sum(good) / sum(raw)
    if prior is None:
        prior = max(least, PRIOR_SHARE * sum(raw) / n / share)
    return [math.log((g / share + prior) / (r + prior)) for g, r in zip(good, raw)]


def score(w: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the n-grams of the words ``w``; 0 without words."""
    # A folded literal: one array of doubles, not one expression a bucket.
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(table, x)) / F.size(b)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(let(buckets(w, len(ratios)), total))


def repeated_words(w: Column, width: int = 8) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more."""
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))))

    def covered(g: Column) -> Column:
        order = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        empty = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        sweep = lambda p: F.aggregate(p, empty, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))["n"]
        return sweep(let(order, starts))

    any_twice = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))
    return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(windows, any_twice)).cast("long")


def measured(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    sums = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
        score(w, ratios).alias("score"),
    ))
    out = docs.withColumn("_m", sums).withColumns({
        "n_words": F.col("_m.n_words"),
        "word_chars": F.col("_m.word_chars"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_m.n_repeat_words"),
        "score": F.col("_m.score"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).drop("_m")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS, prior: float | None = PRIOR) -> DataFrame:
    """doc_id, text and the measures of every document, with ``kept``: base rules passed and score at the threshold or over."""
    ratios = fit(docs, labels, n, prior)
    return measured(docs.select("doc_id", "text"), ratios).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def kept_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS, prior: float | None = None, least: float = PRIOR) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; nothing is shuffled."""
    own = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "text")
    out = measured(row, fit(docs, labels, n, prior, least)).where(~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select("_row.*")
