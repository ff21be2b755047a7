"""URL filters: association rules over URL tokens, mined by Spark's FP-growth and matched by inverted index.

Host rules decide the URLs that they fit. These are the labels from which FP-growth mines token combinations that
imply a verdict; rules that pass the support and confidence thresholds judge every other URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule fits it and no token matches,
so it is allowed; repeated rows are judged alike and all kept; ties between rules go to the higher support, then to
block; an empty table, or one on which no host rule fits, gives no mined rules; further columns are passed by.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import joined, stored

#: The list of host and path rules in force, as (verdict, rule); a rule without a path ends in a slash.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Columns of the result; columns of the input that are called so are replaced.
ADDED = ("host", "path", "rule", "verdict", "by")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, or a domain above it, and the start of the path; and its verdict."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & F.when(path == "", F.lit("/")).otherwise(path).startswith("/" + start)
        best, verdict = F.when(fits, F.lit(rule)).otherwise(best), F.when(fits, F.lit(said)).otherwise(verdict)
    return best, verdict


def tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: labels of the host as ``h:``, words of the path as ``p:``."""
    h = F.transform(F.filter(F.split(host, r"\."), lambda w: w != ""), lambda w: F.concat(F.lit("h:"), w))
    p = F.transform(F.filter(F.split(path, r"[^0-9A-Za-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("p:"), w))
    return F.array_distinct(F.concat(h, p))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules from ``labelled`` (tokens, verdict): tokens, verdict, confidence, support.

    FP-growth is distributed by item groups; a token under ``min_support`` never enters a tree. Keeps all rules whose
    consequent is a verdict, pruned by support and confidence alone.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    verdict = F.element_at("consequent", 1)
    return model.associationRules.where(verdict.startswith("v:") & ~F.exists("antecedent", lambda t: t.startswith("v:"))).select(F.array_sort("antecedent").alias("tokens"), F.substring(verdict, 3, 99).alias("verdict"), "confidence", "support")


def judge(pages: DataFrame, url: str = "url", rules=RULES, min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict and by (``rule``, ``mined`` or ``default``).

    The inverted index maps a token to the mined rules that need it. It is probed once for each distinct set of
    tokens that occur in rules, not once a row: a hot host costs one probe.
    """
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ADDED]).alias("row"), F.col(f"`{url}`").alias("url"))
    host, path = split_url(F.col("url"))
    seen = kept.select("row", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("row", "host", "path", rule.alias("rule"), said.alias("said"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    labelled = seen.where(F.col("said").isNotNull()).select("tokens", F.col("said").alias("verdict"))
    # The rules are few by support: each rule takes a min_support share of the labelled URLs.
    mined = stored(mine(labelled, min_support, min_confidence), "url-rules")
    index = mined.withColumn("id", F.array_join("tokens", " ")).select(
        F.explode("tokens").alias("token"), "id", F.size("tokens").alias("n"), "verdict", "confidence", "support")
    vocabulary = mined.select(F.explode("tokens").alias("t")).agg(F.coalesce(F.array_sort(F.collect_set("t")), F.array().cast("array<string>")).alias("v"))
    vocabulary = vocabulary.first()["v"]  # at most the frequent tokens, (tokens a URL) / min_support
    seen = seen.withColumn("known", F.array_sort(F.array_intersect("tokens", F.lit(vocabulary) if vocabulary else F.array().cast("array<string>"))))
    sets = seen.where(F.col("said").isNull()).select("known").distinct()
    probes = sets.select("known", F.explode("known").alias("token"))
    fired = (
        joined(probes, index, "token")
        .groupBy("known", "id", "verdict", "n", "confidence", "support")
        .agg(F.count("*").alias("met"))
        .where("met = n")
        .groupBy("known")
        .agg(F.max(F.struct("confidence", "support", (F.col("verdict") == "block").cast("int").alias("b"), "verdict")).alias("best"))
        .select("known", F.col("best.verdict").alias("mined"))
    )
    out = joined(seen, fired, "known", "left")
    verdict = F.coalesce("said", "mined", F.lit("allow"))
    by = F.when(F.col("said").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return out.select("row.*", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
