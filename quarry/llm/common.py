"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import stored

__all__ = ["joined", "let", "small", "stored", "words"]

#: White space between words, the six ASCII characters.
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text between ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != F.lit(""))


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, by a count that each task makes for itself."""
    return df.count() <= rows


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Join with ``right`` broadcast only if a count shows that it has ``rows`` rows at most; else a shuffle join."""
    return left.join(F.broadcast(right) if small(right, rows) else right.hint("merge"), on, how)
