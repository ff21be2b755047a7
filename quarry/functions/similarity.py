"""Similarities and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def pearson(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson correlation from sums over co-rated values; 0 where a side does not vary or the two do not covary."""
    top = sab - sa * sb / n
    low = F.sqrt(F.greatest((saa - sa * sa / n) * (sbb - sb * sb / n), F.lit(0.0)))
    return F.when((F.abs(top) < EPSILON) | (low < EPSILON), F.lit(0.0)).otherwise(top / F.greatest(low, F.lit(EPSILON)))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def set_cosine(common: Column, a: Column, b: Column) -> Column:
    """Common members over the root of the product of sizes; 0 where a set is empty."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(common / F.greatest(F.sqrt(a.cast("double")) * F.sqrt(b.cast("double")), F.lit(EPSILON)))


def amplified(sim: Column, power: float = 2.5) -> Column:
    """Case amplification: keeps the sign, pushes weak similarities towards 0."""
    return sim * F.pow(F.abs(sim), F.lit(power))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mahalanobis(a: Column, b: Column, std: Column, floor: float = 1e-6) -> Column:
    """Distance with each dimension divided by its deviation; deviations under ``floor`` count as ``floor``."""
    z = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), std, lambda d, s: d / F.greatest(s, F.lit(floor)))
    return F.sqrt(F.aggregate(F.transform(z, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
