"""The normal distribution as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, and the distance from which the rest is nothing (2e-9).
TERMS, FAR = 120, 6.0


def normal_cdf(x: Column) -> Column:
    """Phi by its series 0.5 + phi(x) (x + x^3 / 3 + x^5 / 15 + ...); 0 or 1 beyond FAR."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more)["total"]
    inside = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(x.isNull(), None).when(x > FAR, 1.0).when(x < -FAR, 0.0).otherwise(inside)


def normal_quantile(p: Column, rounds: int = 60) -> Column:
    """The x with normal_cdf(x) = p, by halving [-FAR, FAR]."""
    start = F.struct(F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        above = normal_cdf(middle) < p
        return F.struct(F.when(above, middle).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)
    return F.when(p.isNotNull(), (ends["low"] + ends["high"]) / 2)
