"""Naive Bayes with normal features: a second model behind the protocol of `registry.Model`. Its fit is one aggregate over all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class NormalBayes:
    """means and variances: a row for each class, 0 and 1, a column for each feature; prior: log odds of class 1."""

    names: list[str]
    means: np.ndarray
    variances: np.ndarray
    prior: float

    def _terms(self, values: list) -> list:
        """What each feature adds to the log odds."""
        out = []
        for x, m, v in zip(values, self.means.T.tolist(), self.variances.T.tolist(), strict=True):
            out.append((x - m[0]) * (x - m[0]) * (0.5 / v[0]) - (x - m[1]) * (x - m[1]) * (0.5 / v[1]) + 0.5 * math.log(v[0] / v[1]))
        return out

    def column(self) -> Column:
        """The probability of class 1 as an expression over columns of the features' names; null where a feature is."""
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, self._terms([F.col(n) for n in self.names]), F.lit(self.prior))))

    def contributions(self, x: np.ndarray) -> dict[str, float]:
        return dict(zip(self.names, map(float, self._terms(list(x))), strict=True))

    def importance(self) -> dict[str, float]:
        """How far apart the classes are in a feature, in its own deviations."""
        return dict(zip(self.names, ((self.means[1] - self.means[0]) / np.sqrt(self.variances.mean(0))).tolist(), strict=True))


def fit_bayes(data: DataFrame, features: list[str], label: str = "y", least_variance: float = 1e-12) -> NormalBayes | None:
    """A model of data (features, label 0 or 1); rows that lack one go. None if a class is missing."""
    known = data.select(F.col(label).cast("int").alias("y"), *features).na.drop().where("y in (0, 1)")
    moments = F.array(*[f(x) for f in (F.avg, F.var_pop) for x in features])
    rows = {r["y"]: r for r in known.groupBy("y").agg(F.count("*").alias("n"), moments.alias("m")).collect()}  # two rows
    if len(rows) < 2:
        return None
    k = len(features)
    means, variances = (np.array([rows[y]["m"][at : at + k] for y in (0, 1)]) for at in (0, k))
    return NormalBayes(features, means, np.maximum(variances, least_variance), math.log(rows[1]["n"] / rows[0]["n"]))
