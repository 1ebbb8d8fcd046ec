"""Registries: features with a mandatory lag and a description, and fitted models with an immutable card and a checked hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import timedelta
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from tallystone.models.bayes import NormalBayes
from tallystone.models.logistic import LinearModel
from tallystone.operators.asof import feature_asof


class RegistryError(Exception):
    pass


class Model(Protocol):
    """What the library asks of a model: the features that it reads, its probability as a column over them, and what it says of itself."""

    names: list[str]

    def column(self) -> Column: ...

    def contributions(self, x: np.ndarray) -> dict[str, float]: ...

    def importance(self) -> dict[str, float]: ...


#: Models that can be stored, by the name of their kind.
KINDS: dict[str, type] = {"linear": LinearModel, "normal_bayes": NormalBayes}


def scored(df: DataFrame, model: Model, out: str = "proba") -> DataFrame:
    """df with the model's probability; null where one of its features is."""
    missing = [n for n in model.names if n not in df.columns]
    if missing:
        raise RegistryError(f"features are missing: {', '.join(missing)}")
    return df.withColumn(out, model.column())


@dataclass(frozen=True)
class Feature:
    """compute gives (keys, event_ts, value); the value may be used from event_ts + lag on."""

    name: str
    compute: Callable[..., DataFrame]
    lag: timedelta
    source: str
    description: str
    by_language_model: bool = False

    def __post_init__(self):
        if not isinstance(self.lag, timedelta):
            raise RegistryError(f"{self.name}: a lag is needed")
        if not self.description.strip():
            raise RegistryError(f"{self.name}: a description is needed")


@dataclass
class Features:
    known: dict[str, Feature] = field(default_factory=dict)

    def add(self, feature: Feature) -> None:
        if feature.name in self.known:
            raise RegistryError(f"{feature.name} is there already")
        self.known[feature.name] = feature

    def by_language_model(self) -> list[str]:
        return sorted(n for n, f in self.known.items() if f.by_language_model)

    def as_of(self, name: str, requests: DataFrame, keys: list[str], *inputs: DataFrame) -> DataFrame:
        if name not in self.known:
            raise RegistryError(f"no such feature: {name}")
        f = self.known[name]
        return feature_asof(requests, f.compute(*inputs), f.lag.days, keys)


def ensure_models_on(enabled: bool) -> None:
    if not enabled:
        raise RegistryError("models are switched off in the settings")


@dataclass(frozen=True)
class Card:
    name: str
    features: list[str]
    trained_until: str
    data_hash: str
    metrics: dict[str, float]
    retire_below: float | None = None

    def retired(self, metric: float) -> bool:
        return self.retire_below is not None and metric < self.retire_below


class Models:
    """Models are rows of (name, blob, sha256, card) in a Parquet table that Spark can reach; a blob is JSON, never code."""

    SCHEMA = "name string, blob string, sha256 string, card string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> list:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path).orderBy("name").collect()  # a row for each model
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def register(self, card: Card, model: Model) -> str:
        if card.name in self.names():
            raise RegistryError(f"{card.name} is there already, and cards don't change")
        kind = next((k for k, t in KINDS.items() if type(model) is t), None)
        if kind is None:
            raise RegistryError(f"models of type {type(model).__name__} can't be stored")
        blob = json.dumps({"kind": kind} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(model).items()}, sort_keys=True)
        digest = hashlib.sha256(blob.encode()).hexdigest()
        self.spark.createDataFrame([(card.name, blob, digest, json.dumps(asdict(card), sort_keys=True))], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return digest

    def names(self) -> list[str]:
        return [r["name"] for r in self._rows()]

    def load(self, name: str) -> tuple[Model, Card]:
        row = next((r for r in self._rows() if r["name"] == name), None)
        if row is None:
            raise RegistryError(f"no such model: {name}")
        if hashlib.sha256(row["blob"].encode()).hexdigest() != row["sha256"]:
            raise RegistryError(f"{name}: the stored model has been changed")
        values = json.loads(row["blob"])
        kind = KINDS[values.pop("kind")]
        arrays = {k: np.array(v, float) for k, v in values.items() if k != "names" and isinstance(v, list)}
        return kind(**{**values, **arrays}), Card(**json.loads(row["card"]))
