"""Strategies by name: a strategy is a function from candles to weights (secid, date, weight), built from its parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import signals

Strategy = Callable[[DataFrame], DataFrame]


class NoSuchStrategy(Exception):
    pass


def _ranked(rule: str) -> Callable[..., Strategy]:
    def build(lookback: int, top_n: int) -> Strategy:
        return lambda candles: signals.ranked(candles, rule, lookback, top_n)

    return build


def _held(secid: str, weight: float = 1.0) -> Strategy:
    return lambda candles: signals.buy_and_hold(candles, secid, weight)


def _driven(driver: str, basket: list[str], lookback: int, lag: int, short: bool = False) -> Strategy:
    return lambda candles: signals.driven_basket(candles, driver, basket, lookback, lag, short)


BUILDERS: dict[str, Callable[..., Strategy]] = {**{rule: _ranked(rule) for rule in signals.RULES}, "buy_and_hold": _held, "driven_basket": _driven}


def strategy(name: str, **parameters) -> Strategy:
    """The named strategy with these parameters; unknown names and parameters are errors."""
    if name not in BUILDERS:
        raise NoSuchStrategy(f"no strategy {name!r}; there are {', '.join(sorted(BUILDERS))}")
    try:
        return BUILDERS[name](**parameters)
    except TypeError as e:
        raise NoSuchStrategy(f"{name}: {e}") from e


def weights_of(candles: DataFrame, chosen: dict[str, Strategy]) -> DataFrame:
    """(config, secid, date, weight) of several strategies by the name of their configuration."""
    out = None
    for config, one in chosen.items():
        part = one(candles).select(F.lit(config).alias("config"), "secid", "date", "weight")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise NoSuchStrategy("no strategy is given")
    return out
