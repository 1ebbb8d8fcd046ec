"""Scalar functions as columns: costs, sizing, lots, break-even, verdicts, formats."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(value: Column, by: Column) -> Column:
    """value / by as doubles have it: infinite by zero, NaN for zero by zero. Spark's own division fails there."""
    endless = F.pow(by, F.lit(-1.0))  # of the zero's sign; atan2 takes -0.0 as 0.0
    return F.when(by == 0, value * endless).otherwise(value / by)


@dataclass(frozen=True)
class Costs:
    """Shares are in per cent of the order's value."""

    broker_pct: float = 0.05
    broker_min: float = 1.0
    exchange_pct: float = 0.01
    half_spread_pct: float = 0.05
    base_slippage_pct: float = 0.05
    impact: float = 5.0
    warn_share: float = 0.01
    reject_share: float = 0.05
    stress: float = 1.0
    tax_rate: float = 0.13
    borrow_rate: float = 0.18


def slippage_pct(value: Column, adv: Column, c: Costs) -> Column:
    return (F.lit(c.base_slippage_pct) + F.lit(c.impact) * value / adv) * c.stress


def trade_costs(value: Column, adv: Column, c: Costs) -> Column:
    """Struct of the four parts and their total; null where the order can't be filled."""
    broker = F.greatest(value * c.broker_pct / 100, F.lit(c.broker_min)) * c.stress
    exchange = value * c.exchange_pct / 100 * c.stress
    spread = value * c.half_spread_pct / 100 * c.stress
    slip = value * slippage_pct(value, adv, c) / 100
    parts = F.struct(broker.alias("broker"), exchange.alias("exchange"), spread.alias("half_spread"), slip.alias("slippage"), (broker + exchange + spread + slip).alias("total"))
    return F.when(fill_status(value, adv, c).isin("ok", "warning"), parts)


def fill_status(value: Column, adv: Column, c: Costs) -> Column:
    """`invalid` (no positive value), `no turnover`, `rejected` (too large a share of turnover), `warning` or `ok`."""
    return (
        F.when(value.isNull() | (value <= 0), "invalid")
        .when(adv.isNull() | ~(adv > 0), "no turnover")
        .when(value / adv > c.reject_share, "rejected")
        .when(value / adv > c.warn_share, "warning")
        .otherwise("ok")
    )


def position_lots(price: Column, lot: Column, target: Column, cash: Column, adv: Column, c: Costs) -> Column:
    """The most lots whose value is within the target and whose value with costs is within the cash.

    Costs are the greater of two rising curves of the value (with the broker's share, or with its least fee), each at most quadratic, so the most that is
    affordable is the lesser of two roots; rounding is settled by trying the lots next to it.
    """
    unit = price * lot
    square = F.lit(c.impact * c.stress / 100) / adv
    fixed = 1 + (c.exchange_pct + c.half_spread_pct + c.base_slippage_pct) * c.stress / 100

    def root(slope: float, room: Column) -> Column:
        curved = (F.sqrt(F.lit(slope**2) + 4 * square * room) - slope) / (2 * square)
        return F.when(room <= 0, 0.0).when(square > 0, curved).otherwise(room / slope)

    value = F.least(root(fixed + c.broker_pct * c.stress / 100, cash), root(fixed, cash - c.broker_min * c.stress), target, F.lit(c.reject_share) * adv)
    near = F.greatest(F.floor(value / unit), F.lit(0)).cast("long")

    def fits(k: Column) -> Column:
        v = k * unit
        return (k > 0) & (v <= target) & F.coalesce(v + trade_costs(v, adv, c)["total"] <= cash, F.lit(False))

    return F.coalesce(F.when(fits(near + 1), near + 1).when(fits(near), near).when(fits(near - 1), near - 1), F.lit(0)).cast("int")


def target_lots(held: Column, raw: Column) -> Column:
    """Lots wanted: a new position is cut towards zero, one that is held is rounded, halves away from zero."""
    return F.when(held == 0, F.signum(raw) * F.floor(F.abs(raw))).otherwise(F.signum(raw) * F.floor(F.abs(raw) + 0.5)).cast("long")


def capped_weight(weight: Column, most: float) -> Column:
    return F.signum(weight) * F.least(F.abs(weight), F.lit(most))


def power_of_ten_lot(target: Column, price: Column) -> Column:
    """Lot size of an asset without lots: the power of ten below target / price."""
    return F.pow(F.lit(10.0), F.floor(F.log10(target / price)))


def round_trip_pct(c: Costs) -> float:
    """Cost of buying and selling in deep liquidity, in per cent."""
    return 2 * (c.broker_pct + c.exchange_pct + c.half_spread_pct + c.base_slippage_pct) * c.stress


def break_even(risk_free: Column, infrastructure: Column, capital: Column) -> Column:
    """The yearly return that pays the risk-free rate and the infrastructure."""
    return risk_free + infrastructure / capital


def verdict(annual: Column, risk_free: Column, breakeven: Column, margin: float = 0.1) -> Column:
    """`no data`, `below risk-free`, `below break-even`, `no margin` or `passes`."""
    return (
        F.when(annual.isNull() | F.isnan(annual), "no data")
        .when(annual < risk_free, "below risk-free")
        .when(annual < breakeven, "below break-even")
        .when(annual < breakeven + margin, "no margin")
        .otherwise("passes")
    )


def tax(pnl: Column, rate: float) -> Column:
    return F.greatest(pnl, F.lit(0.0)) * rate


def spaced_number(value: Column, digits: int = 2) -> Column:
    """1 234.50"""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(" "))


def percent(value: Column, digits: int = 1) -> Column:
    """12.3%; unknown values as n/a, infinite ones as ∞."""
    plain = F.concat(F.replace(F.format_number(value * 100, digits), F.lit(","), F.lit("")), F.lit("%"))
    return F.when(value.isNull() | F.isnan(value), "n/a").when(F.abs(value) == float("inf"), "∞").otherwise(plain)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def logit(p: Column, eps: float = 1e-9) -> Column:
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def amount(text: Column) -> Column:
    """A positive number in text with spaces and a decimal comma, else null."""
    cleaned = F.replace(F.regexp_replace(text, r"[^\d,.\-]", ""), F.lit(","), F.lit("."))
    value = cleaned.try_cast("double")
    return F.when(value > 0, value)


def first_date(text: Column) -> Column:
    """The first dd.mm.yyyy in text."""
    found = F.regexp_extract(text, r"\d{2}\.\d{2}\.\d{4}", 0)
    return F.try_to_date(F.when(found != "", found), "dd.MM.yyyy")


def canonical_params(params: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def params_hash(params: Column) -> Column:
    return F.substring(F.sha2(canonical_params(params), 256), 1, 16)
