"""Reports as text from frames of a row or a few: the comparison with cash comes first, and the best never stands without the median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.finance import Costs, percent, round_trip_pct, spaced_number


def _one(df: DataFrame) -> dict:
    row = df.first()
    return {} if row is None else row.asDict()


def break_even_header(capital: float, risk_free: float, infrastructure: float, costs: Costs) -> str:
    need = risk_free + infrastructure / capital
    return f"Capital {capital:,.0f}; a round trip costs {round_trip_pct(costs):.2f}%; the break-even is {need:.1%} a year: {risk_free:.1%} risk-free and {infrastructure / capital:.1%} for infrastructure."


def run_report(
    run_id: str, equity_metrics: DataFrame, fill_metrics: DataFrame, benchmarks: DataFrame, halted: str | None, limitations: list[str], risk_free: float,
    tax: DataFrame | None = None, resolution: DataFrame | None = None, stress: float | None = None,
) -> str:
    """benchmarks: (name, annual_return); tax: of `tax_by_year`; resolution: of `metrics.resolution`; stress: the factor that costs were raised by."""
    shown = equity_metrics.where(F.col("run_id") == run_id).select(
        F.col("annual_return").alias("raw"), percent(F.col("annual_return")).alias("annual"), percent(F.col("max_drawdown")).alias("drawdown"), "max_drawdown_days", F.round("sharpe", 2).alias("sharpe"), spaced_number(F.col("end_equity")).alias("end")
    )
    m, f = _one(shown), _one(fill_metrics.where(F.col("run_id") == run_id))
    lines = [f"STOPPED: {halted}"] if halted else []
    if m.get("raw") is None or m["raw"] < risk_free:
        lines.append(f"LOSES TO CASH: {m.get('annual', 'n/a')} a year against {risk_free:.1%}")
    lines += [f"run {run_id}: {m.get('annual', 'n/a')} a year, drawdown {m.get('drawdown', 'n/a')} over {m.get('max_drawdown_days', 0)} days, Sharpe {m.get('sharpe')}, end {m.get('end', 'n/a')}"]
    lines += [f"{f.get('n_trades', 0)} trades, turnover {f.get('turnover') or 0:,.0f}, costs {f.get('total_costs') or 0:,.2f}"]
    lines += [f"against {r['name']}: {r['text']}" for r in benchmarks.select("name", percent(F.col("annual_return")).alias("text")).orderBy("name").collect()]  # a row for each benchmark
    if tax is not None:
        lines += [f"tax of {r['year']}: {r['tax']:,.2f} on {r['pnl']:,.2f}" for r in tax.where(F.col("run_id") == run_id).orderBy("year").collect()]  # a row for each year
    if resolution is not None:
        r = _one(resolution)
        lines.append(f"a lot costs {r['mean_lot_cost']:,.2f} on average, {r['affordable']} securities are affordable, the least step is {r['min_step']:.1%}" + (f"; too dear: {r['too_dear']}" if r["too_dear"] else ""))
    if stress is not None:
        lines.append(f"stressed: costs are {stress:g} times the usual")
    return "\n".join([*lines, *[f"limitation: {x}" for x in limitations]])


def walk_forward_report(chosen: DataFrame, annual: DataFrame, oos: DataFrame, verdict: str) -> str:
    """chosen: (window, config); annual: (config, annual) of all configs; oos: one row of equity_metrics."""
    from tallystone.engine.walkforward import best_and_median

    b = _one(best_and_median(annual).select(percent(F.col("best")).alias("best"), percent(F.col("median")).alias("median"), "n"))
    lines = [f"window {r['window']}: {r['config']}" for r in chosen.orderBy("window").collect()]  # a row for each window
    out = _one(oos.select(percent(F.col("annual_return")).alias("annual"), percent(F.col("max_drawdown")).alias("drawdown")))
    return "\n".join([*lines, f"out of sample: {out.get('annual', 'n/a')} a year, drawdown {out.get('drawdown', 'n/a')}", f"of {b.get('n', 0)} configurations the best made {b.get('best')}, the median {b.get('median')}", f"verdict: {verdict}"])


def ledger_report(summary: DataFrame) -> str:
    s = _one(summary.select("n_runs", percent(F.col("best")).alias("best"), percent(F.col("median")).alias("median"), "too_many"))
    return f"{s['n_runs']} runs: best {s['best']}, median {s['median']}" + ("; so many runs find a good one by luck" if s["too_many"] else "")
