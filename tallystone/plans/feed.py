"""A source without a network for the queries of the readers: an answer depends on the request alone, and holds only the days that it asks for."""

from __future__ import annotations

import datetime as dt
import json

PAGE = 40


def answer(url: str, params: dict) -> str:
    """A page of one candle for each day, at prices of the day's ordinal, dearer by the length of the address; or of an index's members."""
    start = int(params["start"])
    if "/analytics/" in url:
        names = [f"m{int(params['date'][-2:]) + i}" for i in range(50)][start : start + PAGE]
        return json.dumps({"analytics": {"columns": ["ticker", "weight"], "data": [[n, 1.0] for n in names]}, "analytics.cursor": {"columns": ["INDEX", "TOTAL", "PAGESIZE"], "data": [[start, 50, PAGE]]}})
    first, last = (dt.date.fromisoformat(params[k]) for k in ("from", "till"))
    days = [first + dt.timedelta(i) for i in range((last - first).days + 1)]
    rows = [[f"{d} 00:00:00", "x", n := float(d.toordinal() % 1000 + len(url.split("/boards/")[1].split("/")[0])), n + 2, n - 1, n + 1, 10 * n, 10.0] for d in days[start : start + PAGE]]
    name = "history" if "/history/" in url else "candles"
    return json.dumps({name: {"columns": ["begin", "other", "open", "high", "low", "close", "value", "volume"], "data": rows}})
