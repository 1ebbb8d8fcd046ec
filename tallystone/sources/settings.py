"""Settings and security lists from YAML with a closed schema: unknown names, repeated names and wrong types are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date
from typing import Any, get_type_hints

from tallystone.functions.finance import Costs


@dataclass(frozen=True)
class Bounds:
    """What a portfolio may hold: a share of capital in one security, and so many of them."""

    position_share: float = 0.25
    positions: int = 4


@dataclass(frozen=True)
class Settings:
    """What costs, sizing, break-even and reports are computed with."""

    capital: float = 20_000.0
    risk_free: float = 0.16
    infrastructure: float = 1_500.0
    short_sales: bool = False
    costs: Costs = field(default_factory=Costs)
    bounds: Bounds = field(default_factory=Bounds)


class SettingsError(Exception):
    pass


def _yaml(text: str) -> Any:
    import yaml

    class Loader(yaml.SafeLoader):
        """Refuses a name twice in a mapping."""

    def mapping(loader, node):
        names = [loader.construct_object(k) for k, _ in node.value]
        if len({*names}) < len(names):
            raise SettingsError(f"a name is given twice: {sorted(n for n in names if names.count(n) > 1)[0]}")
        return {n: loader.construct_object(v, deep=True) for n, (_, v) in zip(names, node.value, strict=True)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader)  # noqa: S506  a SafeLoader


def build(kind: type, values: dict, where: str = "settings"):
    """The dataclass from a mapping; nested dataclasses from nested mappings."""
    if not isinstance(values, dict):
        raise SettingsError(f"{where}: a mapping is needed")
    hints = get_type_hints(kind)
    unknown = {*values} - {f.name for f in fields(kind)}
    if unknown:
        raise SettingsError(f"{where}: no such name: {sorted(unknown)[0]}")
    made = {}
    for name, value in values.items():
        hint = hints[name]
        if is_dataclass(hint):
            made[name] = build(hint, value, f"{where}.{name}")
        elif hint is bool and not isinstance(value, bool) or hint in (int, float) and (isinstance(value, bool) or not isinstance(value, int | float)):
            raise SettingsError(f"{where}.{name}: {hint.__name__} is needed")
        else:
            made[name] = hint(value) if hint in (int, float) else value
    return kind(**made)


def load_settings(text: str) -> Settings:
    return build(Settings, _yaml(text) or {})


def load_universe(text: str) -> list[str]:
    """Upper-case tickers of the list under `tickers`; a ticker twice is an error."""
    found = [str(t).strip().upper() for t in (_yaml(text) or {}).get("tickers", [])]
    twice = sorted({t for t in found if found.count(t) > 1})
    if twice:
        raise SettingsError(f"a ticker is given twice: {twice[0]}")
    return found


def iso_date(text: str) -> date:
    try:
        return date.fromisoformat(text)
    except ValueError as e:
        raise SettingsError(f"not an ISO date: {text}") from e


__all__ = ["Bounds", "Costs", "Settings", "SettingsError", "build", "iso_date", "load_settings", "load_universe"]
