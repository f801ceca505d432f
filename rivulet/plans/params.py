"""Checked parameters of the three entry points: crawl, ledger and search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

_ISO = re.compile(r"\d{4}-\d{2}-\d{2}\Z")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}, not {value}")


def _one_of(name: str, value: str, options: tuple[str, ...]) -> None:
    if value not in options:
        raise ValueError(f"{name} must be one of {', '.join(options)}, not {value!r}")


@dataclass(frozen=True)
class CrawlParams:
    seed: str
    depth: int = 2
    direction: str = "upstream"
    link_mode: str = "direct"
    min_amount: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    max_per_node: int = 25
    max_nodes: int = 600

    def __post_init__(self) -> None:
        _within("depth", self.depth, 1, 6)
        _one_of("direction", self.direction, ("upstream", "downstream", "both"))
        _one_of("link_mode", self.link_mode, ("direct", "donor"))
        _within("max_per_node", self.max_per_node, 1, 200)
        _within("max_nodes", self.max_nodes, 10, 5000)
        if self.min_amount is not None:
            _within("min_amount", self.min_amount, 0, float("inf"))
        for x in (self.date_from, self.date_to):
            if x is not None:
                if not _ISO.match(x):
                    raise ValueError(f"dates are yyyy-mm-dd, not {x!r}")
                date.fromisoformat(x)


@dataclass(frozen=True)
class LedgerParams:
    view: str = "sources"
    direction: str = "in"
    q: str = ""
    sort: str = "amount"
    order: str = "desc"
    limit: int = 100
    offset: int = 0
    min_amount: float | None = None

    def __post_init__(self) -> None:
        _one_of("view", self.view, ("sources", "transactions"))
        _one_of("direction", self.direction, ("in", "out", "all"))
        _one_of("sort", self.sort, ("amount", "date", "name", "count"))
        _one_of("order", self.order, ("asc", "desc"))
        _within("limit", self.limit, 1, 500)
        _within("offset", self.offset, 0, float("inf"))
        _within("length of q", len(self.q), 0, 120)


@dataclass(frozen=True)
class SearchParams:
    q: str
    limit: int = 20
    traversable_only: bool = False

    def __post_init__(self) -> None:
        _within("length of q", len(self.q), 2, 120)
        _within("limit", self.limit, 1, 50)
