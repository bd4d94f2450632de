"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracles import landed, market, portfolios, sectors, signals, trading, validation

STATEMENTS: dict[str, str] = {}
for module in (landed, market, signals, portfolios, validation, sectors, trading):
    STATEMENTS.update(module.S)
