"""Registered queries: each runs library operators over the whole given tables."""

from panelfolio.queries.common import REGISTRY
from panelfolio.queries import market, signals, portfolios, validation, sectors, trading, landed  # noqa: F401  (registration)

__all__ = ["REGISTRY"]
