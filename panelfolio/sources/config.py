"""Strategy switches kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_flag(json: Column, key: str, default: bool) -> Column:
    """The boolean under ``key``; strings, numbers, absent keys and broken JSON fall back to the default."""
    return F.coalesce(F.from_json(json, f"`{key}` boolean")[key], F.lit(default))
