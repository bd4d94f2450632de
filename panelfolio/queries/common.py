from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import panel as P
from panelfolio.session import stage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ANCHORS = [T.TYPES.benchmark, T.TYPES.bond]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Staged: one scan of the raw lines, several readers."""
    return stage(T.test_prices(spark, sf), "prices")


def market(spark: SparkSession, sf: str) -> P.Panel:
    """The anchored panel, staged because signals, returns and regimes all read it."""
    return P.prepare_panel(prices(spark, sf), anchors=ANCHORS, staged=True)
