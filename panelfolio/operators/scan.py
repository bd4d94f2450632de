"""Running compositions: the state after every row of a path whose next state depends on the one before.

A row is a map from the state before it to the state after it. Maps compose, and composition is associative, so the composite
of all rows up to each one needs no loop over rows: pass k joins the composites that end 16^k, 2 * 16^k, ... 15 * 16^k rows before a row
with its own. Every pass is a set of lags over one window, hence all passes share one exchange and one sort, no row holds
more than sixteen maps, and no path is ever an array. Rows of a key are dates, of which there are fewer than ``16 ** PASSES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIX = 16
PASSES = 6


def running(df: DataFrame, keys: tuple[str, ...], order: str, step: Column, compose: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Adds ``name``: the composite of ``step`` over all rows of the key up to and including each row, the first applied first.

    ``compose(first, second)`` is the map that applies ``first`` and then ``second``. ``order`` is unique within a key.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn(name, step)
    for k in range(PASSES):
        reach = RADIX**k
        ending = F.filter(F.array(*[F.lag(name, j * reach).over(along) for j in range(RADIX - 1, 0, -1)]), lambda m: m.isNotNull())
        df = df.withColumn("_before", ending).withColumn(
            name, F.when(F.size("_before") == 0, F.col(name)).otherwise(
                F.reduce(F.concat(F.slice("_before", 2, RADIX), F.array(name)), F.get("_before", F.lit(0)), compose)))
    return df.drop("_before")
