"""Price-like panels derived from the order tables by Spark jobs.

Unit prices of line items are summed to exact integer cents per (asset, day), then smoothed by a trailing
volume-weighted mean. Integer sums make every close reproducible to the last bit in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfolio.params import Universe

SMOOTH_ROWS = 20

TYPES = Universe("types", ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"), bond="STANDARD", benchmark="ECONOMY",
                 labels={"ECONOMY": "benchmark basket", "STANDARD": "bond leg"})
TYPES_TWO_TIER = Universe("types", ("ECONOMY", "LARGE", "MEDIUM", "PROMO"), bond="STANDARD", benchmark="ECONOMY", cash="SMALL")
RETURNED = Universe("returned", TYPES.pool, bond="STANDARD", benchmark="ECONOMY")
KEPT = Universe("kept", TYPES.pool, bond="STANDARD", benchmark="ECONOMY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_days(spark: SparkSession, sf_dir: str, asset: str | Column = "p_type", universe: Column | None = None) -> DataFrame:
    """Daily totals: universe, asset, dt, cents, qty, high, low.

    A hot part key is split by the skew join and collapsed by the map-side aggregate, so the exchange carries one row
    per (task, asset, day) at most.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    unit = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    asset = F.col(asset) if isinstance(asset, str) else asset
    universe = F.lit("types") if universe is None else universe
    return (lines.filter(F.col("l_quantity") > 0).join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(universe.alias("universe"), asset.alias("asset"), F.to_date("l_shipdate").alias("dt"))
            .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
                 F.sum(F.col("l_quantity").cast("long")).alias("qty"),
                 F.max(unit).alias("high"), F.min(unit).alias("low")))


def test_prices(spark: SparkSession, sf_dir: str, asset: str | Column = "p_type", universe: Column | None = None,
                smooth: int = SMOOTH_ROWS) -> DataFrame:
    """prices(universe, asset, dt, close, high, low, volume)."""
    w = Window.partitionBy("universe", "asset").orderBy("dt").rowsBetween(-(smooth - 1), 0)
    close = F.sum("cents").over(w).cast("double") / F.sum("qty").over(w).cast("double") / 100.0
    return asset_days(spark, sf_dir, asset, universe).select(
        "universe", "asset", "dt", close.alias("close"), "high", "low", F.col("qty").alias("volume"))


def with_preclose(prices: DataFrame) -> DataFrame:
    """pre_close = previous close, cut by a fifth on fixed rule dates (the first price row of each quarter)."""
    w = Window.partitionBy("universe", "asset").orderBy("dt")
    before = F.lag("close").over(w)
    new_quarter = F.trunc("dt", "quarter") != F.trunc(F.lag("dt").over(w), "quarter")
    return prices.withColumn("pre_close", F.when(new_quarter, before * 0.8).otherwise(before))
