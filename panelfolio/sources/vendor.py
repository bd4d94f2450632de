"""Vendor payload files: ``{fields: [...], items: [[...], ...]}`` with positional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio.operators.panel import asset_window

PAYLOAD_SCHEMA = "universe string, asset string, fields array<string>, items array<array<string>>"


def read_vendor_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files (one JSON object per line) as price rows."""
    return decode_payloads(spark.read.schema(PAYLOAD_SCHEMA).json(path))


def field(name: str) -> Column:
    """Value of a named field of one item; null when the payload does not carry it."""
    return F.get("item", F.array_position("fields", F.lit(name)).cast("int") - 1)


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """prices(universe, asset, dt, close, pre_close); a missing pre_close becomes the previous close."""
    rows = payloads.select("universe", "asset", "fields", F.explode("items").alias("item")).select(
        "universe", "asset", F.to_date(field("trade_date"), "yyyyMMdd").alias("dt"),
        field("close").try_cast("double").alias("close"), field("pre_close").try_cast("double").alias("pre_close"))
    return rows.withColumn("pre_close", F.coalesce("pre_close", F.lag("close").over(asset_window())))


def encode_payloads(prices: DataFrame, with_preclose: bool = False) -> DataFrame:
    """Price rows as payloads, one per asset and month (bounded by the days of a month)."""
    columns = ["trade_date", "close"] + (["pre_close"] if with_preclose else [])
    values = {"trade_date": F.date_format("dt", "yyyyMMdd"), "close": F.col("close").cast("string")}
    if with_preclose:
        values["pre_close"] = F.col("pre_close").cast("string")
    item = F.array(*[values[c] for c in columns])
    return (prices.groupBy("universe", "asset", F.trunc("dt", "month").alias("month"))
            .agg(F.collect_list(item).alias("items"))
            .select("universe", "asset", F.array(*[F.lit(c) for c in columns]).alias("fields"), "items"))
