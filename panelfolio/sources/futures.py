"""Futures contracts: code generation, delivery month and settlement files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio.sources.files import symbol_of_path


def futures_contracts(products: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Contract codes of every product (prefix, exchange) and month: prefix + yyMM + '.' + exchange."""
    months = F.explode(F.sequence(F.lit(first_year * 12), F.lit(last_year * 12 + 11)))
    out = products.select("prefix", "exchange", months.alias("_m"))
    year, month = F.floor(F.col("_m") / 12), F.col("_m") % 12 + 1
    code = F.concat("prefix", F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("."), "exchange")
    return out.select("prefix", "exchange", code.alias("contract"), (year * 100 + month).cast("int").alias("ym"))


def delivery_month(contract: Column) -> Column:
    """yyyyMM parsed from the last four digits before the exchange."""
    digits = F.regexp_extract(contract, r"(\d{4})(?:\..*)?$", 1)
    return (F.lit(200000) + digits.try_cast("int")).cast("int")


def read_settles(spark: SparkSession, folder: str) -> DataFrame:
    """settles(contract, product, ym, dt, settle): one CSV per contract (trade_date, settle) in one scan."""
    raw = spark.read.schema("trade_date string, settle string").csv(folder, header=True)
    return (raw.select(symbol_of_path().alias("contract"), F.to_date("trade_date", "yyyyMMdd").alias("dt"),
                       F.col("settle").try_cast("double").alias("settle"))
            .filter("settle is not null")
            .select("contract", F.regexp_extract("contract", r"^([A-Za-z]+)", 1).alias("product"),
                    delivery_month(F.col("contract")).alias("ym"), "dt", "settle"))
