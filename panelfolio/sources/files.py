"""Delimited files: one symbol per file with varying headers, and localized bar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted close headers and localized bar headers.
CLOSE_NAMES = ("close", "adj close", "adjusted")
BAR_HEADERS = {"日期": "dt", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume"}


# A file <symbol>.csv, a folder of that name that Spark wrote, or a partition folder of it.
SYMBOL = r"(?:=|/)([^/=]+)\.csv(?:/[^/]*)?$"


def symbol_of_path():
    return F.regexp_extract("_metadata.file_path", SYMBOL, 1)


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """(file, asset, cells): every line of every file, split at commas outside quotes. Lines are data, so files need not agree on columns."""
    line = F.regexp_replace("value", "[\\r\ufeff]", "")
    cells = F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    return spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), symbol_of_path().alias("asset"), cells.alias("cells")).filter("asset <> ''")


def _cell(at: str):
    return F.get("cells", F.col(at).cast("int") - 1)


def read_price_csv(spark: SparkSession, folder: str, universe: str) -> DataFrame:
    """All ``<symbol>.csv`` files of a folder in one scan; header names match case-insensitively, per file.

    Files may order their columns differently and have any number of them, so headers are data here: lines are split into
    cells (a quoted cell may hold commas), and one small row per file is joined back on it.
    """
    raw = _cells(spark, folder)
    names = F.transform("cells", lambda c: F.lower(F.trim(c)))
    is_header = F.array_contains(names, "date")
    close_at = F.array_position(F.transform(names, lambda c: F.coalesce(c.isin(*CLOSE_NAMES), F.lit(False))), F.lit(True))
    headers = raw.filter(is_header).groupBy("asset").agg(
        F.max(F.array_position(names, F.lit("date"))).alias("date_at"), F.max(close_at).alias("close_at"))
    rows = raw.filter(~F.coalesce(is_header, F.lit(False))).join(headers.filter("close_at > 0"), "asset")
    return rows.select(F.lit(universe).alias("universe"), "asset", _cell("date_at").try_cast("date").alias("dt"),
                       _cell("close_at").try_cast("double").alias("close")).filter("dt is not null")


def read_bars_localized(spark: SparkSession, folder: str, names: dict[str, str] | None = None) -> DataFrame:
    """Bar files ``<symbol>.csv`` with localized headers as (asset, dt, open, high, low, close, volume).

    Every file is mapped by its own header, wherever that stands and in whatever order it names the columns; ``names`` maps headers to
    fields. Rows that miss any of the fields drop out, and so does a file that has no such column or no header.
    """
    mapped = names or BAR_HEADERS
    fields = list(dict.fromkeys(mapped.values()))
    raw = _cells(spark, folder)
    is_header = F.exists("cells", lambda c: F.trim(c).isin(*[h for h, f in mapped.items() if f == "dt"]))
    place = lambda f: F.greatest(*[F.array_position("cells", F.lit(h)) for h, g in mapped.items() if g == f], F.lit(0))
    headers = raw.filter(is_header).groupBy("file").agg(*[F.max(place(f)).alias(f"{f}_at") for f in fields])
    rows = raw.filter(~F.coalesce(is_header, F.lit(False))).join(headers, "file")
    values = [_cell("dt_at").try_cast("date").alias("dt") if f == "dt" else _cell(f"{f}_at").try_cast("double").alias(f) for f in fields]
    return rows.select("asset", *values).dropna("any", subset=fields)
