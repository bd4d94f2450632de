"""Reports, curves, account state and the monthly gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio.session import stage


def write_report(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "run_id", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def curves(rolled: DataFrame, values: tuple[str, ...] = ("nav", "underwater", "roll_sharpe")) -> DataFrame:
    """The series behind the charts in long form: universe, run_id, dt, curve, value."""
    return rolled.unpivot(["universe", "run_id", "dt"], list(values), "curve", "value").filter("value is not null")


def write_curves(rolled: DataFrame, path: str) -> None:
    curves(rolled).write.mode("overwrite").partitionBy("curve").parquet(path)


STATE_SCHEMA = "acct string, as_of date, cash double, positions map<string,bigint>"


def write_account_state(state: DataFrame, path: str) -> None:
    """One JSON row per account: cash and its positions."""
    state.write.mode("append").json(path)


def read_account_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accounts, positions) of each account's latest state; empty positions vanish."""
    raw = spark.read.schema(STATE_SCHEMA).json(path)
    last = raw.groupBy("acct").agg(F.max_by(F.struct("as_of", "cash", "positions"), "as_of").alias("s")).select("acct", "s.*")
    held = last.select("acct", F.explode("positions").alias("asset", "shares")).filter("shares > 0")
    return last.select("acct", "as_of", "cash"), held


def month_gate(days: DataFrame, done: DataFrame) -> DataFrame:
    """(acct, dt) rows whose month has not been closed yet. ``done``: acct, month 'yyyy-MM'."""
    return (days.withColumn("month", F.date_format("dt", "yyyy-MM"))
            .join(done.select("acct", "month").distinct(), ["acct", "month"], "left_anti"))


CONTROL = "acct bigint, month string"


def closed_months(spark: SparkSession, control: str) -> DataFrame:
    """The control table: every (acct, month) that some attempt closed."""
    return spark.read.schema(f"{CONTROL}, attempt string").parquet(control)


def close_months(done: DataFrame, control: str, attempt: str) -> None:
    """Add the months of ``done`` (acct, month) that no other attempt closed to the control table.

    The rows of an attempt are a partition of its own: what it closed before and what it closes now. So a replay leaves the same
    table, also where ``done`` comes from a gate that already sees the first try. Concurrent attempts write apart; what both
    close counts once for the gate.
    """
    spark = done.sparkSession
    spark.createDataFrame([], CONTROL).write.mode("ignore").parquet(f"{control}/attempt=none")  # a table before its first attempt
    known = closed_months(spark, control)
    mine = done.select(F.col("acct").cast("long").alias("acct"), F.col("month").cast("string").alias("month"))
    mine = mine.unionByName(known.filter(F.col("attempt") == attempt).drop("attempt")).distinct()
    rows = stage(mine.join(known.filter(F.col("attempt") != attempt), ["acct", "month"], "left_anti"), "closed")
    rows.write.mode("overwrite").parquet(f"{control}/attempt={attempt}")
