"""Files and sinks: tables derived from the given ones land in the shared folder and are read back by the sources."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import panel as P
from panelfolio.operators import weights as A
from panelfolio.params import ParamSet, universe_dim
from panelfolio.plans.strategies import PythonStrategy
from panelfolio.queries.common import ANCHORS, market, query, rounded
from panelfolio.session import shared_dir, stage
from panelfolio.sources import files, futures, sinks, vendor

FILLERS = 38  # columns before the two that count, in the wide files
RISK = [ParamSet("risk", risk_adj=True, trend_ma=200), ParamSet("risk_top", risk_adj=True, hold_all=False, top_n=4)]


def landing(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query
def vendor_files(spark: SparkSession, sf: str) -> DataFrame:
    at = landing(spark, "vendor")
    vendor.encode_payloads(T.with_preclose(T.test_prices(spark, sf)), with_preclose=True).write.json(at)
    return rounded(vendor.read_vendor_json(spark, at))


@query
def price_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per symbol; some are narrow, some have their date and close behind many other columns."""
    at = landing(spark, "csv")
    px = T.test_prices(spark, sf)
    narrow = F.col("asset").isin("ECONOMY", "LARGE")
    day, close, name = F.col("dt").cast("string"), F.col("close").cast("string"), F.concat("asset", F.lit(".csv")).alias("file")
    line = F.when(narrow, F.concat_ws(",", day, F.lit("1"), close)).otherwise(F.concat_ws(",", F.lit('"a,b"' + ",x" * (FILLERS - 1)), close, day))
    head = F.when(narrow, "Date,Open,Adj Close").otherwise(",".join(f"f{i}" for i in range(FILLERS)) + ",CLOSE,date")
    lines = px.select(name, line.alias("value")).unionByName(px.select("asset").distinct().select(name, head.alias("value")))
    lines.write.partitionBy("file").text(at)
    return rounded(files.read_price_csv(spark, at, "types"))


@query
def localized_bar_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per asset with localized headers, in one column order for some assets and in another for the rest; rows without a close are dropped."""
    at = landing(spark, "bars")
    bars = T.test_prices(spark, sf)
    close = F.when(F.dayofmonth("dt") % 7 != 0, F.col("close"))
    values = {"dt": F.col("dt"), "open": F.col("low"), "close": close, "high": F.col("high"), "low": F.col("low"), "volume": F.col("volume")}
    some = F.col("asset").isin("ECONOMY", "LARGE")
    for mine, order in ((some, list(files.BAR_HEADERS.items())), (~some, list(files.BAR_HEADERS.items())[::-1])):
        rows = bars.filter(mine).select(F.concat("asset", F.lit(".csv")).alias("file"), *[values[v].alias(k) for k, v in order])
        rows.write.mode("append").partitionBy("file").option("header", True).csv(at)
    return rounded(files.read_bars_localized(spark, at), 8)  # prices per unit end within eight places or never


@query
def settle_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per contract: a product's closes of a month settle the contract that delivers the month after."""
    at = landing(spark, "settles")
    name = F.concat(F.substring("asset", 1, 2), F.date_format(F.add_months("dt", 1), "yyMM"), F.lit(".SHF.csv")).alias("file")
    rows = T.test_prices(spark, sf).select(name, F.date_format("dt", "yyyyMMdd").alias("trade_date"), F.col("close").alias("settle"))
    rows.write.partitionBy("file").option("header", True).csv(at)
    return rounded(futures.read_settles(spark, at))


@query
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    at = landing(spark, "report")
    rows = T.test_prices(spark, sf).groupBy("universe", F.col("asset").alias("run_id")).agg(F.count(F.lit(1)).alias("days"), F.avg("close").alias("mean_close"))
    sinks.write_report(rows, at)
    return rounded(spark.read.parquet(at).select("universe", "run_id", "days", "mean_close"))


@query
def curve_files(spark: SparkSession, sf: str) -> DataFrame:
    """Value, drawdown and rolling mean return of each asset as long curves."""
    at = landing(spark, "curves")
    w = Window.partitionBy("universe", "asset").orderBy("dt")
    px = T.test_prices(spark, sf).withColumn("nav", F.col("close") / F.first("close").over(w))
    px = px.withColumn("underwater", F.col("nav") / F.max("nav").over(w) - 1).withColumn("ret", F.col("nav") / F.lag("nav").over(w) - 1)
    near = w.rowsBetween(-19, 0)
    rolled = px.withColumn("roll_sharpe", F.when(F.count("ret").over(near) == 20, F.avg("ret").over(near)))
    sinks.write_curves(rolled.select("universe", F.col("asset").alias("run_id"), "dt", "nav", "underwater", "roll_sharpe"), at)
    return rounded(spark.read.parquet(at).select("universe", "run_id", "dt", "curve", "value"))


@query
def account_state_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every account's state at the ends of its years, appended year by year; the latest one is read."""
    at = landing(spark, "state")
    lines = T.table(spark, sf, "orders").join(T.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    held = F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("long")
    by_flag = lines.groupBy(F.col("o_custkey").cast("string").alias("acct"), F.year("o_orderdate").alias("y"), "l_returnflag").agg(
        held.alias("shares"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    state = by_flag.groupBy("acct", F.make_date("y", F.lit(12), F.lit(31)).alias("as_of")).agg(
        (F.sum("cents") / 100.0).alias("cash"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", "shares"))).alias("positions"))
    sinks.write_account_state(state, at)
    last, open_ = sinks.read_account_state(spark, at)
    return rounded(last.join(open_, "acct", "left").na.fill(0, ["shares"]), 2)


@query
def python_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Any Python per decision: equal weights for assets above the mean of their whole past."""

    def above_mean(closes: pd.DataFrame) -> pd.DataFrame:
        g = closes.groupby("asset")["close"].mean()
        now = closes[closes["k"] == 0].set_index("asset")["close"]
        up = sorted(now.index[now > g.loc[now.index]])
        return pd.DataFrame({"asset": up, "weight": [1.0 / max(len(up), 1)] * len(up)})

    return rounded(PythonStrategy(above_mean, T.TYPES.pool).targets(market(spark, sf), universe_dim(spark, [T.TYPES])))


@query
def suspended_asset(spark: SparkSession, sf: str) -> DataFrame:
    """Risk-adjusted momentum while one asset is suspended: a flat price has no volatility, so it is no candidate."""
    halted = (F.col("asset") == "SMALL") & (F.col("dt") >= "1997-01-01")
    px = stage(T.test_prices(spark, sf).withColumn("close", F.when(halted, F.lit(100.0)).otherwise(F.col("close"))), "prices")
    return rounded(A.decide_targets(P.prepare_panel(px, anchors=ANCHORS, staged=True), universe_dim(spark, [T.TYPES]), RISK))


@query
def month_close(spark: SparkSession, sf: str) -> DataFrame:
    """Gate, close, replay of the close, gate, close of old months, gate: order days of customers in months still open."""
    control = landing(spark, "control")
    orders = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("acct"), F.to_date("o_orderdate").alias("dt"), "o_orderstatus")
    month = F.date_format("dt", "yyyy-MM").alias("month")
    finished = orders.filter("o_orderstatus = 'F'").select("acct", month)
    for attempt in ("1", "1"):
        sinks.close_months(finished, control, attempt)
    still_open = sinks.month_gate(orders.select("acct", "dt"), sinks.closed_months(spark, control))
    sinks.close_months(still_open.filter("month < '1997-01'").select("acct", "month"), control, "2")
    return sinks.month_gate(orders.select("acct", "dt"), sinks.closed_months(spark, control)).select("acct", "dt", "month")
