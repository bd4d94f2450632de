"""Orders, ledgers and monitors over customers as accounts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.operators import tradeops as O
from panelfolio.queries.common import query, rounded
from panelfolio.session import shared_dir, stage
from panelfolio.streaming import monitors as SM

# Model weights every account follows; LARGE is left out and GHOST has no price.
MODEL = [("ECONOMY", 0.30), ("MEDIUM", 0.25), ("PROMO", 0.10), ("SMALL", 0.15), ("STANDARD", 0.15), ("GHOST", 0.05)]
# Line numbers repeat within an order, so the value breaks ties in the fill order.
FILL_ORDER = ("line_no", "part", "shares", "price", "side")
FLAGS = [("PROMO", True, False), ("LARGE", False, True)]


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as fills: returned lines sell, others buy; hundredths of the unit price.

    Orders are hashed, so that a task holds its share of them and no sorted copy of its lines.
    """
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
    parts = T.table(spark, sf, "part").select("p_partkey", "p_type")
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("acct"), F.col("p_type").alias("asset"), F.to_date("l_shipdate").alias("dt"),
                    (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), F.col("l_partkey").alias("part"),
                    F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
                    (F.col("l_quantity") * 100).cast("long").alias("shares"),
                    (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)) / 100).alias("price"), "l_quantity", "l_extendedprice"))


def numbered_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing but the columns of a ledger: key, date and ``FILL_ORDER``."""
    return fills(spark, sf).select("acct", "asset", "dt", *FILL_ORDER)


def last_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Last smoothed close per asset, in hundredths."""
    return T.test_prices(spark, sf).groupBy("asset").agg((F.max_by("close", "dt") / 100).alias("price"))


def book(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(targets, positions, prices, accounts) staged: every account follows the model."""
    net = F.sum(F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares")))
    positions = stage(fills(spark, sf).groupBy("acct", "asset").agg(net.alias("shares")).filter("shares > 0"), "positions")
    prices = stage(last_prices(spark, sf), "prices")
    customers = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("acct"), (F.col("c_acctbal") + 1000).alias("cash")).filter("cash > 0")
    accounts = O.account_value(customers, positions, prices)
    model = F.inline(F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(w).alias("weight")) for a, w in MODEL]))
    accounts = stage(accounts, "accounts")
    positions = positions.join(accounts.select("acct"), "acct", "left_semi")
    return accounts.select("acct", model), positions, prices, accounts


def flags(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(FLAGS, "asset string, cant_buy boolean, cant_sell boolean"))


@query
def account_value(spark: SparkSession, sf: str) -> DataFrame:
    """Value per account, capped."""
    return rounded(O.equity_cap(book(spark, sf)[3], 2_000_000.0))


@query
def orders(spark: SparkSession, sf: str) -> DataFrame:
    targets, positions, prices, accounts = book(spark, sf)
    out = O.order_sequence(O.build_orders(targets, positions, prices, accounts, O.BAND, flags(spark)))
    return rounded(out.select("acct", "asset", "side", "shares", "seq"))


@query
def orders_cash_cap(spark: SparkSession, sf: str) -> DataFrame:
    targets, positions, prices, accounts = book(spark, sf)
    drafted = stage(O.build_orders(targets, positions, prices, accounts, O.BAND, flags(spark)), "orders")
    return O.cash_cap(drafted, positions, prices, accounts).select("acct", "asset", "side", "shares", "filled", "cut")


@query
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    out = O.reconcile(*book(spark, sf))
    return rounded(out.select("acct", "asset", "target", "actual", "deviation", "flagged"))


@query
def month_done(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation summary per account and whether its month may close (wide threshold on this data).

    Staged: summary and gate read the deviations, and no task both joins and sums them up.
    """
    r = stage(O.reconcile(*book(spark, sf)).select("acct", "asset", "deviation", "flagged"), "deviations")
    done = O.month_done(r, "2001-11", 0.45).withColumn("done", F.lit(True))
    return rounded(O.max_deviation(r).join(done, "acct", "left").na.fill(False, ["done"]).drop("month"))


@query
def price_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Retail price as the quote of each part against its last traded unit price, with whether the move is large enough to act on."""
    lines = T.table(spark, sf, "lineitem").filter("l_quantity > 0")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    close = lines.groupBy(F.col("l_partkey").alias("asset")).agg(F.max_by(unit, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).alias("close"))
    quotes = T.table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.col("p_retailprice").alias("quote"))
    drift = O.price_drift(quotes, close, threshold=0.0)
    return rounded(drift.select("asset", "price", "drift", (F.abs("drift") >= O.DRIFT).alias("acts")))


@query
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Position after every fill with sales clipped to the holding."""
    out = O.ledger(numbered_fills(spark, sf), order=FILL_ORDER)
    return rounded(out.select("acct", "asset", "dt", "line_no", "part", "side", "shares", "before", "after", "cash_flow"), 3)


@query
def ledger_balances(spark: SparkSession, sf: str) -> DataFrame:
    """Cash and number of open positions per account after all fills."""
    booked = O.ledger(numbered_fills(spark, sf), order=FILL_ORDER)
    opening = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("acct"), F.lit(1e7).alias("cash"))
    cash, held = O.balances(booked, opening, order=FILL_ORDER)
    n = held.groupBy("acct").agg(F.count(F.lit(1)).alias("n_positions"), F.sum("shares").alias("shares"))
    return rounded(cash.join(n, "acct", "left").na.fill(0, ["n_positions", "shares"]), 2)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "events")


def order_rows(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("acct"),
                                                      F.col("ts").cast("timestamp").alias("ts"), F.ceil("value").cast("long").alias("shares"))


def fill_rows(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'click'").select(F.col("user_id").alias("acct"), F.col("ts").cast("timestamp").alias("ts"), F.ceil(F.col("value") * 2).cast("long").alias("shares"))


@query
def fill_check(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered against filled per user; clicks carry the strategy's tag, views another one."""
    e = events(spark, sf)
    tag = F.when(F.col("event_type") == "click", "rotation").otherwise("other")
    asset = F.lit("EV").alias("asset")
    fills_ = e.filter("event_type in ('click', 'view')").select(F.col("user_id").alias("acct"), asset, "ts", tag.alias("tag"), F.ceil(F.col("value") * 2).cast("long").alias("shares"))
    return O.fill_completeness(order_rows(e).withColumn("asset", asset), fills_, "rotation", "2024-01-05 00:00:00")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return (spark.readStream.schema(events(spark, sf).schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query
def fill_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Stream of purchases and the clicks of the same user within two hours; each comes out once, at its own limit or at the end of the input."""
    at = scratch(spark, "fills")
    e = event_stream(spark, sf)
    SM.mark_end(spark, f"{at}/ends")  # the table is complete and read in one batch
    stream = SM.released_orders(SM.order_events(order_rows(e), fill_rows(e), SM.end_marks(spark, f"{at}/ends")), "2 hours")
    SM.run_released(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(SM.RELEASED).parquet(f"{at}/out").select("order_id", "acct", "ordered", "filled", "complete")


@query
def fill_stream_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a join of two streams, whose last orders wait for a watermark that never comes and are added after the run."""
    at = scratch(spark, "fills")
    e = event_stream(spark, sf)
    matched = SM.unfilled_orders(order_rows(e), fill_rows(e), "2 hours")
    SM.run_to_table(matched, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    schema = "order_id bigint, acct bigint, order_ts timestamp, ordered bigint, fill_ts timestamp, filled bigint"
    sink = spark.read.schema(schema).parquet(f"{at}/out")
    return SM.completeness(SM.with_waiting(sink, order_rows(events(spark, sf)))).select("order_id", "acct", "ordered", "filled", "complete")


@query
def drift_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Latest streamed value per user against the user's mean value."""
    at = scratch(spark, "drift")
    quotes = event_stream(spark, sf).select(F.col("user_id").alias("asset"), F.col("value").alias("quote"), F.col("ts").cast("timestamp").alias("ts"))
    run = SM.drift_monitor(quotes, f"{at}/state", f"{at}/checkpoint")
    run.awaitTermination()
    latest = SM.latest_quotes(spark, f"{at}/state")
    closes = events(spark, sf).groupBy(F.col("user_id").alias("asset")).agg(F.avg("value").alias("close"))
    return rounded(SM.drift_alerts(latest, closes).drop("ts"))
