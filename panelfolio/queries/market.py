"""Sources and panel preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio import testpanel as T
from panelfolio.functions import scalars as S
from panelfolio.operators import panel as P
from panelfolio.params import universe_dim
from panelfolio.queries.common import ANCHORS, market, prices, query, rounded
from panelfolio.sources import config, futures, merge, sinks, vendor

# Narrow limits for two test assets so that limit days occur.
TEST_LIMITS = [("PROMO", 0.02), ("SMALL", 0.03)]


def limited(spark: SparkSession, px: DataFrame) -> DataFrame:
    return P.with_limit_pct(px, spark.createDataFrame(TEST_LIMITS, "asset string, table_pct double"))


@query
def vendor_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads built per asset and month, decoded back; pre_close is derived."""
    return rounded(vendor.decode_payloads(vendor.encode_payloads(T.test_prices(spark, sf))))


@query
def coalesced_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Primary = returned lines without two assets; the critical one of them is filled from the other lines."""
    by = T.test_prices(spark, sf, universe=F.when(F.col("l_returnflag") == "R", "primary").otherwise("backup"))
    rows = lambda u: by.filter(F.col("universe") == u).withColumn("universe", F.lit("types"))
    primary = rows("primary").filter(~F.col("asset").isin("STANDARD", "SMALL"))
    out = merge.coalesce_sources(primary, rows("backup"), [T.TYPES.benchmark, T.TYPES.bond])
    return rounded(out.groupBy("universe", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.avg("close").alias("mean_close")))


@query
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources by return flag; later ones replace earlier ones per symbol."""
    by = T.test_prices(spark, sf, universe=F.col("l_returnflag"))
    rows = lambda u, keep: by.filter((F.col("universe") == u) & F.col("asset").isin(*keep)).withColumn("universe", F.lit("types"))
    out = merge.merge_sources([rows("A", T.TYPES.pool), rows("N", ("LARGE", "MEDIUM")), rows("R", ("MEDIUM", "STANDARD"))])
    return rounded(out.groupBy("universe", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.max("dt").alias("last_dt"), F.avg("close").alias("mean_close")))


@query
def topped_up_closes(spark: SparkSession, sf: str) -> DataFrame:
    by = T.test_prices(spark, sf, universe=F.col("l_returnflag"))
    rows = lambda u: by.filter(F.col("universe") == u).withColumn("universe", F.lit("types"))
    out = merge.top_up(rows("A").filter("asset <> 'STANDARD'"), rows("N"), 126)
    return rounded(out.select("universe", "asset", "dt", "close"))


@query
def config_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Switch documents built from order status: real booleans, strings and absent keys."""
    orders = T.table(spark, sf, "orders")
    doc = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"hold_all": '), (F.col("o_totalprice") > 100000).cast("string"), F.lit("}")))
           .when(F.col("o_orderstatus") == "O", F.lit('{"hold_all": "false"}')).otherwise(F.lit("{}")))
    return orders.select("o_orderstatus", config.strict_flag(doc, "hold_all", True).alias("hold_all")).groupBy(
        "o_orderstatus", "hold_all").agg(F.count(F.lit(1)).alias("n"))


@query
def month_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' order days in months not yet closed by a finished order."""
    orders = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("acct"), F.to_date("o_orderdate").alias("dt"), "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'").select("acct", F.date_format("dt", "yyyy-MM").alias("month"))
    return sinks.month_gate(orders.select("acct", "dt"), done).groupBy("month").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_distinct("acct").alias("n_accts"))


@query
def filled_panel(spark: SparkSession, sf: str) -> DataFrame:
    px = prices(spark, sf)
    return rounded(P.fill_forward(px, P.trading_calendar(px), 3))


@query
def filled_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    px = prices(spark, sf)
    out = P.fill_forward(px, P.trading_calendar(px), None)
    return rounded(out.groupBy("universe", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_filled").alias("n_filled"), F.avg("close").alias("mean_close")))


@query
def aligned_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.prepare_panel(prices(spark, sf), limit=0)
    return rounded(P.drop_empty_dates(P.align_panel(panel)))


@query
def anchored_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(panel.obs.groupBy("universe", "asset").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
        F.max("n_rows").alias("n_rows"), F.max("n_reb").alias("n_reb"), F.avg("close").alias("mean_close")))


@query
def not_listed_by_start(spark: SparkSession, sf: str) -> DataFrame:
    """Brands without a price on the first date that both anchor brands have one."""
    px = T.test_prices(spark, sf, asset="p_brand")
    pool = px.select("universe", "asset").distinct()
    return P.not_listed_by_start(px, pool, ["Brand#1", "Brand#2"])


@query
def adjusted_prices(spark: SparkSession, sf: str) -> DataFrame:
    out = P.adjust_prices(T.with_preclose(T.test_prices(spark, sf)))
    return rounded(out.select("universe", "asset", "dt", "factor", "adj_close"))


@query
def adjustment_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.adjustment_audit(P.adjust_prices(T.with_preclose(T.test_prices(spark, sf)))))


@query
def limit_flags(spark: SparkSession, sf: str) -> DataFrame:
    px = limited(spark, T.with_preclose(T.test_prices(spark, sf)))
    return rounded(P.limit_flags(px).select(
        "universe", "asset", "dt", "close", "pre_close", "limit_pct", "cant_buy", "cant_sell"))


@query
def limit_flags_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Backup path: pre_close from the previous row, then the same rule."""
    px = limited(spark, P.derive_preclose(T.test_prices(spark, sf)))
    return P.limit_flags(px).groupBy("universe", "asset").agg(
        F.count_if("cant_buy").alias("n_buy"), F.count_if("cant_sell").alias("n_sell"))


@query
def limit_flags_approx(spark: SparkSession, sf: str) -> DataFrame:
    px = P.limit_flags_approx(limited(spark, T.test_prices(spark, sf)))
    return rounded(px.select("universe", "asset", "dt", "move", "cant_buy", "cant_sell"))


@query
def quality_guard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.quality_guard(limited(spark, T.test_prices(spark, sf))))


@query
def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Both gap policies on the unfilled panel."""
    panel = P.prepare_panel(prices(spark, sf), limit=0, staged=True)
    pad = P.daily_returns(panel, "pad").select("universe", "asset", "dt", F.col("ret").alias("ret_pad"))
    drop = P.daily_returns(panel, "drop").select("universe", "asset", "dt", F.col("ret").alias("ret_drop"))
    return rounded(pad.join(drop, ["universe", "asset", "dt"]))


@query
def month_ends(spark: SparkSession, sf: str) -> DataFrame:
    return P.month_end_calendar(P.trading_calendar(T.asset_days(spark, sf)), 126)


@query
def month_end_days(spark: SparkSession, sf: str) -> DataFrame:
    """Is each order date the last trading day of its month in the shipping calendar?"""
    calendar = T.asset_days(spark, sf).select("universe", "dt")
    days = T.table(spark, sf, "orders").select(F.lit("types").alias("universe"), F.to_date("o_orderdate").alias("dt")).distinct()
    return P.is_month_end_trading_day(days, calendar)


@query
def near_trading_days(spark: SparkSession, sf: str) -> DataFrame:
    """Last shipping day at or before each order date; no day and row -1 before the first one."""
    calendar = P.trading_calendar(T.asset_days(spark, sf))
    targets = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select(
        F.lit("types").alias("universe"), F.col("d").cast("string").alias("target_id"), F.col("d").cast("timestamp").alias("target_ts"))
    return P.as_of_dates(targets, calendar).select(
        "universe", "target_id", "as_of_dt", F.coalesce("as_of_row", F.lit(-1)).alias("as_of_row"))


@query
def long_history_assets(spark: SparkSession, sf: str) -> DataFrame:
    px = T.test_prices(spark, sf, asset="p_brand")
    kept = P.min_history(px, 750, "1995-01-06")
    return rounded(kept.groupBy("universe", "asset").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"), F.avg("close").alias("mean_close")))


@query
def symbol_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange suffix and daily limit of a code derived from every part key."""
    code = F.lpad((F.col("p_partkey") * 7919 % 700000 + 100000).cast("string"), 6, "0")
    codes = T.table(spark, sf, "part").select("p_partkey", code.alias("asset"), F.lit("codes").alias("universe"))
    return P.with_limit_pct(codes).select("p_partkey", S.market_suffix(F.col("asset")).alias("symbol"), "limit_pct")


@query
def asset_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "part").select(F.lit("types").alias("universe"), F.col("p_type").alias("asset"))
    out = P.label(rows, universe_dim(spark, [T.TYPES]))
    return out.groupBy("asset", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def factor_series(spark: SparkSession, sf: str) -> DataFrame:
    panel = market(spark, sf)
    return rounded(P.factor_returns(P.daily_returns(panel), panel.calendar, FACTORS))


FACTORS = [("MKT", "ECONOMY", None), ("SIZE", "SMALL", "ECONOMY"), ("BOND", "STANDARD", None), ("GONE", "NOWHERE", None)]


@query
def contract_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Contract codes of each brand number and exchange region, with the delivery month parsed back."""
    products = T.table(spark, sf, "part").select(F.upper(F.substring("p_type", 1, 2)).alias("prefix")).distinct().withColumn("exchange", F.lit("XCH"))
    codes = futures.futures_contracts(products, 1995, 2001)
    return codes.select("contract", "ym", (futures.delivery_month(F.col("contract")) % 10000).alias("yymm"))
