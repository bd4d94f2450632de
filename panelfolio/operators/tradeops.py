"""Orders, reconciliation and ledgers over many accounts.

Positions, targets and orders hold one row per (acct, asset), so an account's rows are bounded by the assets listed; the
raw fills behind them are not, and ledgers therefore scan them in time chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.params import COMMISSION, LOT, SLIPPAGE
from panelfolio.session import stage

LINE = ("acct", "asset")
CASH = "__cash__"
BAND = 0.05
DEVIATION = 0.10
DRIFT = 0.0005
UNDATED = -(2**31)


def equity_cap(accounts: DataFrame, cap: float) -> DataFrame:
    return accounts.withColumn("total", F.least("total", F.lit(float(cap))))


def account_value(cash: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """accounts(acct, cash, total): cash plus priced positions; an unpriced position counts 0."""
    held = positions.join(prices.select("asset", "price"), "asset", "left").groupBy("acct").agg(
        F.sum(F.col("shares") * F.coalesce("price", F.lit(0.0))).alias("_mv"))
    return cash.join(held, "acct", "left").select("acct", "cash", (F.col("cash") + F.coalesce("_mv", F.lit(0.0))).alias("total"))


def build_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, accounts: DataFrame, band: float = BAND,
                 flags: DataFrame | None = None) -> DataFrame:
    """orders(acct, asset, side, shares, price, notional) before the cash cap.

    Whole lots, a quiet band for assets held before and after, blocked sides skipped. ``flags``: asset, cant_buy, cant_sell.
    """
    both = targets.select(*LINE, "weight").join(positions.select(*LINE, "shares"), list(LINE), "full")
    df = both.join(prices.select("asset", "price"), "asset", "left").join(accounts.select("acct", "total"), "acct")
    if flags is not None:
        df = df.join(flags.select("asset", "cant_buy", "cant_sell"), "asset", "left")
    else:
        df = df.withColumns({"cant_buy": F.lit(False), "cant_sell": F.lit(False)})
    df = df.na.fill(False, ["cant_buy", "cant_sell"]).withColumns({
        "held": F.coalesce("shares", F.lit(0)), "px": F.coalesce("price", F.lit(0.0))})
    want = F.when((F.col("px") > 0) & F.col("weight").isNotNull(), S.whole_lots(F.col("total") * F.col("weight") / F.nullif(F.col("px"), F.lit(0.0)), LOT))
    df = df.withColumn("want", F.coalesce(want, F.lit(0)))
    quiet = ((F.col("held") > 0) & (F.col("want") > 0) & (F.col("px") > 0)
             & (F.abs(F.col("want") - F.col("held")) * F.col("px") < band * F.col("total")))
    sell = F.col("want") < F.col("held")
    blocked = F.when(sell, F.col("cant_sell")).otherwise(F.col("cant_buy"))
    out = df.filter((F.col("want") != F.col("held")) & ~quiet & ~blocked)
    shares = F.abs(F.col("want") - F.col("held"))
    return out.select(*LINE, F.when(sell, "SELL").otherwise("BUY").alias("side"), shares.alias("shares"),
                      F.col("px").alias("price"), (shares * F.col("px")).alias("notional"))


def order_sequence(orders: DataFrame) -> DataFrame:
    """``seq``: sells before buys, buys by notional descending, then asset."""
    sells_first = F.when(F.col("side") == "SELL", 0).otherwise(1)
    size = F.when(F.col("side") == "BUY", -F.col("notional")).otherwise(F.lit(0.0))
    return orders.withColumn("seq", F.row_number().over(Window.partitionBy("acct").orderBy(sells_first, size, "asset")))


def cash_cap(orders: DataFrame, positions: DataFrame, prices: DataFrame, accounts: DataFrame) -> DataFrame:
    """Cut buys to the cash at hand: adds ``filled`` and ``cut``; sells pass.

    Each cut changes what is left for the next buy, so an account folds over its own buys (one per asset at most).
    """
    held = positions.join(prices.select("asset", "price"), "asset", "left").groupBy("acct").agg(
        F.sum(F.col("shares") * F.coalesce("price", F.lit(0.0))).alias("_mv"))
    raised = orders.filter("side = 'SELL'").groupBy("acct").agg(F.sum(F.col("notional") * (1 - SLIPPAGE)).alias("_raised"))
    buys = orders.filter("side = 'BUY' and price > 0").groupBy("acct").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("notional")).alias("k"), "asset", "shares", "price", "notional"))).alias("buys"))
    df = (buys.join(accounts.select("acct", "total"), "acct").join(held, "acct", "left").join(raised, "acct", "left")
          .withColumn("_cash", F.col("total") - F.coalesce("_mv", F.lit(0.0)) + F.coalesce("_raised", F.lit(0.0))))

    def take(acc: Column, b: Column) -> Column:
        unit = b["price"] * (1 + SLIPPAGE)
        n = F.least(b["shares"], S.affordable_lots(acc["cash"], unit, LOT))
        return F.struct((acc["cash"] - n * unit).alias("cash"), F.array_append(acc["got"], n).alias("got"))

    start = F.struct(F.col("_cash").alias("cash"), F.array().cast("array<bigint>").alias("got"))
    got = F.aggregate("buys", start, take, lambda acc: acc["got"])
    cut = df.select("acct", F.explode(F.arrays_zip("buys", got.alias("got"))).alias("z")).select(
        "acct", F.col("z.buys.asset").alias("asset"), F.lit("BUY").alias("side"), F.col("z.buys.shares").alias("shares"),
        F.col("z.buys.price").alias("price"), F.col("z.buys.notional").alias("notional"), F.col("z.got").alias("filled"))
    sells = orders.filter("side = 'SELL'").select(*LINE, "side", "shares", "price", "notional", F.col("shares").alias("filled"))
    return sells.unionByName(cut).withColumn("cut", F.col("filled") < F.col("shares"))


def positions_to_weights(positions: DataFrame, prices: DataFrame, accounts: DataFrame) -> DataFrame:
    """weights(acct, asset, weight) with a residual cash row; accounts without value drop out."""
    live = accounts.filter("total > 0").select("acct", "total")
    w = (positions.join(prices.select("asset", "price"), "asset").filter("price > 0").join(live, "acct")
         .groupBy(*LINE).agg(F.sum(F.col("shares") * F.col("price") / F.col("total")).alias("weight")))
    return w.unionByName(residual_cash(live, w))


def residual_cash(accounts: DataFrame, weights: DataFrame) -> DataFrame:
    used = weights.groupBy("acct").agg(F.sum("weight").alias("_used"))
    return accounts.select("acct").join(used, "acct", "left").select(
        "acct", F.lit(CASH).alias("asset"), F.greatest(1 - F.coalesce("_used", F.lit(0.0)), F.lit(0.0)).alias("weight"))


def reconcile(targets: DataFrame, positions: DataFrame, prices: DataFrame, accounts: DataFrame, threshold: float = DEVIATION) -> DataFrame:
    """Target against actual weight per (acct, asset) with the deviation and its flag."""
    live = accounts.filter("total > 0")
    wanted = targets.select(*LINE, "weight").join(live.select("acct"), "acct", "left_semi")
    wanted = wanted.unionByName(residual_cash(live, wanted)).withColumnRenamed("weight", "target")
    actual = positions_to_weights(positions, prices, accounts).withColumnRenamed("weight", "actual")
    out = wanted.join(actual, list(LINE), "full").na.fill(0.0, ["target", "actual"])
    out = out.withColumn("deviation", F.col("actual") - F.col("target"))
    return out.withColumn("flagged", F.abs("deviation") >= threshold)


def max_deviation(reconciled: DataFrame) -> DataFrame:
    d = F.abs("deviation")
    return reconciled.groupBy("acct").agg(F.max(d).alias("max_deviation"), F.count_if("flagged").alias("n_flagged"),
                                          F.max_by("asset", F.struct(d, "asset")).alias("worst_asset"))


def month_done(reconciled: DataFrame, month: str, threshold: float = DEVIATION) -> DataFrame:
    """Accounts whose month may be closed: post-trade deviation under the threshold."""
    return max_deviation(reconciled).filter(F.col("max_deviation") < threshold).select("acct", F.lit(month).alias("month"))


def price_drift(quotes: DataFrame, closes: DataFrame, threshold: float = DRIFT) -> DataFrame:
    """Quote against reference close (the close where no quote exists), rows at or over the threshold."""
    df = closes.join(quotes.select("asset", "quote"), "asset", "left").withColumn("price", F.coalesce("quote", "close"))
    df = df.withColumn("drift", S.ratio(F.col("price") - F.col("close"), F.col("close")))
    return df.filter(F.abs("drift") >= threshold).select("asset", "close", "price", "drift")


def signed_fills(fills: DataFrame) -> DataFrame:
    """Usable fills with ``delta`` = signed shares; no price or no shares are ignored."""
    return fills.filter("price > 0 and shares > 0").withColumn(
        "delta", F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares")))


def ledger(fills: DataFrame, chunk: str = "month", order: tuple[str, ...] = ("fill_no",)) -> DataFrame:
    """Position path when sales are clipped to what is held: adds ``before``, ``after`` and ``cash_flow`` to each fill.

    Clipping at zero has a closed form: position = running sum - min(0, lowest running sum so far). Sums and lowest sums
    combine, so each (acct, asset) is scanned inside time chunks and the chunk totals are scanned on top; one busy
    account spreads over its chunks. ``order``: columns that order the fills of a date.

    Fills are dealt to their chunks once, for totals and path alike, where ``fills`` has only (acct, asset, dt, side, shares, price)
    and ``order``; a further column makes the totals deal their own, narrower copy. Fills without acct, asset or dt are left out;
    those without dt count as the earliest of their line. A reader sorts its fills once: the totals of a chunk stand in its last fill,
    and the position before a fill comes from the sums up to the fill before it.
    """
    df = signed_fills(fills.filter("acct is not null and asset is not null"))
    # never null, so that the join below adds no filter to one of the two readers of the dealt fills
    df = df.withColumn("_c", F.coalesce(F.unix_date(F.trunc("dt", chunk)), F.lit(UNDATED)))
    inside = Window.partitionBy(*LINE, "_c").orderBy("dt", *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum("delta").over(upto))
    df = df.withColumns({"_m": F.min("_s").over(upto), "_ps": F.lag("_s").over(inside), "_last": F.lead("_s").over(inside).isNull(),
                         "_pm": F.min("_s").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    totals = df.filter("_last").select(*LINE, "_c", F.col("_s").alias("_ts"), F.col("_m").alias("_tm"), F.col("dt").isNotNull().alias("_dated"))
    earlier = Window.partitionBy(*LINE).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_s0", F.coalesce(F.sum("_ts").over(earlier), F.lit(0)))
    totals = totals.withColumn("_low", F.col("_s0") + F.col("_tm"))
    totals = totals.withColumn("_m0", F.least(F.coalesce(F.min("_low").over(earlier), F.lit(0)), F.lit(0)))
    df = df.join(totals.filter("_dated").select(*LINE, "_c", "_s0", "_m0"), [*LINE, "_c"])
    df = df.withColumn("after", F.col("_s0") + F.col("_s") - F.least("_m0", F.col("_s0") + F.col("_m")))
    df = df.withColumn("before", F.coalesce(F.col("_s0") + F.col("_ps") - F.least("_m0", F.col("_s0") + F.col("_pm")), F.col("_s0") - F.col("_m0")))
    moved = F.abs(F.col("after") - F.col("before"))
    buy = -moved * F.col("price") * (1 + SLIPPAGE) * (1 + COMMISSION)
    sale = moved * F.col("price") * (1 - SLIPPAGE) * (1 - COMMISSION)
    return df.withColumn("cash_flow", F.when(F.col("delta") > 0, buy).otherwise(sale)).drop("_c", "_s", "_m", "_ps", "_pm", "_last", "_s0", "_m0")


def closing(booked: DataFrame, order: tuple[str, ...] = ("fill_no",)) -> DataFrame:
    """closing(acct, asset, shares, cash_flow): the last position and the sum of cash flows per line."""
    return booked.groupBy(*LINE).agg(F.max_by("after", F.struct("dt", *order)).alias("shares"), F.sum("cash_flow").alias("cash_flow"))


def balances(booked: DataFrame, opening: DataFrame, order: tuple[str, ...] = ("fill_no",)) -> tuple[DataFrame, DataFrame]:
    """(cash per account, non-zero positions) after all fills. ``opening``: acct, cash.

    Both read one row per line, which is staged; the fills are not.
    """
    lines = stage(closing(booked, order), "closing")
    flows = lines.groupBy("acct").agg(F.sum("cash_flow").alias("_f"))
    cash = opening.join(flows, "acct", "left").select("acct", (F.col("cash") + F.coalesce("_f", F.lit(0.0))).alias("cash"))
    return cash, lines.filter("shares > 0").select(*LINE, "shares")


def fill_completeness(orders: DataFrame, fills: DataFrame, tag: str, since: str) -> DataFrame:
    """Ordered against filled shares per (acct, asset) for one strategy tag from a start time on."""
    want = orders.groupBy(*LINE).agg(F.sum("shares").alias("ordered"))
    got = (fills.filter((F.col("tag") == tag) & (F.col("ts") >= F.to_timestamp(F.lit(since))))
           .groupBy(*LINE).agg(F.sum("shares").alias("filled")))
    out = want.join(got, list(LINE), "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return out.withColumn("complete", F.col("filled") >= F.col("ordered"))
