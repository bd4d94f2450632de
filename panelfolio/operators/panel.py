"""Panel preparation: calendars, bounded fills, price adjustment, limit flags, slices.

Panels are long and sparse: one row per (universe, asset, dt) that holds a price. A missing row is a missing price, so
no dates x assets grid is built unless `align_panel` is asked for. One window partition is one asset of one universe and
holds at most one row per trading date, so its size is bounded by the calendar, not by the raw data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.session import stage

ASSET = ("universe", "asset")
ORDINALS = ("reb_before", "reb_earn", "n_rows", "n_reb")


def asset_window(order: str = "dt"):
    return Window.partitionBy(*ASSET).orderBy(order)


@dataclass(frozen=True)
class Panel:
    """``obs``: universe, asset, dt, row_no, close, is_filled and ORDINALS. ``calendar``: see below."""

    obs: DataFrame
    calendar: DataFrame

    def staged(self, tag: str = "panel") -> "Panel":
        return Panel(stage(self.obs, f"{tag}-obs"), stage(self.calendar, f"{tag}-calendar"))


def trading_calendar(prices: DataFrame, partition: str = "universe") -> DataFrame:
    """Trading dates with ordinals and month ends.

    Columns: row_no (0-based), n_rows, is_month_end (last trading date of its month, the last date always counts),
    reb_no (ordinal of the month end, else null), reb_before (month ends strictly earlier), reb_earn (the same one row
    earlier: the ordinal whose holdings earn this row's return), n_reb.
    """
    return _with_ordinals(prices.select(partition, "dt").distinct(), partition)


def _with_ordinals(dates: DataFrame, partition: str = "universe") -> DataFrame:
    over = f"over (partition by {partition} order by dt)"
    # ``partition`` may name several columns; they all hang on the universe, so one exchange serves every window.
    df = dates.selectExpr("*", f"lead(dt) {over} as _next", f"row_number() {over} - 1 as row_no")
    df = df.selectExpr("*", "coalesce(trunc(_next, 'month') <> trunc(dt, 'month'), true) as is_month_end")
    df = df.selectExpr("*", f"cast(sum(int(is_month_end)) {over} as int) as _upto",
                       f"cast(count(1) over (partition by {partition}) as int) as n_rows")
    df = df.selectExpr("*", "_upto - int(is_month_end) as reb_before", "case when is_month_end then _upto end as reb_no",
                       f"max(_upto) over (partition by {partition}) as n_reb")
    return df.selectExpr("*", f"lag(reb_before) {over} as reb_earn").drop("_next", "_upto")


def anchored_calendar(prices: DataFrame, anchors: list[str], limit: int | None) -> DataFrame:
    """`trading_calendar` from the first date on which every anchor has a price (own or filled).

    Earlier dates stay with ``started`` = 0, because a fill may start on them; ``listed_row`` counts all dates. One
    aggregate per date finds dates and anchor prices together.
    """
    has = [F.max((F.col("asset") == a).cast("int")).alias(f"_h{i}") for i, a in enumerate(anchors)]
    dates = prices.groupBy("universe", "dt").agg(*has)
    w = Window.partitionBy("universe").orderBy("dt")
    back = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    ready = F.least(*[F.max(f"_h{i}").over(back) for i in range(len(anchors))]) if len(anchors) > 1 else F.max("_h0").over(back)
    df = dates.select("universe", "dt", (F.row_number().over(w) - 1).alias("listed_row"), ready.alias("_ready"),
                      F.count(F.lit(1)).over(Window.partitionBy("universe")).cast("int").alias("listed_rows"))
    started = F.max("_ready").over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("started", F.coalesce(started, F.lit(0))).drop("_ready")
    return _with_ordinals(df, "universe, started")


def rebalances(calendar: DataFrame) -> DataFrame:
    """One row per rebalance: universe, reb_no, reb_row, signal_dt."""
    return calendar.filter("is_month_end").select(
        "universe", "reb_no", F.col("row_no").alias("reb_row"), F.col("dt").alias("signal_dt"), "n_reb")


def month_end_calendar(calendar: DataFrame, min_row: int = 0) -> DataFrame:
    return rebalances(calendar).filter(F.col("reb_row") >= min_row).drop("n_reb")


def with_rebalance_dates(panel: Panel, dates: DataFrame) -> Panel:
    """The same panel with other rebalance dates (universe, dt) in place of its month ends."""
    flagged = panel.calendar.select("universe", "dt", "row_no", "n_rows").join(
        dates.select("universe", "dt").distinct().withColumn("_reb", F.lit(True)), ["universe", "dt"], "left")
    over = "over (partition by universe order by dt)"
    df = flagged.selectExpr("universe", "dt", "row_no", "n_rows", "coalesce(_reb, false) as is_month_end")
    df = df.selectExpr("*", f"cast(sum(int(is_month_end)) {over} as int) as _upto")
    df = df.selectExpr("*", "_upto - int(is_month_end) as reb_before", "case when is_month_end then _upto end as reb_no",
                       "max(_upto) over (partition by universe) as n_reb")
    calendar = stage(df.selectExpr("*", f"lag(reb_before) {over} as reb_earn").drop("_upto"), "calendar")
    obs = panel.obs.drop("row_no", *ORDINALS).join(calendar.select("universe", "dt", "row_no", *ORDINALS), ["universe", "dt"])
    return Panel(obs, calendar)


def own_month_ends(obs: DataFrame, min_row: int) -> DataFrame:
    """Every date that is the last price date of a month for some asset, from that asset's row ``min_row`` on."""
    w = asset_window()
    following = F.lead("dt").over(w)
    own = obs.select(*ASSET, "dt", (F.row_number().over(w) - 1).alias("_own"),
                     (following.isNull() | (F.trunc(following, "month") != F.trunc("dt", "month"))).alias("_end"))
    return own.filter((F.col("_own") >= min_row) & F.col("_end")).select("universe", "dt").distinct()


def is_month_end_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Flag each (universe, dt); a universe without a calendar answers true."""
    last = calendar.groupBy("universe", F.trunc("dt", "month").alias("month")).agg(F.max("dt").alias("month_last"))
    known = calendar.select("universe").distinct().withColumn("has_calendar", F.lit(True))
    return (days.withColumn("month", F.trunc("dt", "month"))
            .join(last, ["universe", "month"], "left").join(known, "universe", "left")
            .select("universe", "dt", F.when(F.col("has_calendar").isNull(), F.lit(True))
                    .otherwise(F.coalesce(F.col("dt") == F.col("month_last"), F.lit(False))).alias("is_month_end")))


def as_of_dates(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Last trading date (and its row) at or before each ``target_ts``: keys (universe, target_id, target_ts).

    Two levels, no range join: both time lines are cut into months; inside a month a running last value over their union
    finds the date, and where a month has none so far, the last date of the months before it, which one row per month of the
    calendar tells. So targets spread over months. Times are wall-clock, so the session time zone does not matter.
    """
    at = F.col("at")
    asked = targets.select("universe", "target_id", F.col("target_ts").cast("timestamp_ntz").alias("at"))
    days = calendar.select("universe", F.col("dt").cast("timestamp_ntz").alias("at"), "dt", "row_no")
    line = asked.select("*", F.lit(None).cast("date").alias("dt"), F.lit(None).cast("int").alias("row_no"), F.lit(1).alias("kind")).unionByName(
        days.select("universe", F.lit(None).cast("string").alias("target_id"), "at", "dt", "row_no", F.lit(0).alias("kind")))
    inside = Window.partitionBy("universe", "_m").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_m", F.year(at) * 12 + F.month(at)).withColumn("_last", F.last(F.when(F.col("kind") == 0, F.struct("dt", "row_no")), ignorenulls=True).over(inside))
    months = days.groupBy("universe", (F.year(at) * 12 + F.month(at)).alias("_month")).agg(F.max(F.struct("dt", "row_no")).alias("_carried"))
    following = F.lead("_month").over(Window.partitionBy("universe").orderBy("_month"))
    months = months.withColumn("_next", following)
    # a month's last date serves up to the next month that has one; months behind the last have no end and take it from below
    served = months.filter("_next is not null").select("universe", "_carried", F.explode(F.sequence(F.col("_month") + 1, F.col("_next"))).alias("_m"))
    final = months.filter("_next is null").select("universe", F.col("_month").alias("_end"), F.col("_carried").alias("_final"))
    out = line.filter("kind = 1").join(served, ["universe", "_m"], "left").join(final, "universe", "left")
    found = F.coalesce("_last", "_carried", F.when(F.col("_m") > F.col("_end"), F.col("_final")))
    return out.select("universe", "target_id", at.alias("target_ts"), found["dt"].alias("as_of_dt"), found["row_no"].alias("as_of_row"))


def _spread(obs: DataFrame, calendar: DataFrame, limit: int | None, carry: tuple[str, ...]) -> DataFrame:
    """Repeat each price row over its own gap: (universe, asset, *carry, row_no, ahead)."""
    known = obs.filter(S.clean_number(F.col(carry[0])).isNotNull())
    rows = known.join(calendar.select("universe", "dt", "row_no", "n_rows"), ["universe", "dt"])
    gap = F.coalesce(F.lead("row_no").over(asset_window("row_no")), F.col("n_rows")) - F.col("row_no") - 1
    reach = gap if limit is None else F.least(gap, F.lit(limit))
    spread = rows.select(*ASSET, *carry, "row_no", reach.alias("reach")).select(
        *ASSET, *carry, "row_no", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("ahead"))
    return spread.withColumn("row_no", F.col("row_no") + F.col("ahead"))


def fill_forward(obs: DataFrame, calendar: DataFrame, limit: int | None = 3,
                 carry: tuple[str, ...] = ("close",)) -> DataFrame:
    """Forward fill at most ``limit`` calendar rows after each price (``None``: up to the next price).

    Only the filled rows themselves are created, never a dates x assets grid.
    """
    return (_spread(obs, calendar, limit, carry).join(calendar.select("universe", "row_no", "dt"), ["universe", "row_no"])
            .select(*ASSET, "dt", *carry, (F.col("ahead") > 0).alias("is_filled")))


def anchor_date(obs: DataFrame, anchors: list[str]) -> DataFrame:
    """First date per universe on which every anchor asset has a price."""
    return (obs.filter(F.col("asset").isin(*anchors)).groupBy("universe", "dt").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(anchors)).groupBy("universe").agg(F.min("dt").alias("start_dt")))


def anchor_start(obs: DataFrame, anchors: list[str]) -> DataFrame:
    start = anchor_date(obs, anchors)
    return obs.join(start, "universe").filter("dt >= start_dt").drop("start_dt")


def not_listed_by_start(obs: DataFrame, pool: DataFrame, anchors: list[str]) -> DataFrame:
    """Pool assets without any price at or before the anchored start."""
    listed = obs.groupBy(*ASSET).agg(F.min("dt").alias("first_dt"))
    ready = (listed.join(anchor_date(obs, anchors), "universe").filter("first_dt <= start_dt").select(*ASSET))
    return pool.select(*ASSET).join(ready, list(ASSET), "left_anti")


def prepare_panel(prices: DataFrame, limit: int | None = 3, anchors: list[str] | None = None,
                  drop_first: bool = True, carry: tuple[str, ...] = ("close",), staged: bool = False) -> Panel:
    """Clean prices into a Panel; ``staged`` writes calendar and rows to the shared folder for several readers.

    ``drop_first`` removes dates without any price before the fill, so every remaining date keeps a row and one
    calendar serves both the fill and the panel. Otherwise such dates count as rows for the fill and vanish after it.
    """
    if not drop_first:
        filled = fill_forward(prices, trading_calendar(prices), limit, carry)
        return index_panel(anchor_start(filled, anchors) if anchors else filled)
    known = prices.filter(S.clean_number(F.col("close")).isNotNull())
    dates = anchored_calendar(known, anchors, limit) if anchors else trading_calendar(known).selectExpr(
        "*", "row_no as listed_row", "n_rows as listed_rows", "1 as started")
    if staged:
        dates = stage(dates, "calendar")
    calendar = dates.filter("started = 1").drop("started")
    listed = dates.selectExpr("universe", "dt", "listed_row as row_no", "listed_rows as n_rows")
    rows = _spread(known, listed, limit, carry)
    ordinals = calendar.select("universe", "listed_row", "dt", "row_no", *ORDINALS)
    obs = rows.withColumnRenamed("row_no", "listed_row").join(ordinals, ["universe", "listed_row"]).select(
        *ASSET, "dt", *carry, (F.col("ahead") > 0).alias("is_filled"), "row_no", *ORDINALS)
    return Panel(stage(obs, "obs") if staged else obs, calendar.drop("listed_row", "listed_rows"))


def index_panel(filled: DataFrame) -> Panel:
    """Attach calendar ordinals to a set of price rows; dates without any price vanish here."""
    calendar = trading_calendar(filled)
    ordinals = calendar.select("universe", "dt", "row_no", *ORDINALS)
    return Panel(filled.join(ordinals, ["universe", "dt"]), calendar)


def align_panel(panel: Panel) -> DataFrame:
    """Explicit grid: every calendar row for every asset, close null where missing."""
    cells = (panel.obs.groupBy(*ASSET).agg(F.max("n_rows").alias("n_rows"))
             .select(*ASSET, F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_no")))
    return (cells.join(panel.calendar.select("universe", "row_no", "dt"), ["universe", "row_no"])
            .join(panel.obs.select(*ASSET, "row_no", "close"), [*ASSET, "row_no"], "left")
            .select(*ASSET, "dt", "row_no", "close"))


def drop_empty_dates(aligned: DataFrame) -> DataFrame:
    alive = aligned.filter("close is not null").select("universe", "dt").distinct()
    return aligned.join(alive, ["universe", "dt"], "left_semi")


def adjust_prices(prices: DataFrame) -> DataFrame:
    """Backward adjustment: close times the product of later pre_close / previous close factors."""
    w = asset_window()
    factor = F.coalesce(S.ratio(F.col("pre_close"), F.lag("close").over(w)), F.lit(1.0))
    # read from the last row back, the later factors are an expanding product: linear in the rows
    back = Window.partitionBy(*ASSET).orderBy(F.desc("dt")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.product("factor").over(back), F.lit(1.0))
    return prices.withColumn("factor", factor).withColumn("adj_close", F.col("close") * later)


def derive_preclose(prices: DataFrame) -> DataFrame:
    return prices.withColumn("pre_close", F.lag("close").over(asset_window()))


def adjustment_audit(adjusted: DataFrame) -> DataFrame:
    """Per asset: first date, rows, largest move, ex-dates, price return against adjusted return per year."""
    move = F.abs(S.ratio(F.col("close"), F.lag("close").over(asset_window())) - 1)
    priced = F.col("close").isNotNull()
    end = lambda pick, what: pick(F.when(priced, F.col(what)), F.when(priced, F.col("dt")))
    out = adjusted.withColumn("move", move).groupBy(*ASSET).agg(
        F.min(F.when(priced, F.col("dt"))).alias("first_dt"), F.max(F.when(priced, F.col("dt"))).alias("last_dt"),
        F.count("close").alias("n_days"), F.sum((~priced).cast("int")).alias("n_null"), F.max("move").alias("max_move"),
        F.count_if(F.abs(F.col("factor") - 1) > 0.001).alias("n_ex_dates"),
        (end(F.max_by, "close") / end(F.min_by, "close") - 1).alias("price_return"),
        (end(F.max_by, "adj_close") / end(F.min_by, "adj_close") - 1).alias("adj_return"))
    years = S.years_between(F.col("first_dt"), F.col("last_dt"))
    return (out.withColumn("income", F.col("adj_return") - F.col("price_return"))
            .withColumn("income_per_year", S.ratio(F.col("income"), years)).drop("last_dt"))


def with_limit_pct(prices: DataFrame, limit_table: DataFrame | None = None) -> DataFrame:
    """Daily limit: explicit table first, then the rules on the code."""
    if limit_table is None:
        limit_table = prices.sparkSession.createDataFrame(
            list(S.LIMIT_BY_CODE.items()), "asset string, table_pct double")
    return (prices.join(limit_table.select("asset", "table_pct"), "asset", "left")
            .withColumn("limit_pct", F.coalesce("table_pct", S.limit_by_rule(F.col("asset")))).drop("table_pct"))


def limit_flags(prices: DataFrame) -> DataFrame:
    """Close at the limit price (rounded half up to cents) blocks that side. Needs close, pre_close, limit_pct."""
    band = lambda sign: F.round(F.col("pre_close") * (1 + sign * F.col("limit_pct")), 2)
    return (prices.withColumn("cant_buy", F.coalesce(F.col("close") >= band(1), F.lit(False)))
            .withColumn("cant_sell", F.coalesce(F.col("close") <= band(-1), F.lit(False))))


def limit_flags_approx(prices: DataFrame, slack: float = 1e-4) -> DataFrame:
    """Same question from the close-to-close return when no pre_close exists."""
    move = S.ratio(F.col("close"), F.lag("close").over(asset_window())) - 1
    up = F.coalesce(F.col("move") >= F.col("limit_pct") - slack, F.lit(False))
    down = F.coalesce(F.col("move") <= -F.col("limit_pct") + slack, F.lit(False))
    return prices.withColumn("move", move).withColumn("cant_buy", up).withColumn("cant_sell", ~up & down)


def quality_guard(prices: DataFrame, multiple: float = 1.5) -> DataFrame:
    """Rows whose move exceeds ``multiple`` times the daily limit, over the asset's own price rows."""
    move = F.col("close") / F.lag("close").over(asset_window()) - 1
    return (prices.filter("close is not null").withColumn("move", move)
            .filter(F.abs("move") > F.col("limit_pct") * multiple).select(*ASSET, "dt", "move"))


def daily_returns(panel: Panel, gap_policy: str = "pad") -> DataFrame:
    """Return of every price row, first row 0. Rows inside a gap are absent (0).

    ``pad``: the row after a gap carries the whole move. ``drop``: it carries 0.
    """
    w = asset_window("row_no")
    move = F.col("close") / F.lag("close").over(w) - 1
    if gap_policy == "drop":
        move = F.when(F.col("row_no") - F.lag("row_no").over(w) == 1, move)
    return panel.obs.withColumn("ret", F.coalesce(move, F.lit(0.0)))


def min_history(obs: DataFrame, n: int, listed_by: str | None = None) -> DataFrame:
    """Keep assets with at least ``n`` prices (and listed by a cutoff date)."""
    facts = obs.groupBy(*ASSET).agg(F.count("close").alias("n_obs"), F.min("dt").alias("first_dt")).filter(F.col("n_obs") >= n)
    if listed_by:
        facts = facts.filter(F.col("first_dt") <= F.to_date(F.lit(listed_by)))
    return obs.join(facts.select(*ASSET), list(ASSET), "left_semi")


def universe_variant(panel: Panel, universe: str, variant: str, drop: list[str]) -> Panel:
    """Copy of one universe under another key without some assets; its calendar stays as it was."""
    obs = panel.obs.filter((F.col("universe") == universe) & ~F.col("asset").isin(*drop))
    calendar = panel.calendar.filter(F.col("universe") == universe)
    return Panel(obs.withColumn("universe", F.lit(variant)), calendar.withColumn("universe", F.lit(variant)))


def synthetic_drift(panel: Panel, universe: str, variant: str, asset: str, annual: float) -> Panel:
    """Copy of one universe where ``asset`` compounds at a constant annual rate from its first price."""
    daily = (1.0 + annual) ** (1.0 / S.TRADING_DAYS)
    source = panel.obs.filter(F.col("universe") == universe).select(*ASSET, "dt", "row_no", *ORDINALS, "close")
    anchor = source.filter(F.col("asset") == asset).groupBy("universe").agg(F.min_by("close", "dt").alias("anchor"))
    calendar = panel.calendar.filter(F.col("universe") == universe)
    path = calendar.join(anchor, "universe").select(
        "universe", F.lit(asset).alias("asset"), "dt", "row_no", *ORDINALS,
        (F.col("anchor") * F.pow(F.lit(daily), F.col("row_no"))).alias("close"))
    obs = source.filter(F.col("asset") != asset).unionByName(path)
    return Panel(obs.withColumn("universe", F.lit(variant)), calendar.withColumn("universe", F.lit(variant)))


def union_panels(panels: list[Panel]) -> Panel:
    obs, calendar = panels[0].obs, panels[0].calendar
    for p in panels[1:]:
        obs, calendar = obs.unionByName(p.obs, allowMissingColumns=True), calendar.unionByName(p.calendar)
    return Panel(obs, calendar)


def factor_returns(returns: DataFrame, calendar: DataFrame, spec: list[tuple[str, str, str | None]]) -> DataFrame:
    """Long (universe, dt, factor, f_ret). spec: (factor, long asset, short asset or None); absent assets count as 0."""
    legs = [(name, a, 1.0) for name, a, _ in spec] + [(name, b, -1.0) for name, _, b in spec if b]
    dim = returns.sparkSession.createDataFrame(legs, "factor string, asset string, sign double")
    values = (returns.join(F.broadcast(dim), "asset").groupBy("universe", "dt", "factor")
              .agg(F.sum(F.col("sign") * F.col("ret")).alias("f_ret")))
    grid = calendar.select("universe", "dt", F.explode(F.array(*[F.lit(n) for n, _, _ in spec])).alias("factor"))
    return (grid.join(values, ["universe", "dt", "factor"], "left")
            .withColumn("f_ret", F.coalesce("f_ret", F.lit(0.0))))


def label(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Display name from the universe dimension, else the code itself."""
    names = dim.select("universe", "asset", "label")
    return df.join(names, list(ASSET), "left").withColumn("label", F.coalesce("label", "asset"))
