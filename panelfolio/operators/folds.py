"""Walk-forward windows and purged folds as row ranges of the trading calendar.

A window is (universe, window_id, part, lo, hi) with inclusive row numbers. Ranges are exploded to rows and meet returns
by equality on (universe, row_no), so no range join touches the daily series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S
from panelfolio.operators.panel import as_of_dates

RUN = ("universe", "run_id")
WINDOW = ("universe", "window_id")


def _span(calendar: DataFrame, start_row: int) -> DataFrame:
    return calendar.groupBy("universe").agg(
        F.max(F.when(F.col("row_no") == start_row, F.col("dt"))).alias("start_dt"), F.max("dt").alias("end_dt"),
        F.max("row_no").alias("last_row"))


def _rows_at(edges: DataFrame, calendar: DataFrame, names: list[str]) -> DataFrame:
    """Calendar row at or before each named timestamp of a window, as columns."""
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("timestamp_ntz").alias("ts")) for n in names])).alias("e")
    points = edges.select(*WINDOW, at).select(
        "universe", F.concat_ws("|", F.col("window_id").cast("string"), "e.name").alias("target_id"), F.col("e.ts").alias("target_ts"))
    found = as_of_dates(points, calendar)
    name = F.split_part("target_id", F.lit("|"), F.lit(2))
    return found.groupBy("universe", F.split_part("target_id", F.lit("|"), F.lit(1)).cast("int").alias("window_id")).agg(
        *[F.max(F.when(name == n, F.col("as_of_row"))).alias(n) for n in names])


def _parts(bounds: DataFrame, ranges: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi")) for p, lo, hi in ranges]))
    return bounds.select(*WINDOW, rows).filter("hi >= lo")


def walk_forward_windows(calendar: DataFrame, start_row: int = 126, train_years: int = 5, test_years: int = 1) -> DataFrame:
    """Rolling windows that move by the test length. Train end and test start both snap back to a trading day."""
    span = _span(calendar, start_row)
    k = F.explode(F.sequence(F.lit(0), F.year("end_dt") - F.year("start_dt"))).alias("window_id")
    step = 12 * test_years
    # A start on 29 February loses its day with the first yearly step and keeps the 28th from then on.
    t0 = F.when(F.col("window_id") == 0, F.col("start_dt")).otherwise(
        F.add_months(F.add_months("start_dt", step), (F.col("window_id") - 1) * step))
    edges = span.select("universe", "start_dt", "end_dt", k).withColumn("t0", t0)
    edges = edges.select(*WINDOW, F.date_sub("t0", 1).alias("before"), F.add_months("t0", 12 * train_years).alias("train_end"),
                         F.date_add(F.add_months("t0", 12 * train_years), 1).alias("test_start"),
                         F.add_months("t0", 12 * (train_years + test_years)).alias("test_end"))
    bounds = _rows_at(edges, calendar, ["before", "train_end", "test_start", "test_end"]).join(span.select("universe", "last_row"), "universe")
    bounds = bounds.filter("test_start < last_row")
    return _parts(bounds, [("train", "coalesce(before, -1) + 1", "train_end"), ("test", "test_start", "test_end")])


def purged_folds(calendar: DataFrame, n_splits: int = 6, label_horizon: int = 21, embargo: int = 21, start_row: int = 126) -> DataFrame:
    """Equal time folds; training leaves out the fold, the purge before it and the embargo after it (calendar days)."""
    span = _span(calendar, start_row)
    seconds = (F.unix_date("end_dt") - F.unix_date("start_dt")) * 86400
    i = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("window_id")
    after = lambda n: ((F.col("window_id") + n) * seconds / n_splits).cast("decimal(18,6)")
    edge = lambda n: F.col("start_dt").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), after(n))
    edges = span.select("universe", "start_dt", "end_dt", i).withColumn("a", edge(0)).withColumn("b", edge(1))
    tick = F.expr("interval 1 microsecond")
    edges = edges.select(*WINDOW, (F.col("a") - tick).alias("before"), F.col("b").alias("fold_end"),
                         (F.col("a") - F.expr(f"interval {label_horizon} day") - tick).alias("purge"),
                         (F.col("b") + F.expr(f"interval {embargo} day")).alias("embargo"))
    bounds = _rows_at(edges, calendar, ["before", "fold_end", "purge", "embargo"]).join(span.select("universe", "last_row"), "universe")
    return _parts(bounds, [("test", "coalesce(before, -1) + 1", "fold_end"), ("train", "0", "purge"),
                           ("train", "embargo + 1", "last_row")])


def window_rows(windows: DataFrame) -> DataFrame:
    return windows.select(*WINDOW, "part", F.explode(F.sequence("lo", "hi")).alias("row_no"))


def window_scores(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Sharpe of every run in every window part."""
    rows = returns.select(*RUN, "row_no", "net").join(window_rows(windows), ["universe", "row_no"])
    return rows.groupBy(*RUN, "window_id", "part").agg(S.sharpe(F.avg("net"), F.stddev_samp("net")).alias("score"))


def ranked_score(places: int | None) -> tuple:
    """Best score first, first run on ties. Equal series summed in another order differ in the last bits, so scores are
    compared to ``places``; None compares them as they are."""
    return F.desc_nulls_last(F.col("score") if places is None else F.round("score", places)), F.asc("run_id")


def best_in_train(scores: DataFrame, places: int | None = 10) -> DataFrame:
    """Winner of each window on the training part; the first run wins ties (see `ranked_score`)."""
    by = Window.partitionBy(*WINDOW).orderBy(*ranked_score(places))
    return (scores.filter("part = 'train'").withColumn("_k", F.row_number().over(by)).filter("_k = 1")
            .select(*WINDOW, "run_id", F.col("score").alias("train_score")))


def fold_report(scores: DataFrame, windows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per window: test dates, chosen run, train and test score."""
    tests = scores.filter("part = 'test'").select(*RUN, "window_id", F.col("score").alias("test_score"))
    dates = calendar.select("universe", "row_no", "dt")
    span = (windows.filter("part = 'test'")
            .join(dates.withColumnsRenamed({"row_no": "lo", "dt": "test_start"}), ["universe", "lo"])
            .join(dates.withColumnsRenamed({"row_no": "hi", "dt": "test_end"}), ["universe", "hi"])
            .select(*WINDOW, "test_start", "test_end"))
    return best_in_train(scores).join(tests, [*RUN, "window_id"]).join(span, list(WINDOW))


def stitched_returns(returns: DataFrame, scores: DataFrame, windows: DataFrame) -> DataFrame:
    """Test returns of each window's winner one after the other; a shared edge day stays twice (``seq`` orders them)."""
    chosen = window_rows(windows.filter("part = 'test'")).join(best_in_train(scores).select(*WINDOW, "run_id"), list(WINDOW))
    return returns.select(*RUN, "dt", "row_no", "net").join(chosen, ["universe", "run_id", "row_no"]).withColumn(
        "seq", F.struct("window_id", "row_no"))


def rank_of_best(scores: DataFrame, places: int | None = 10) -> DataFrame:
    """0-based test rank of the training winner per window, with the number of runs."""
    by = Window.partitionBy(*WINDOW)
    ranks = scores.filter("part = 'test'").withColumn(
        "test_rank", F.row_number().over(by.orderBy(*ranked_score(places))) - 1).withColumn(
        "n_runs", F.count(F.lit(1)).over(by))
    return best_in_train(scores, places).join(ranks.select(*RUN, "window_id", "test_rank", "n_runs"), [*RUN, "window_id"])
