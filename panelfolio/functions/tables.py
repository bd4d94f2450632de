"""Table functions: windows of a trading calendar for SQL and DataFrame callers."""

from __future__ import annotations

import calendar as months
import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

WINDOWS = (StructType().add("universe", StringType()).add("window_id", IntegerType()).add("part", StringType())
           .add("lo", IntegerType()).add("hi", IntegerType()))
KINDS = {"walk_forward": ("start_row", "train_years", "test_years"), "purged": ("start_row", "n_splits", "label_horizon", "embargo")}


def add_months(day: dt.date, n: int) -> dt.date:
    """The same day ``n`` months on, or the last of that month where it is shorter."""
    at = day.year * 12 + day.month - 1 + n
    year, month = divmod(at, 12)
    return dt.date(year, month + 1, min(day.day, months.monthrange(year, month + 1)[1]))


class CalendarWindows:
    """``calendar_windows(TABLE(calendar), kind, start_row, ...)``: row ranges (universe, window_id, part, lo, hi), both ends included.

    The table has columns universe and dt, one row per trading day, and is split by universe and sorted by day. Kinds and their
    numbers: 'walk_forward' (start_row, train_years, test_years) and 'purged' (start_row, n_splits, label_horizon, embargo), with
    the rules of `operators.folds`. A universe that ends before ``start_row`` has no windows.
    """

    @staticmethod
    def analyze(calendar: AnalyzeArgument, kind: AnalyzeArgument, *numbers: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name.lower() for f in calendar.dataType.fields} if calendar.isTable else set()
        if not {"universe", "dt"} <= names:
            raise ValueError("the first argument is a table with columns universe and dt")
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"the kind is one of {', '.join(KINDS)}")
        if len(numbers) != len(KINDS[kind.value]) or any(not n.isConstantExpression or not isinstance(n.value, int) for n in numbers):
            raise ValueError(f"{kind.value} takes {', '.join(KINDS[kind.value])} as whole numbers")
        return AnalyzeResult(WINDOWS, partitionBy=[PartitioningColumn("universe")], orderBy=[OrderingColumn("dt")])

    def __init__(self):
        self.days: list[dt.date] = []
        self.universe, self.kind, self.numbers = None, "", ()

    def eval(self, row: Row, kind: str, *numbers: int) -> None:
        self.universe, self.kind, self.numbers = row["universe"], kind, numbers
        self.days.append(row["dt"])

    def terminate(self) -> Iterator[tuple]:
        start_row, *numbers = self.numbers or (0,)
        if len(self.days) <= start_row:
            return
        rules = self._walk_forward if self.kind == "walk_forward" else self._purged
        for window, part, lo, hi in rules(self.days[start_row], *numbers):
            if lo is not None and hi is not None and hi >= lo:
                yield self.universe, window, part, lo, hi

    def _row_at(self, when: dt.date | dt.datetime) -> int | None:
        """The last trading day at or before ``when``."""
        day = when.date() if isinstance(when, dt.datetime) else when
        at = bisect_right(self.days, day) - 1
        return at if at >= 0 else None

    def _after(self, row: int | None) -> int:
        return 0 if row is None else row + 1

    def _walk_forward(self, start: dt.date, train_years: int, test_years: int) -> Iterator[tuple]:
        end, step = self.days[-1], 12 * test_years
        for k in range(end.year - start.year + 1):
            t0 = start if k == 0 else add_months(add_months(start, step), (k - 1) * step)
            split = add_months(t0, 12 * train_years)
            test = self._row_at(split + dt.timedelta(days=1))
            if test is not None and test < len(self.days) - 1:
                yield k, "train", self._after(self._row_at(t0 - dt.timedelta(days=1))), self._row_at(split)
                yield k, "test", test, self._row_at(add_months(t0, 12 * (train_years + test_years)))

    def _purged(self, start: dt.date, n_splits: int, label_horizon: int, embargo: int) -> Iterator[tuple]:
        tick = dt.timedelta(microseconds=1)
        micros = (self.days[-1] - start).days * 86_400_000_000
        edge = lambda i: dt.datetime.combine(start, dt.time()) + dt.timedelta(microseconds=int(Fraction(i * micros, n_splits) + Fraction(1, 2)))
        for k in range(n_splits):
            a, b = edge(k), edge(k + 1)
            yield k, "test", self._after(self._row_at(a - tick)), self._row_at(b)
            yield k, "train", 0, self._row_at(a - dt.timedelta(days=label_horizon) - tick)
            yield k, "train", self._after(self._row_at(b + dt.timedelta(days=embargo))), len(self.days) - 1


def register(spark: SparkSession) -> None:
    """Make ``calendar_windows`` known to SQL."""
    spark.udtf.register("calendar_windows", F.udtf(CalendarWindows))


def calendar_windows(calendar: DataFrame, kind: str, *numbers: int) -> DataFrame:
    """The table function on a DataFrame."""
    return F.udtf(CalendarWindows)(calendar.select("universe", "dt").asTable(), F.lit(kind), *map(F.lit, numbers))
