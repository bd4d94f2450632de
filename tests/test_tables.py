import pytest
from conftest import make_panel, random_walk

from panelfolio.functions import tables
from panelfolio.operators import folds as W


@pytest.fixture(scope="module")
def calendar(spark):
    long = make_panel(spark, random_walk(2600, ["a"], start="2012-02-29"), "long").calendar
    short = make_panel(spark, random_walk(400, ["a"], start="2015-06-30"), "short").calendar
    return long.unionByName(short)


def rows(df):
    return sorted((r.universe, r.window_id, r.part, r.lo, r.hi) for r in df.collect())


def test_function_gives_the_folds_of_the_operators(calendar):
    assert rows(tables.calendar_windows(calendar, "walk_forward", 126, 3, 1)) == rows(W.walk_forward_windows(calendar, 126, 3, 1))
    assert rows(tables.calendar_windows(calendar, "walk_forward", 0, 2, 2)) == rows(W.walk_forward_windows(calendar, 0, 2, 2))
    assert rows(tables.calendar_windows(calendar, "purged", 126, 7, 21, 10)) == rows(W.purged_folds(calendar, 7, 21, 10, 126))


def test_function_in_sql_and_its_errors(spark, calendar):
    tables.register(spark)
    calendar.createOrReplaceTempView("trading_days")
    got = spark.sql("select * from calendar_windows(table(select universe, dt from trading_days), 'purged', 126, 4, 5, 5) where part = 'test'")
    assert len(rows(got)) == 8
    for bad in ("'weekly', 1", "'purged', 126", "'purged', 126, 4, 5, 'x'"):
        with pytest.raises(Exception, match="kind|whole numbers"):
            spark.sql(f"select * from calendar_windows(table(select universe, dt from trading_days), {bad})").collect()
    assert tables.calendar_windows(calendar.filter("false"), "walk_forward", 126, 3, 1).count() == 0
