"""Registered queries against DuckDB. A few by default; all of them with CHECK_ALL=1."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry
from check import TABLES, canonical

SF = "/root/testdata/sf0.01"
FEW = ["adjusted_prices", "limit_flags", "backtest_limits", "risk_parity_targets", "purged_cv", "pair_perf", "orders_cash_cap", "fill_stream", "pair_tests", "month_close", "calendar_windows", "segment_table", "ledger",
       "drift_stream", "normal_functions", "near_trading_days", "vendor_files", "localized_bar_files", "report_files", "curve_files", "account_state_files", "merged_sources",
       "topped_up_closes", "coalesced_sources", "modified_score", "asset_vols", "suspended_asset", "min_variance_yearly", "config_flags", "month_gate", "symbol_rules"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_statement(spark, con, name):
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    want = canonical(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and list(got["_k"]) == list(want["_k"]) and len(got) > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


class FakeSession:
    """Just enough of a cluster session to see where staged tables would go."""

    def __init__(self, configured, master="spark://host:7077"):
        self.conf = self
        self.sparkContext = self
        self.master, self.configured = master, configured

    def get(self, key, default=None):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_staged_tables_follow_the_configured_folder(spark):
    from panelfolio.session import shared_dir, stage
    assert shared_dir(FakeSession("hdfs://shared/cp")) == "hdfs://shared/cp"
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None))
    assert stage(spark.range(3), "t").count() == 3


def test_reversion_books_start_at_their_first_weights(spark, con):
    years = lambda name: {r["run_id"]: r["years"] for r in entry.queries()[name](spark, SF).collect()}
    got = years("zscore_reversion")
    days = con.execute(entry.oracle_sql()["daily_returns"]).df()["dt"]
    assert set(got) == {"open", "gated"} and all(y > (days.max() - days.min()).days / 365.25 - 0.2 for y in got.values())
