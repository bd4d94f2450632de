import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelfolio.operators import panel as P  # noqa: E402
from panelfolio.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def long_prices(wide: pd.DataFrame, universe: str = "u") -> pd.DataFrame:
    out = wide.stack().rename("close").reset_index()
    out.columns = ["dt", "asset", "close"]
    out["dt"] = pd.to_datetime(out["dt"]).dt.date
    return out.assign(universe=universe)[["universe", "asset", "dt", "close"]]


def make_panel(spark, wide: pd.DataFrame, universe: str = "u") -> P.Panel:
    df = spark.createDataFrame(long_prices(wide, universe), "universe string, asset string, dt date, close double")
    return P.prepare_panel(df, staged=True)


def random_walk(n: int, assets: list[str], seed: int = 5, start: str = "2018-01-01", vol: float = 0.012, drift: float = 0.0003) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    idx = pd.bdate_range(start, periods=n)
    return pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(drift, vol, (n, len(assets))), axis=0)), index=idx, columns=assets)
