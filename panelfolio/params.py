"""Run configuration: universes and parameter sets. Small driver-side values that become literals or dimension rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Base lookbacks, costs and lot size.
BASE_LOOKBACKS = (21, 63, 126)
COMMISSION = 0.00025
SLIPPAGE = 0.0005
COST_RATE = COMMISSION + SLIPPAGE
LOT = 100


@dataclass(frozen=True)
class Universe:
    """One market: ordered pool, the bond defence, an optional cash-like defence and the benchmark."""

    name: str
    pool: tuple[str, ...]
    bond: str
    benchmark: str
    cash: str | None = None
    labels: dict[str, str] = field(default_factory=dict, hash=False, compare=False)

    @property
    def cash_leg(self) -> str:
        return self.cash or self.bond


UNIVERSE_SCHEMA = ("universe string, asset string, pool_order int, bond_asset string, cash_asset string, "
                   "bench_asset string, label string")


def universe_dim(spark: SparkSession, universes: list[Universe]) -> DataFrame:
    """Dimension rows of every pool asset; defence legs keep pool_order null. Whether to broadcast them is left to Spark's size check."""
    rows = []
    for u in universes:
        for i, a in enumerate(u.pool):
            rows.append((u.name, a, i, u.bond, u.cash_leg, u.benchmark, u.labels.get(a)))
        for a in sorted({u.bond, u.cash_leg} - set(u.pool)):
            rows.append((u.name, a, None, u.bond, u.cash_leg, u.benchmark, u.labels.get(a)))
    return spark.createDataFrame(rows, UNIVERSE_SCHEMA)


@dataclass(frozen=True)
class ParamSet:
    """Decision parameters of one run. ``None`` switches an overlay off."""

    run_id: str = "base"
    lookbacks: tuple[int, ...] = BASE_LOOKBACKS
    lookback_weights: tuple[float, ...] | None = None
    top_n: int = 3
    cash_buffer: float = 0.99
    vol_target: float | None = 0.15
    vol_window: int = 20
    trend_ma: int | None = None
    trend_cut: float = 0.5
    skip: int = 0
    risk_adj: bool = False
    weighting: str = "equal"
    inv_vol_window: int = 63
    crash_prot: bool = False
    crash_lookback: int = 21
    crash_thr: float = 0.10
    crash_cut: float = 0.5
    drawdown_prot: bool = True
    dd_window: int = 126
    dd_thr: float = -0.10
    dd_cut: float = 0.5
    max_weight: float | None = None
    hold_all: bool = True

    @property
    def need(self) -> int:
        """First panel row (0-based) on which a decision may be taken."""
        return max(max(BASE_LOOKBACKS), max(self.lookbacks) + self.skip)

    def but(self, run_id: str, **changes) -> "ParamSet":
        return replace(self, run_id=run_id, **changes)


def overlay_ladder() -> list[ParamSet]:
    bare = ParamSet("1_bare", vol_target=None, drawdown_prot=False)
    return [bare, bare.but("2_vol", vol_target=0.15), bare.but("3_vol_trend", vol_target=0.15, trend_ma=200),
            bare.but("4_vol_trend_dd", vol_target=0.15, trend_ma=200, drawdown_prot=True)]


def selection_grid() -> list[ParamSet]:
    """The eight candidates that walk-forward, purged validation and the overfitting check choose from."""
    p = ParamSet(trend_ma=200)
    return [p.but("g1_default"), p.but("g2_risk_adj", risk_adj=True), p.but("g3_single", lookbacks=(126,)),
            p.but("g4_long", lookbacks=(63, 126, 252)), p.but("g5_top2", top_n=2), p.but("g6_cut30", trend_cut=0.3),
            p.but("g7_cut70", trend_cut=0.7), p.but("g8_no_trend", trend_ma=None)]


def sweep_grid(base: ParamSet | None = None) -> list[ParamSet]:
    base = base or ParamSet(trend_ma=200)
    windows = {"60": (60,), "126": (126,), "21_63_126": (21, 63, 126), "63_126_252": (63, 126, 252)}
    return [base.but(f"lb{name}_top{n}", lookbacks=lb, top_n=n) for name, lb in windows.items() for n in (1, 2, 3)]


# The one-at-a-time axes of the robustness scan.
ROBUST_AXES: tuple[tuple[str, tuple], ...] = (
    ("trend_cut", (0.0, 0.3, 0.5, 0.7, 0.9)),
    ("vol_target", (None, 0.10, 0.15, 0.20, 0.25)),
    ("top_n", (1, 2, 3, 4, 5)),
    ("lookbacks", ((60,), (126,), (21, 63, 126), (21, 126), (63, 126))),
    ("skip", (0, 5, 10, 21)),
    ("risk_adj", (True, False)),
    ("trend_ma", (None, 120, 200, 250)),
)


def robust_grid(base: ParamSet | None = None) -> list[ParamSet]:
    base = base or ParamSet(trend_ma=200)
    shown = lambda v: "/".join(map(str, v)) if isinstance(v, tuple) else str(v)
    return [base.but(f"{axis}={shown(v)}", **{axis: v}) for axis, values in ROBUST_AXES for v in values]


# Momentum weighting schemes compared against equal weights.
MOMENTUM_WEIGHT_SCHEMES: dict[str, tuple[float, ...] | None] = {
    "equal": None, "1_2_3": (1, 2, 3), "1_2_4": (1, 2, 4), "by_length": (21, 63, 126), "1_1_3": (1, 1, 3)}


def momentum_weight_grid() -> list[ParamSet]:
    return [ParamSet(name, lookback_weights=w, trend_ma=200) for name, w in MOMENTUM_WEIGHT_SCHEMES.items()]
