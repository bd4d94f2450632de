"""Combine price sources that cover different assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.session import stage

ASSET = ["universe", "asset"]


def _ranked(sources: list[DataFrame]) -> DataFrame:
    """One union with the number of each source."""
    out = None
    for i, s in enumerate(sources):
        df = s.select(*sources[0].columns).withColumn("source_rank", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def coalesce_sources(primary: DataFrame, backup: DataFrame, critical: list[str]) -> DataFrame:
    """Primary per asset; missing critical assets come from the backup; if one is still missing the backup serves all.

    The union of both is staged: it is read for what each asset has and again for the rows, the sources only once.
    """
    rows = stage(_ranked([primary, backup]), "sources")
    here = rows.groupBy(*ASSET).agg(F.min("source_rank").alias("first_rank"))
    needed = F.count_if(F.col("asset").isin(*critical))
    switch = here.groupBy("universe").agg((needed < len(set(critical))).alias("switch"))
    served = here.join(switch, "universe").select(*ASSET, F.when(F.col("switch"), 1).when(
        (F.col("first_rank") == 0) | F.col("asset").isin(*critical), F.col("first_rank")).alias("source_rank"))
    return rows.join(served, [*ASSET, "source_rank"]).select(*primary.columns)


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """Union by symbol; a later source replaces an earlier one as a whole. One exchange, by symbol."""
    last = F.max("source_rank").over(Window.partitionBy(*ASSET))
    return _ranked(sources).withColumn("_last", last).filter("source_rank = _last").drop("_last", "source_rank")


def missing_symbols(df: DataFrame, required: list[str]) -> DataFrame:
    need = df.select("universe").distinct().select("universe", F.explode(F.array(*[F.lit(a) for a in required])).alias("asset"))
    return need.join(df.select(*ASSET).distinct(), ASSET, "left_anti")


def require_symbols(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise when a required symbol is absent, with their number and the first twenty, else hand the rows on."""
    missing = missing_symbols(df, required)
    shown = [f"{r.universe}/{r.asset}" for r in missing.orderBy(*ASSET).limit(20).collect()]
    if shown:
        raise ValueError(f"{missing.count()} missing required symbols, among them {shown}")
    return df


def top_up(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """Last n + 1 rows per asset from the first source, absent assets from the second."""
    rows = _ranked([first, second]).withColumn("_first", F.min("source_rank").over(Window.partitionBy(*ASSET)))
    back = Window.partitionBy(*ASSET).orderBy(F.desc("dt"))
    rows = rows.filter("source_rank = _first").withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n + 1)
    return rows.select(*first.columns)
