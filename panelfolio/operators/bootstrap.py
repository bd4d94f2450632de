"""Paired circular block bootstrap by block sums.

A replicate's Sharpe ratio needs only sums of x and x*x, so blocks are summed once per start and replicates join those
sums: n_boot * ceil(T / block) rows instead of n_boot * T. Starts come from a hash, so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.functions import scalars as S

PAIR = ("universe", "pair_id")


def pair_series(returns: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(universe, pair_id, i, a, b) on the common dates of two runs."""
    dim = [(f"{a}-{b}", a, b) for a, b in pairs]
    spec = F.broadcast(returns.sparkSession.createDataFrame(dim, "pair_id string, run_a string, run_b string"))
    r = returns.select("universe", "run_id", "dt", "net")
    a = r.withColumnsRenamed({"run_id": "run_a", "net": "a"}).join(spec, "run_a")
    b = r.withColumnsRenamed({"run_id": "run_b", "net": "b"}).join(spec.select("pair_id", "run_b"), "run_b")
    both = a.select(*PAIR, "dt", "a").join(b.select(*PAIR, "dt", "b"), [*PAIR, "dt"])
    return both.withColumn("i", F.row_number().over(Window.partitionBy(*PAIR).orderBy("dt")) - 1)


def circular_starts(lengths: DataFrame, n_boot: int, block: int, seed: int) -> DataFrame:
    """(pair, rep, block_no, is_last, start): block starts of every replicate. ``lengths``: pair, t."""
    reps = lengths.select(*PAIR, "t", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    # Replicates spread over the cluster before blocks multiply them; the final sums reuse this partitioning.
    reps = reps.repartition(*PAIR, "rep")
    n = F.ceil(F.col("t") / block).cast("int")
    draws = reps.select(*PAIR, "t", "rep", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("block_no").cast("string")))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return draws.select(*PAIR, "rep", "block_no", (F.col("block_no") == F.col("_n") - 1).alias("is_last"),
                        F.pmod(number, F.col("t").cast("long")).cast("int").alias("start"))


def block_sums(pairs: DataFrame, block: int) -> DataFrame:
    """Sums of a, a*a, b, b*b over the circular block from every start, full length and cut to the last block."""
    whole = Window.partitionBy(*PAIR)
    df = pairs.withColumn("t", F.count(F.lit(1)).over(whole).cast("int"))
    # The first block - 1 rows follow the last row once more, so blocks may wrap.
    reach = F.when(F.col("i") < block - 1, F.array("i", F.col("i") + F.col("t"))).otherwise(F.array("i"))
    ring = df.select(*PAIR, "t", "a", "b", F.explode(reach).alias("i"))
    ahead = Window.partitionBy(*PAIR).orderBy("i").rowsBetween(0, block - 1)
    ring = ring.withColumn("_w", F.collect_list(F.struct("a", "b")).over(ahead)).filter("i < t").withColumn(
        "_last", F.col("t") - (F.ceil(F.col("t") / block) - 1) * block)
    total = lambda arr, e: f"aggregate({arr}, 0D, (s, x) -> s + {e})"
    parts = {"a": "x.a", "aa": "x.a * x.a", "b": "x.b", "bb": "x.b * x.b"}
    full = [f"{total('_w', e)} as full_{n}" for n, e in parts.items()]
    last = [f"{total('slice(_w, 1, int(_last))', e)} as last_{n}" for n, e in parts.items()]
    return ring.selectExpr(*PAIR, "i as start", "t", *full, *last)


def paired_bootstrap(pairs: DataFrame, n_boot: int = 2000, block: int = 21, seed: int = 7) -> DataFrame:
    """Per pair: observed Sharpe difference, bootstrap mean, 95% interval, P(delta <= 0) and the verdict."""
    observed = pairs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).cast("int").alias("t"),
        (S.flat_safe_sharpe(F.avg("a"), F.stddev_samp("a")) - S.flat_safe_sharpe(F.avg("b"), F.stddev_samp("b"))).alias("delta_obs"))
    sums = block_sums(pairs, block)
    draws = circular_starts(observed.select(*PAIR, "t"), n_boot, block, seed)
    pick = lambda n: F.sum(F.when(F.col("is_last"), F.col(f"last_{n}")).otherwise(F.col(f"full_{n}"))).alias(n)
    reps = draws.join(sums, [*PAIR, "start"]).groupBy(*PAIR, "rep").agg(F.max("t").alias("t"), *[pick(n) for n in ("a", "aa", "b", "bb")])
    spread = lambda n: F.sqrt(F.greatest((F.col(n * 2) - F.col(n) * F.col(n) / F.col("t")) / (F.col("t") - 1), F.lit(0.0)))
    sharpe = lambda n: S.flat_safe_sharpe(F.col(n) / F.col("t"), spread(n))
    deltas = reps.select(*PAIR, (sharpe("a") - sharpe("b")).alias("delta"))
    out = deltas.groupBy(*PAIR).agg(
        F.avg("delta").alias("boot_mean"), F.percentile("delta", F.lit(0.025)).alias("ci_lo"),
        F.percentile("delta", F.lit(0.975)).alias("ci_hi"), F.avg((F.col("delta") <= 0).cast("double")).alias("p_value"))
    return observed.select(*PAIR, "delta_obs").join(out, list(PAIR)).withColumn("verdict", verdict())


def verdict():
    return F.when(F.col("ci_lo") > 0, "better").when(F.col("ci_hi") < 0, "worse").otherwise("not significant")
