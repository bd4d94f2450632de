"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with n rows and target share w is repeated at the mean rate budget * w / n. Every row draws its own count by
inverting the Poisson distribution at uniform numbers hashed from (seed, doc_id): the same row gets the same count on any
cluster and in any retry, and no count of rows has to be agreed between tasks. Copies are spread over shards by a second
hash, which is the global shuffle: shard, then key within the shard, is the order.

Sources meet their rate in a join against one row per source. That table is broadcast only if its measured row count
proves it small; else the rows of each source are dealt over ``SALTS`` salted keys, so that a hot source is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import others, parts, stage

BROADCAST_SOURCES = 10_000  # rows of (source, rate): well under 2 MB
SALTS = 64
CHUNK = 64.0  # larger rates are sums of independent draws at rates of at most this, which exp() holds exactly
UNIT = float(2**52)


def uniform(*parts_: Column) -> Column:
    """A number inside (0, 1) from the first 52 bits of the MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts_)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)


def poisson(u: Column, rate: Column) -> Column:
    """The number of terms of the cumulative Poisson distribution at or below u."""
    top = F.ceil(rate + F.sqrt(rate) * 12 + 24).cast("int")
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def term(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct((acc["n"] + F.when(u >= acc["c"], 1).otherwise(0)).alias("n"), p.alias("p"), (acc["c"] + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, term)["n"]


def copies(seed: int, row_key: Column, rate: Column) -> Column:
    draws = F.greatest(F.lit(1), F.ceil(rate / CHUNK).cast("int"))
    each = F.transform(F.sequence(F.lit(1), draws), lambda d: poisson(uniform(F.lit(seed), F.lit("n"), d.cast("string"), row_key), rate / draws))
    return F.when(rate > 0, F.aggregate(each, F.lit(0), lambda a, n: a + n)).otherwise(0)


def tempered(docs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Target weights in proportion to the power ``alpha`` of each source's rows: 1 keeps the mix, 0 makes it even."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("weight"))


def source_rates(docs: DataFrame, weights: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, rate) for sources that occur; ``weights`` (source, weight) are scaled to sum to 1 over these."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    both = counts.alias("a").join(weights.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    both = both.select("a.source", "n", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    both = stage(both, "source-counts")
    total = both.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rows, weight = total["n"] or 0, total["w"] or 0.0
    share = F.col("weight") * F.lit(float(rows if budget is None else budget)) / F.lit(weight or 1.0)
    return both.select("source", "n", (share / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame, budget: int | None = None, seed: int = 0, rows_per_shard: int = 5_000) -> DataFrame:
    """All columns of ``docs`` (doc_id, source, ...) plus replica (from 0), rate, shard and shuffle_key.

    ``budget`` is the expected number of rows, by default that of ``docs``. A null source is a source of its own. A
    source without weight has rate 0 and leaves, as its target asks. A null doc_id is replaced in the hashes by the
    text's MD5. Rows with equal doc_id draw equal counts. Null or empty texts are rows as any. Columns named as the
    four new ones are replaced. Empty table: no rows.
    """
    rates = source_rates(docs, weights, budget)
    size = rates.agg(F.count(F.lit(1)).alias("sources"), F.sum(F.col("n") * F.col("rate")).alias("rows")).first()
    shards = parts(int(round(size["rows"] or 0)), rows_per_shard)
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", key)
    rates = rates.select(F.col("source").alias("rate_source"), "rate")
    same = F.col("row.source").eqNullSafe(F.col("rate_source"))
    if size["sources"] <= BROADCAST_SOURCES:
        rated = packed.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = packed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("rate_salt")))
    drawn = rated.withColumn("copies", copies(seed, F.col("key"), F.col("rate"))).where("copies > 0")
    drawn = drawn.select("row", "key", "rate", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("s"), F.col("replica").cast("string"), F.col("key"))), 1, 13), 16, 10).cast("long")
    drawn = drawn.withColumn("shuffle_key", bits).withColumn("shard", F.floor(F.col("shuffle_key") / F.lit(UNIT) * shards).cast("int"))
    shuffled = drawn.repartition("shard").sortWithinPartitions("shard", "shuffle_key")
    return shuffled.select(*others(docs, "row", ["replica", "rate", "shard", "shuffle_key"]), "replica", "rate", "shard", "shuffle_key")
