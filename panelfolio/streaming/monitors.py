"""Structured Streaming monitors: unfilled orders and price drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from panelfolio.operators.tradeops import DRIFT
from panelfolio.session import stage


def unfilled_orders(orders: DataFrame, fills: DataFrame, within: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Orders joined to the fills that follow inside the time bound; an order without any comes out once, unfilled.

    ``orders``: order_id, acct, ts, shares. ``fills``: acct, ts, shares. Both streams carry watermarks, so state is
    dropped once the bound has passed.
    """
    o = orders.select("order_id", F.col("acct").alias("o_acct"), F.col("ts").alias("order_ts"), F.col("shares").alias("ordered")).withWatermark("order_ts", late)
    f = fills.select(F.col("acct").alias("f_acct"), F.col("ts").alias("fill_ts"), F.col("shares").alias("filled")).withWatermark("fill_ts", late)
    on = F.expr(f"o_acct = f_acct and fill_ts >= order_ts and fill_ts <= order_ts + interval {within}")
    return o.join(f, on, "left_outer").select(
        "order_id", F.col("o_acct").alias("acct"), "order_ts", "ordered", "fill_ts", F.coalesce("filled", F.lit(0)).alias("filled"))


def with_waiting(matched: DataFrame, orders: DataFrame) -> DataFrame:
    """The sink of `unfilled_orders` and, unfilled, the orders that still waited for the watermark when the stream stopped."""
    waiting = orders.join(matched.select("order_id"), "order_id", "left_anti").select(
        "order_id", "acct", F.col("ts").alias("order_ts"), F.col("shares").alias("ordered"), F.lit(None).cast("timestamp").alias("fill_ts"),
        F.lit(0).cast("long").alias("filled"))
    return matched.unionByName(waiting)


def completeness(matched: DataFrame) -> DataFrame:
    """Batch roll-up of the sink of `unfilled_orders`."""
    out = matched.groupBy("order_id", "acct", "order_ts", "ordered").agg(F.sum("filled").alias("filled"))
    return out.withColumn("complete", F.col("filled") >= F.col("ordered"))


RELEASED = "order_id long, acct long, order_ts timestamp, ordered long, filled long, complete boolean"
PENDING = "order_id array<bigint>, order_us array<bigint>, ordered array<bigint>, filled array<bigint>, fill_us array<bigint>, shares array<bigint>"
EVENT = "kind string, id long, acct long, ts timestamp, shares long"
STORE = "spark.sql.streaming.stateStore.providerClass"
END = "2261-01-01"


class OrderBook(StatefulProcessor):
    """Orders of one account that wait for their limit, and fills that a later order may still claim.

    An order comes out once, by the event-time timer of its own limit, with all shares filled from its time to the limit. Fills older than the
    watermark leave, since no order that still counts could be older.
    """

    def __init__(self, within_us: int):
        self.within = within_us

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)

    def _load(self) -> list[np.ndarray]:
        held = self.pending.get()
        return [np.array(c, np.int64) for c in held] if held else [np.zeros(0, np.int64) for _ in range(6)]

    def _keep(self, columns: list[np.ndarray], watermark_us: int) -> None:
        order_us, fill_us = columns[1], columns[4]
        fresh = fill_us >= watermark_us
        columns = [*columns[:4], fill_us[fresh], columns[5][fresh]]
        if len(order_us) or fresh.any():
            self.pending.update(tuple(c.tolist() for c in columns))
            soonest = np.append(order_us + self.within, fill_us[fresh]).min()
            self.handle.registerTimer(int(soonest // 1000 + 1))
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order_id, order_us, ordered, filled, fill_us, shares = self._load()
        new = pd.concat(list(rows))
        us = new["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        is_order, is_fill = (new["kind"] == "order").to_numpy(), (new["kind"] == "fill").to_numpy()
        size = new["shares"].fillna(0).to_numpy(np.int64)
        new_fill, new_shares = us[is_fill], size[is_fill]
        filled = filled + self._between(order_us, new_fill, new_shares)  # old orders claim new fills
        fill_us, shares = np.concatenate([fill_us, new_fill]), np.concatenate([shares, new_shares])
        order_id, order_us = np.concatenate([order_id, new["id"].to_numpy(np.int64)[is_order]]), np.concatenate([order_us, us[is_order]])
        ordered = np.concatenate([ordered, size[is_order]])
        filled = np.concatenate([filled, self._between(us[is_order], fill_us, shares)])  # new orders all known ones
        self._keep([order_id, order_us, ordered, filled, fill_us, shares], max(0, timerValues.getCurrentWatermarkInMs()) * 1000)
        yield pd.DataFrame()

    def _between(self, order_us: np.ndarray, fill_us: np.ndarray, shares: np.ndarray) -> np.ndarray:
        order = np.argsort(fill_us, kind="stable")
        at, upto = fill_us[order], np.concatenate([[0], np.cumsum(shares[order])]).astype(np.int64)
        return upto[np.searchsorted(at, order_us + self.within, "right")] - upto[np.searchsorted(at, order_us, "left")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        columns = self._load()
        order_id, order_us, ordered, filled = columns[:4]
        out = order_us + self.within < watermark
        self._keep([c[~out] for c in columns[:4]] + columns[4:], watermark)
        if out.any():
            yield pd.DataFrame({"order_id": order_id[out], "acct": key[0], "order_ts": order_us[out].astype("datetime64[us]"), "ordered": ordered[out],
                                "filled": filled[out], "complete": filled[out] >= ordered[out]})


def order_events(orders: DataFrame, fills: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """One stream of ``orders`` (order_id, acct, ts, shares), ``fills`` (acct, ts, shares) and end marks (``EVENT``)."""
    none = F.lit(None).cast("long")
    o = orders.select(F.lit("order").alias("kind"), F.col("order_id").cast("long").alias("id"), F.col("acct").cast("long").alias("acct"), "ts", F.col("shares").cast("long").alias("shares"))
    f = fills.select(F.lit("fill").alias("kind"), none.alias("id"), F.col("acct").cast("long").alias("acct"), "ts", F.col("shares").cast("long").alias("shares"))
    return o.unionByName(f) if ends is None else o.unionByName(f).unionByName(ends)


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of end marks of a folder; `mark_end` writes one."""
    return spark.readStream.schema(EVENT).parquet(folder)


def mark_end(spark: SparkSession, folder: str) -> None:
    """Says that the input is complete: a mark far ahead in event time moves the watermark past every limit.

    What comes in a later batch than the mark is late, so it is written when all other input has been read or will be read in the same batch.
    """
    spark.createDataFrame([("end", None, -1, None, None)], "kind string, id long, acct long, ts timestamp, shares long").withColumn(
        "ts", F.lit(END).cast("timestamp")).write.mode("append").parquet(folder)


def released_orders(events: DataFrame, within: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Every order of ``events`` once, at its own limit: order_id, acct, order_ts, ordered, filled, complete.

    Keyed state with event-time timers: rows of an account meet in its state, whatever their order, up to ``late``. Run by
    `run_released`, which sets the state store that timers need.
    """
    seconds = events.sparkSession.sql(f"select unix_timestamp(timestamp '2000-01-01' + interval {within}) - unix_timestamp(timestamp '2000-01-01')").first()[0]
    watched = events.where("acct is not null and ts is not null").withWatermark("ts", late)
    return watched.groupBy("acct").transformWithStateInPandas(OrderBook(int(seconds) * 1_000_000), RELEASED, "append", "EventTime")


def run_released(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """`run_to_table` with the state store of timers; other streams of the session keep theirs."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_to_table(stream, path, checkpoint)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available into a parquet table and stop."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


BUCKETS = 64


def _versions(spark: SparkSession, state: str, epoch: int) -> dict[int, int]:
    """The version of every bucket after batch ``epoch``, from its manifest: at most ``BUCKETS`` rows."""
    if epoch < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{state}/manifest/epoch={epoch}").collect()}


def _folder(state: str, bucket: int, version: int) -> str:
    return f"{state}/data/version={version}/bucket={bucket}"


def _bucket_rows(spark: SparkSession, state: str, versions: dict[int, int]) -> DataFrame:
    """Rows of the given buckets (one at least), each of its version."""
    return spark.read.parquet(*[_folder(state, b, v) for b, v in sorted(versions.items())]).select("asset", "quote", "ts")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drift_monitor(quotes: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest quote per asset (of any type) in a table of hash buckets; a micro-batch writes only the buckets it touches.

    A batch is collapsed to one row per asset before it meets the table. It reads the buckets of the versions that the manifest of
    the batch before names, writes theirs under its own number and then its manifest, so a replayed batch gives the same
    table and readers see whole batches. What the batch before replaced is deleted, so old versions do not pile up. Of quotes of one time
    the largest stays.
    """
    newest = lambda rows: rows.groupBy("asset").agg(F.max(F.struct("ts", "quote")).alias("last")).select("asset", "last.quote", "last.ts")
    bucket = F.pmod(F.xxhash64("asset"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = stage(newest(batch), "quotes")
        touched = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]
        versions = _versions(spark, state, epoch - 1)
        before = {b: versions[b] for b in touched if b in versions}
        rows = newest(fresh.unionByName(_bucket_rows(spark, state, before))) if before else fresh
        rows.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/data/version={epoch}")
        named = {**versions, **dict.fromkeys(touched, epoch)}
        spark.createDataFrame(list(named.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{state}/manifest/epoch={epoch}")
        for b, v in _versions(spark, state, epoch - 2).items():  # a replay of this batch needs no more than the manifest before
            if versions.get(b) != v:
                _drop(spark, _folder(state, b, v))

    return (quotes.select("asset", F.col("quote").cast("double").alias("quote"), "ts").writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_quotes(spark: SparkSession, state: str) -> DataFrame:
    """The table of `drift_monitor` after its last whole batch."""
    last = spark.read.json(f"{state}/manifest").agg(F.max("epoch")).first()[0]
    return _bucket_rows(spark, state, _versions(spark, state, int(last)))


def drift_alerts(latest: DataFrame, closes: DataFrame, threshold: float = DRIFT) -> DataFrame:
    df = latest.join(closes.select("asset", "close"), "asset").withColumn("drift", (F.col("quote") - F.col("close")) / F.nullif(F.col("close"), F.lit(0.0)))
    return df.filter(F.abs("drift") >= threshold).select("asset", "ts", "close", "quote", "drift")
