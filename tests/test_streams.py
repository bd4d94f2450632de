"""The order stream with timers: every order once, across restarts, like a direct count."""

import datetime as dt
import random

from panelfolio.streaming import monitors as SM

T0 = dt.datetime(2024, 1, 1)
ROW = "kind string, id long, acct long, ts timestamp, shares long"


def test_orders_come_out_at_their_limit_across_restarts(spark, tmp_path):
    rng = random.Random(7)
    batches, orders, fills = [], [], []
    for b in range(4):
        rows = []
        for i in range(60):
            at = T0 + dt.timedelta(seconds=b * 600 + rng.randint(-100, 500))  # out of order within the watermark
            acct = rng.randint(1, 5)
            if rng.random() < 0.4:
                orders.append((b * 100 + i, acct, at, rng.randint(1, 9)))
                rows.append(("order", *orders[-1]))
            else:
                fills.append((acct, at, rng.randint(1, 5)))
                rows.append(("fill", None, *fills[-1]))
        batches.append(rows)
    source, ends, out, check = (str(tmp_path / n) for n in ("in", "ends", "out", "check"))
    (tmp_path / "ends").mkdir()

    def run():
        e = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        stream = SM.order_events(e.where("kind = 'order'").withColumnRenamed("id", "order_id"), e.where("kind = 'fill'"), SM.end_marks(spark, ends))
        SM.run_released(SM.released_orders(stream, "60 seconds", "5 minutes"), out, check).awaitTermination()
        return spark.read.schema(SM.RELEASED).parquet(out).collect()

    seen = []
    for rows in batches:  # every run is a restart from the checkpoint
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        seen.append(len(run()))
    assert 0 < seen[-1] < len(orders) and seen == sorted(seen)
    SM.mark_end(spark, ends)
    got = {r.order_id: (r.acct, r.ordered, r.filled, r.complete) for r in run()}
    want = {}
    for i, acct, at, n in orders:
        filled = sum(s for a, t, s in fills if a == acct and at <= t <= at + dt.timedelta(seconds=60))
        want[i] = (acct, n, filled, filled >= n)
    assert got == want and len(run()) == len(orders)


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    rows = [(f"a{i}", T0 + dt.timedelta(seconds=i), float(i)) for i in range(500)]
    batches = [rows, [("a3", T0 + dt.timedelta(days=1), 7.0), ("a4", T0 - dt.timedelta(days=1), 9.0)], [("new", T0, 1.0)]]
    want = {}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "asset string, ts timestamp, quote double").coalesce(1).write.mode("append").parquet(source)
        quotes = spark.readStream.schema("asset string, ts timestamp, quote double").parquet(source)
        SM.drift_monitor(quotes, state, check).awaitTermination()
        for a, at, q in batch:
            want[a] = max(want.get(a, (at, q)), (at, q))
        assert {r.asset: (r.ts, r.quote) for r in SM.latest_quotes(spark, state).collect()} == want
        written = {p.name for p in (tmp_path / "state" / "data" / f"version={k}").glob("bucket=*")}
        assert len(written) == SM.BUCKETS if k == 0 else 1 <= len(written) <= len(batch)


def test_a_replayed_batch_gives_the_same_table(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "asset string, ts timestamp, quote double"
    spark.createDataFrame([("a", T0, 1.0), ("b", T0, 2.0)], schema).coalesce(1).write.parquet(source)
    for check in ("c1", "c2"):  # a lost checkpoint replays batch 0
        SM.drift_monitor(spark.readStream.schema(schema).parquet(source), state, str(tmp_path / check)).awaitTermination()
        assert {(r.asset, r.quote) for r in SM.latest_quotes(spark, state).collect()} == {("a", 1.0), ("b", 2.0)}
