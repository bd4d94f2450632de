import hashlib
import math
from collections import Counter

import pytest
from helpers import empty_documents, hard_documents, with_clashes
from pyspark.sql import functions as F

from panelfolio.llm import mixing


def count(seed, key, rate):
    if rate <= 0:
        return 0
    draws = max(1, math.ceil(rate / 64))
    total, lam = 0, rate / draws
    for d in range(1, draws + 1):
        u = (int(hashlib.md5(f"{seed}|n|{d}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-lam)
        k = 0
        while u >= c and p > 0:
            k += 1
            p *= lam / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("limit", [10_000, 0])
def test_counts_follow_the_inverted_distribution(spark, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)  # the salted join must give the same rows
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("hot", 0.1), ("s1", 5.0), ("s2", 1.0), ("s3", 0.0)], "source string, weight double")
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs, weights, budget=5000, seed=3).collect())
    n = Counter(r["source"] for r in docs.collect())
    share = {"hot": 0.1 / 6.1, "s1": 5 / 6.1, "s2": 1 / 6.1}
    want = {(r["doc_id"], r["source"]): count(3, r["doc_id"], 5000 * share.get(r["source"], 0) / n[r["source"]]) for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v}
    total = Counter()
    for (_, s), c in got.items():
        total[s] += c
    for s, w in share.items():
        assert abs(total[s] - 5000 * w) < 5 * math.sqrt(5000 * w)


def test_large_rates_and_replicas(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "doc_id long, source string, text string")
    rows = mixing.mix(docs, spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double"), budget=4000, seed=1).collect()
    for i, rate in ((1, 1000.0), (2, 3000.0)):
        mine = sorted(r["replica"] for r in rows if r["doc_id"] == i)
        assert mine == list(range(count(1, i, rate))) and abs(len(mine) - rate) < 6 * math.sqrt(rate)


def test_order_is_global_and_hard_rows_pass(spark):
    docs = with_clashes(hard_documents(spark), ["replica", "row", "key", "rate", "salt"])
    rows = mixing.mix(docs, mixing.tempered(docs, 1.0), budget=400, seed=5, rows_per_shard=50).collect()
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "row", "key", "salt", "replica", "rate", "shard", "shuffle_key"}
    shards = max(r["shard"] for r in rows) + 1
    assert shards <= 8 and sorted(rows, key=lambda r: r["shuffle_key"]) == sorted(rows, key=lambda r: (r["shard"], r["shuffle_key"]))
    assert {r["source"] for r in rows} == {"a", "b", None}
    same = Counter(r["replica"] for r in rows if r["doc_id"] == 5)
    assert set(same.values()) <= {2}  # repeated rows draw equal counts
    assert mixing.mix(empty_documents(spark), mixing.tempered(empty_documents(spark))).count() == 0
