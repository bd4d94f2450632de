import math

import numpy as np
from pyspark.sql import functions as F

from panelfolio.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i is not None and i % 100 == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b)), math.inf if i is None else i) for i, b in good if i != q]
        out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_against_brute_force_with_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [round(float(x), 2) for x in rng.normal(0, 0.1, 6)]) for i in range(350)]
    rows += [(400, [0.1] * 6), (401, [0.1] * 6), (402, [0.1] * 6), (402, [0.1] * 6), (403, None), (500, [0.1, None]), (404, [float("nan")] * 6),
             (405, [float("inf")] * 6), (406, []), (600, [0.5, 0.5]), (None, [0.3] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("terms", F.lit(1)).withColumn("asks", F.lit(2))
    got = topk.exact_top(df, F.col("vec_id") % 100 == 0, k=10, query_block=2, candidate_block=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)


def test_few_candidates_and_empty_table(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA)
    assert [tuple(r) for r in topk.exact_top(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.exact_top(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
