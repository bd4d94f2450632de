import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfolio.llm import hnsw

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in {(i, tuple(v)): (i, v) for i, v in good}.values():
        if q is not None and q % 100 == 0:
            near = [(float(np.sqrt(((a - b) ** 2).sum())), math.inf if i is None else i) for i, b in good if i != q and len(a) == len(b)]
            out[q] = sorted(out.get(q, []) + near)[:k]
    return out


def answers(df, **options):
    out = {}
    for r in sorted(hnsw.nearest(df, F.col("vec_id") % 100 == 0, **options).collect()):
        out.setdefault(r["query_id"], []).append((r["score"], math.inf if r["vec_id"] is None else r["vec_id"]))
    return out


def test_recall_over_shards_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (8, 24))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.4, 24)]) for i in range(6000)]
    want, got = brute(rows, 10), answers(spark.createDataFrame(rows, SCHEMA), shard_rows=1500, query_block=20)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want) and set(got) == set(want)
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found)
        assert all(s == pytest.approx(np.linalg.norm(vectors[q] - vectors[i]), rel=1e-14) for s, i in found)


def test_copies_ties_bad_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [round(float(x), 3) for x in rng.normal(0, 1, 6)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)] + [(300, [0.5] * 6)] * 3 + [(301, [0.5, 0.5, 0.5, 0.5, 0.5, 0.6])] * 2
    rows += [(400, None), (401, [0.1, None]), (402, [math.nan] * 6), (403, [math.inf] * 6), (404, []), (500, [0.0] * 6), (600, [1.0, 2.0]), (601, [1.0, 3.0]),
             (None, [0.5] * 6), (700, [1e100] * 6), (701, [-1e100] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("shard", F.lit(2))
    assert answers(df, shard_rows=40, query_block=2) == brute(rows, 10)


def test_few_candidates_and_empty_table(spark):
    assert answers(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0])], SCHEMA)) == {0: [(2.0, 1)]}
    assert hnsw.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_flat_arrays_hold_the_graph():
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (700, 5)).astype(np.float32)
    g = hnsw.build_graph(v)
    again = hnsw.graph_of(v, g.tops, hnsw.flat_links(g), g.entry)
    assert all((a == b).all() for a, b in zip(g.layers, again.layers)) and len(g.layers) > 1
    for layer, lists in enumerate(g.layers):
        for node in np.flatnonzero(g.tops >= layer):
            linked = lists[node][lists[node] >= 0]
            assert len(set(linked)) == len(linked) and node not in linked and (g.tops[linked] >= layer).all()
