"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows: term t is the position, its weight the value. Candidates are dealt into blocks by a hash of their id,
queries likewise, and every query block meets every candidate block once; no pair of vectors becomes a row. Within such
a task the candidate block is inverted to postings (term -> places, weights); each term of the queries scatters its
weighted postings into a dense array of scores, query by place. Partition selection keeps the k best of each row, and a
window over the per-block winners merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.llm.common import parts

TOP = "query_id long, vec_id long, score long"
NO_ID = np.iinfo(np.int64).max


def integer_terms(vector: Column, scale: int) -> Column:
    """floor(scale * x) for every component, as double; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of every non-zero entry of a list column."""
    rows = column.combine_chunks()
    lengths = np.diff(np.asarray(rows.offsets))
    values = np.asarray(rows.flatten())
    row = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = values != 0
    return row[kept], position[kept], values[kept]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().fill_null(NO_ID))


def block_top(queries: pa.Table, block: pa.Table, k: int, rows_at_once: int = 64) -> dict[str, np.ndarray]:
    """The k best of one candidate block for each query of one query block, ties at the border to smaller ids."""
    ids, asked = _ids(block["vec_id"]), _ids(queries["vec_id"])
    order = np.argsort(ids, kind="stable")
    rank_of = np.empty(len(ids), np.int64)
    rank_of[order] = np.arange(len(ids))
    ids = ids[order]
    place, term, weight = _flat(block["terms"])
    by_term = np.lexsort((rank_of[place], term))
    place, term, weight = rank_of[place][by_term], term[by_term], weight[by_term]
    q_row, q_term, q_weight = _flat(queries["terms"])
    q_order = np.lexsort((q_row, q_term))
    q_row, q_term, q_weight = q_row[q_order], q_term[q_order], q_weight[q_order]
    first = np.searchsorted(term, np.arange((term.max() if len(term) else -1) + 2))
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(asked), rows_at_once):
        scores = np.zeros((min(rows_at_once, len(asked) - at), len(ids)), np.int64)
        mine = (q_row >= at) & (q_row < at + rows_at_once)
        rows, terms, weights = q_row[mine] - at, q_term[mine], q_weight[mine]
        for t in np.unique(terms):
            if t + 1 >= len(first):
                break
            lo, hi = first[t], first[t + 1]
            sel = slice(np.searchsorted(terms, t), np.searchsorted(terms, t, "right"))
            scores[rows[sel][:, None], place[lo:hi]] += weights[sel][:, None] * weight[lo:hi]
        for row, line in enumerate(scores):
            left, right = np.searchsorted(ids, [asked[at + row], asked[at + row] + 1])  # its own row or rows
            places = np.concatenate([np.arange(left), np.arange(right, len(ids))]) if right > left else np.arange(len(ids))
            line = line[places]
            if len(line) > k:
                border = np.partition(line, len(line) - k)[len(line) - k]
                above = np.flatnonzero(line > border)
                level = np.flatnonzero(line == border)[: k - len(above)]  # places are in id order
                best = np.concatenate([above, level])
            else:
                best = np.arange(len(line))
            out_q.append(np.full(len(best), asked[at + row]))
            out_v.append(ids[places[best]])
            out_s.append(line[best])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return {"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)}


def exact_top(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = 2048, candidate_block: int = 4096) -> DataFrame:
    """``vectors`` (vec_id, embedding; other columns are ignored) -> query_id, rank from 1, vec_id, score.

    Vectors that are null or hold null or non-finite components take no part; an empty vector scores 0. Vectors of
    different length meet on the terms both have. A query's own id is no candidate. A null id is never a query; as a candidate it comes after
    all others of its score. Repeated rows are candidates each; a repeated query is asked once for each different
    vector, and the answers are ranked together. Fewer than k candidates: all. Empty table: no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integer_terms(F.col("embedding"), scale).alias("terms"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("terms is not null")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("asks").cast("long")).alias("asking")).first()
    blocks, query_blocks = parts(n["all"], candidate_block), parts(n["asking"] or 0, query_block)
    deal = lambda count, salt: F.pmod(F.xxhash64("vec_id", "terms", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where("asks and vec_id is not null").dropDuplicates(["vec_id", "terms"])
    queries = queries.select("vec_id", "terms", deal(query_blocks, 1).alias("qb"), every(blocks).alias("cb"))
    candidates = rows.select("vec_id", "terms", deal(blocks, 2).alias("cb"), every(query_blocks).alias("qb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = block_top(left, right, k) if left.num_rows and right.num_rows else dict.fromkeys(("query_id", "vec_id", "score"), np.zeros(0, np.int64))
        ids = pa.array(found["vec_id"], mask=found["vec_id"] == NO_ID)
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": ids.cast(pa.int64()), "score": pa.array(found["score"], pa.int64())})

    best = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, TOP)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
