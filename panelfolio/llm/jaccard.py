"""Jaccard join on five-word shingles with Bayesian candidate pruning.

Texts of equal shingle sets are one node. Nodes that agree on all ``ROWS`` MinHash values of a band share a bucket, and the
pairs of a bucket are the candidates. A pair belongs to the first band it agrees in, so none is looked at twice. Its
MinHash values are compared ``STEP`` at a time; with m of n equal and a uniform prior, the chance that its similarity reaches the
threshold is P(Binomial(n + 1, threshold) <= m), and the pair is dropped once that falls below ``TOLERANCE``. What is left is
verified on the shingle sets themselves.

No pair ever becomes a row. Large buckets are dealt into blocks of about ``BLOCK`` nodes by hash and every two blocks meet in a task, which compares
in arrays and returns, per node, how many links it has and the smallest node it hangs together with. So rows grow with nodes, also in a bucket of near copies.
The first pass ships MinHash values only; texts go only to blocks in which they have a surviving partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import stage
from panelfolio.llm.components import components

WORDS = 5
THRESHOLD = 0.8
HASHES, ROWS, STEP = 96, 4, 16
BANDS = HASHES // ROWS
TOLERANCE = 1e-6
BLOCK = 512
PAIRS_AT_ONCE = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = np.random.default_rng(20240501).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = 2**63 - 1  # a null doc_id comes after all others


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of the lower-case text; one hash of all words if there are fewer than n."""
    tokens = (text or "").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for j in range(min(words, len(h))):
        out = (out ^ h[j : j + n]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, (s[at : at + 4096, None] * MULTIPLIERS).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def fewest_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m equal ones is dropped."""
    out = []
    for n in range(step, hashes + 1, step):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signed_texts(docs: DataFrame) -> DataFrame:
    """(doc, text_key, node, size, signature) of every row; doc and text_key find the text again."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc": batch["doc"], "text_key": batch["text_key"], "node": node, "size": np.array([len(s) for s in sets], "int32"),
                                "signature": [signature(s).tobytes() for s in sets]})

    return rows.withColumn("text_key", F.xxhash64("text")).mapInPandas(run, "doc long, text_key long, node long, size int, signature binary")


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that no group of (bucket, lo, hi) is torn."""
    rest = None
    for batch in batches:
        batch = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        key = batch[["bucket", "lo", "hi"]].to_numpy()
        last = np.flatnonzero((key != key[-1]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _pairs(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside a group, of different blocks if the group is of two, so many at once."""
    key = rows[["bucket", "lo", "hi"]].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    ends = np.append(np.flatnonzero(new)[1:], len(rows))[np.cumsum(new) - 1]
    after = ends - np.arange(len(rows)) - 1
    block, cross = rows["block"].to_numpy(), (rows["lo"] != rows["hi"]).to_numpy()
    total = np.cumsum(after)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = after[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        kept = ~cross[left] | (block[left] != block[right])
        yield left[kept], right[kept]
        at = stop


def surviving(rows: pd.DataFrame, threshold: float, steps: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidate pairs of ``rows`` (bucket, lo, hi, block, band, node, size, signature) that pruning leaves."""
    signs = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(-1, HASHES)
    size, band, node = rows["size"].to_numpy(), rows["band"].to_numpy(), rows["node"].to_numpy()
    for left, right in _pairs(rows):
        a, b = size[left], size[right]
        kept = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9) & (node[left] != node[right])
        left, right = left[kept], right[kept]
        equal = np.zeros(len(left), np.int32)
        for n, m in steps:
            equal += (signs[left, n - STEP : n] == signs[right, n - STEP : n]).sum(1, dtype=np.int32)
            kept = equal >= m
            left, right, equal = left[kept], right[kept], equal[kept]
        if len(left):
            agree = (signs[left] == signs[right]).reshape(-1, BANDS, ROWS).all(2)
            kept = agree.argmax(1) == band[left]
            yield left[kept], right[kept]


def _verified(rows: pd.DataFrame, threshold: float, steps: list[tuple[int, int]]) -> pd.DataFrame:
    """(node, root, links, partners) of the rows that have a partner: exact similarity of surviving pairs."""
    sets = [shingles(t) for t in rows["text"]]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
    links, partners, root = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in surviving(rows, threshold, steps):
        for i, begin, end in zip(*_runs(left)):
            own = flat[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            mates = right[begin:end]
            for at in range(0, len(mates), 1000):
                some = mates[at : at + 1000]
                n = sizes[some]
                place = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.add.reduceat(mark[flat[place]], np.cumsum(n) - n, dtype=np.int64)
                linked = some[shared / (sizes[i] + n - shared) >= threshold]
                np.add.at(links, linked, copies[i])
                np.add.at(partners, linked, 1)
                links[i] += copies[linked].sum()
                partners[i] += len(linked)
                for j in linked.tolist():
                    a, b = top(i), top(j)
                    if a != b:
                        small, large = (a, b) if node[a] < node[b] else (b, a)
                        root[large] = small
            mark[own] = False
    found = np.flatnonzero(partners)
    return pd.DataFrame({"node": node[found], "root": node[[top(i) for i in found.tolist()]] if len(found) else node[found], "links": links[found], "partners": partners[found]})


def _runs(left: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(left):
        return [], [], []
    begins = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
    return left[begins].tolist(), begins.tolist(), np.append(begins[1:], len(left)).tolist()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, class_id, n_links, copies, partners, doc, text_key, first.

    class_id is the smallest doc_id that links of at least ``threshold`` reach; n_links counts the other rows whose similarity with this one
    reaches it, copies those of equal shingle sets with itself, partners the linked different sets. ``first`` marks the row that a
    class keeps: the one of smallest doc_id (with text_key where ids repeat).

    Null text: as empty. Texts without words are copies of each other and have no other link. Null doc_id: linked as any, not a class id unless the class
    has no other (then null). Repeated rows: copies. Empty table: no rows. Sets are compared by 64-bit hashes.
    """
    signed = stage(signed_texts(docs), "jaccard-signed")
    nodes = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "text_key")).alias("source"),
                                       F.first("size").alias("size"), F.first("signature").alias("signature"))
    nodes = stage(nodes, "jaccard-nodes")
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("signature", 1 + b * ROWS * 4, ROWS * 4), F.lit(b)).alias("bucket")) for b in range(BANDS)])).alias("b")
    banded = nodes.where("size > 0").select("node", band).select("node", "b.band", "b.bucket")
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = banded.join(counts, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    met = placed.select("bucket", "band", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = met.select("bucket", "band", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    members = members.join(nodes.select("node", "size", "signature"), "node")
    steps = fewest_matches(threshold, tolerance)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            kept = np.zeros(len(rows), bool)
            for left, right in surviving(rows, threshold, steps):
                kept[left] = kept[right] = True
            yield rows.loc[kept, ["bucket", "lo", "hi", "block", "band", "node"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            yield _verified(rows.drop_duplicates(["bucket", "lo", "hi", "node"], ignore_index=True), threshold, steps)

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")

    held = stage(grouped(members).mapInPandas(prune, "bucket long, lo int, hi int, block int, band int, node long"), "jaccard-held")
    sources = held.select("node").distinct().join(nodes, "node").select("node", "copies", "size", "signature", "source.*")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text")).join(sources, ["doc", "text_key"]).drop("doc", "text_key")
    found = stage(grouped(held.join(texts, "node")).mapInPandas(verify, "node long, root long, links long, partners long"), "jaccard-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    roots = components(found.select("node", "root"))
    known = nodes.select("node", "copies", "source").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    known = stage(known, "jaccard-known")
    classes = known.groupBy("root").agg(F.min("source").alias("class"))
    known = known.join(classes, "root").select("node", "copies", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("partners", F.lit(0)).alias("partners"))
    out = signed.select("doc", "text_key", "node").join(known, "node")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), real("class.doc").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies", "partners",
                      "doc", "text_key", (F.struct("doc", "text_key") == F.col("class")).alias("first"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, columns unchanged; of repeated first rows one stays."""
    kept = near_duplicates(docs, threshold).where("first").select("doc", "text_key").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("text_key"))
    return key.join(kept, ["doc", "text_key"]).groupBy("doc", "text_key").agg(F.first("row").alias("row")).select("row.*")
