"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On each level neighbouring equal names form phrases of ``RUN``; elsewhere deterministic coin tossing labels each
name by the lowest bit in which it differs from its left neighbour, three rounds bring the labels below 8, and a phrase begins where
the label is a local maximum. A phrase's name is a hash of the names in it, so names depend on content and a few neighbours, never on an
offset: equal substrings get equal phrases but for a margin at their ends.

The fingerprint is a bottom-``KEPT`` sketch of the names of level ``FIRST`` and above: the smallest hashes, in hexadecimal. A name that a text has
several times counts as often. The likeness of two fingerprints estimates the Jaccard similarity of the two multisets of phrases; equal texts have
equal fingerprints.

Texts are dealt by ranges of doc_id, so that a text's successor is the next row of its task; each range also gets the first row of the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import parts

LEVELS = 7
FIRST = 2  # names of about 6 code points and more
KEPT = 64
RUN = 4  # names of a run that make a phrase
CHUNK = 400_000  # code points parsed at once
ROWS_PER_RANGE = 4_000
ROUNDS = 3
U = np.uint64
FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tossed(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below 8 in which a name differs from its left neighbour, if the names do; texts begin at ``starts``."""
    label = names
    for _ in range(ROUNDS):
        other = np.empty_like(label)
        other[1:] = label[:-1]
        other[starts] = ~label[starts]  # a text's first name differs in bit 0
        differ = label ^ other
        low = differ & (~differ + U(1))
        bit = np.bitwise_count(low - U(1)).astype(U)  # 64 where equal
        label = (bit << U(1)) | ((label >> np.minimum(bit, U(63))) & U(1))
    return label.astype(np.uint8)


def begins(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each name: at local maxima, at the ends of runs and every ``RUN`` names within one."""
    n = len(names)
    first = np.zeros(n, bool)
    first[starts] = True
    same = np.zeros(n, bool)
    same[1:] = names[1:] == names[:-1]
    same &= ~first
    label = tossed(names, starts)
    left = np.empty_like(label)
    left[1:], left[0] = label[:-1], 0
    right = np.empty_like(label)
    right[:-1], right[-1] = label[1:], 0
    peak = (label > left) & (label >= right)
    run_next = np.append(same[1:], False)  # this name begins or continues a run
    at = np.arange(n)
    in_run = at - np.maximum.accumulate(np.where(same, 0, at))
    out = peak & ~same & ~run_next
    out |= (same | run_next) & (in_run % RUN == 0)
    ended = np.zeros(n, bool)
    ended[1:] = same[:-1] & ~same[1:]
    return out | ended | first


def parsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and where each text begins among them."""
    at = np.flatnonzero(begins(names, starts))
    length = np.diff(np.append(at, len(names)))
    place = np.arange(len(names)) - np.repeat(at, length)
    # a name's hash together with its place in the phrase; sums of these name the phrase
    terms = mixed(names + (place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(terms, at) ^ (length.astype(U) << U(48))), np.searchsorted(at, starts)


def sketches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The sorted smallest ``KEPT`` phrase names (32 bits) of each text of code points; an empty text has none."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if len(t)]
    if not full:
        return out
    sizes = np.array([len(texts[i]) for i in full])
    names, starts = mixed(np.concatenate([texts[i] for i in full]).astype(U) + U(1)), np.cumsum(sizes) - sizes
    found, owner = [], []
    for level in range(1, LEVELS + 1):
        names, starts = parsed(names, starts)
        if level >= FIRST:
            found.append((mixed(names + U(level)) >> U(32)).astype(np.uint32))
            owner.append(np.repeat(np.arange(len(full), dtype=np.int64), np.diff(np.append(starts, len(names)))))
    key = np.sort((np.concatenate(owner) << 32) | np.concatenate(found))
    at = np.arange(len(key))
    again = at - np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))  # how often the text had the name before
    numbered = (mixed((key & 0xFFFFFFFF).astype(U) + (again.astype(U) << U(32))) >> U(32)).astype(np.int64)
    key = np.unique((key >> 32 << 32) | np.where(again > 0, numbered, key & 0xFFFFFFFF))
    ends = np.searchsorted(key, np.arange(1, len(full) + 1, dtype=np.int64) << 32)
    begin = 0
    for i, end in zip(full, ends.tolist()):
        out[i] = (key[begin : min(end, begin + KEPT)] & 0xFFFFFFFF).astype(np.uint32)
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest names of both texts together that both have; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    equal = both[1:] == both[:-1]
    distinct = len(both) - int(equal.sum())
    k = min(KEPT, distinct)
    if distinct > k:
        limit = both[np.flatnonzero(np.append(True, ~equal))[k - 1]]
        return int((both[1:][equal] <= limit).sum()) / k
    return int(equal.sum()) / k


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _in_ranges(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """(range, sentinel, doc, text): every row in its range of doc_id, and the first row of the next range as a sentinel; the
    first of all follows the last. Only range bounds and each range's smallest id pass through the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc")
    n = parts(ids.count(), rows_per_range)
    bounds = sorted(set(ids.approxQuantile("doc", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    bounds = [int(b) for b in bounds]
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("doc"))) if bounds else F.lit(0)
    ranged = lambda df: df.withColumn("range", F.when(F.col("doc").isNull(), -1).otherwise(at).cast("int"))
    firsts = ranged(ids).groupBy("range").agg(F.min("doc").alias("doc")).orderBy("range").collect()  # one row a range
    before = [(r["doc"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    to = F.broadcast(spark.createDataFrame(before, "first long, range int"))
    heads = rows.join(to, F.col("doc").eqNullSafe(F.col("first"))).groupBy("range").agg(F.min("text").alias("text"), F.first("doc").alias("doc"))
    own = ranged(rows).select("range", F.lit(0).alias("sentinel"), "doc", "text")
    return own.unionByName(heads.select("range", F.lit(1).alias("sentinel"), "doc", "text"))


def fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``FINGERPRINTS`` of every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents follow one another by ascending doc_id, null ids first and equal ids by text; the first follows the last. Null text: as empty, whose
    fingerprint is the empty string. A single document follows itself. Repeated rows: one result each. Empty table: no rows.
    """
    dealt = _in_ranges(docs, rows_per_range).repartition("range").sortWithinPartitions("range", "sentinel", "doc", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            at, held = 0, 0
            for i in range(len(batch) - 1):
                held += len(batch["text"].iat[i]) + 1
                if held >= CHUNK:
                    yield _results(batch.iloc[at : i + 2])
                    at, held = i + 1, 0
            rest = batch.iloc[at:].reset_index(drop=True)  # its last row still waits for its successor
        if rest is not None:
            yield _results(rest)

    return dealt.mapInPandas(run, FINGERPRINTS)


def _results(rows: pd.DataFrame) -> pd.DataFrame:
    """Results of all rows but the last; sentinels, and rows of another range behind them, only serve the row before."""
    texts, mine = rows["text"].tolist(), np.flatnonzero(rows["sentinel"].to_numpy()[:-1] == 0).tolist()
    changed = [edited(texts[i], texts[i + 1]) for i in mine]
    own = sketches([code_points(t) for t in texts])
    other = sketches([code_points(t) for t in changed])
    return pd.DataFrame({
        "doc_id": rows["doc"].iloc[mine].astype("Int64").reset_index(drop=True),
        "n_chars": np.array([len(texts[i]) for i in mine], "int64"),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
        "fingerprint": [written(own[i]) for i in mine],
        "edited_fingerprint": [written(s) for s in other],
        "near_edited": np.array([likeness(own[i], s) for i, s in zip(mine, other)], float),
        "near_next": np.array([likeness(own[i], own[i + 1]) for i in mine], float),
    })
