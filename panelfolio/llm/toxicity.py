"""Toxicity by class-conditional Kneser-Ney models over symbol n-grams.

Texts are lower-cased and written in 32 symbols: letters, digits, blank, other, accented letters as two symbols. A letter of another
script is one of the 26 letters by its code point, a syllable or an ideograph two of them, so words of every script
differ as words do. Two interpolated
Kneser-Ney models of order 5 are built from labelled rows, one of toxic and one of ordinary texts: raw counts at order 5,
continuation counts of the class at orders 4 and 3. Below these both classes share one backoff: continuation counts at
orders 2 and 1 over all documents. A text's score is the difference of its two log-likelihoods, divided by its length
plus ``SOFT`` symbols, mapped to a probability by isotonic regression on cross-fitted scores of all labelled rows.

Five symbols of five bits are 2^25 possible n-grams, a bound that no corpus moves: counts are summed per n-gram on the
executors and broadcast; each worker makes the table of log ratios (contexts seen in training, and order 4 for the rest) from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.calibration import Curve, curve_of
from panelfolio.llm.common import stage

ORDER = 5
A = 32  # symbols
SOFT = 30.0
DISCOUNT = 0.75
BINS = 4096
TOXIC, ORDINARY, ALL = 1, 0, 2
CHUNK = 2_000_000  # symbols handled at once in a task


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol of every code point (NONE: no second)."""
    first, second = np.full(0x110000, 28, np.uint8), np.full(0x110000, NONE, np.uint8)
    for c in range(128):
        char = chr(c)
        first[c] = ord(char.lower()) - 96 if char.isalpha() else 27 if char.isdigit() else 0 if char.isspace() else 28
    first[[0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 0
    latin = np.arange(0xC0, 0x250)
    first[latin], second[latin] = 29, 30 + latin % 2
    for low, high in LETTERS:
        code = np.arange(low, high)
        first[code] = 1 + code % 26
        if low >= IDEOGRAPHS:
            second[code] = 1 + code // 26 % 26
    return first, second


NONE = 255
# Code points taken as letters outside Latin script; punctuation, symbols and emoji between them are not. From IDEOGRAPHS on a
# letter is a syllable or a word.
LETTERS = ((0x250, 0x2000), (0x2C00, 0x2E00), (0x2E80, 0x3000), (0x3005, 0x3008), (0x3021, 0x302A), (0x3031, 0x3036), (0x3041, 0xD800), (0xF900, 0xFE00), (0xFE70, 0xFF00),
           (0xFF66, 0xFFE0), (0x10000, 0x1D000), (0x1E000, 0x1F000), (0x20000, 0x40000))
IDEOGRAPHS = 0x2E80
FIRST, SECOND = _symbols()


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code at every symbol of every text, four blanks before each, and the number of symbols per text."""
    raw = ["    " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(raw).encode("utf-32-le", "replace"), np.uint32)
    two = SECOND[points] != NONE
    place = np.arange(len(points)) + np.cumsum(two) - two
    s = np.empty(len(points) + int(two.sum()), np.int32)
    s[place] = FIRST[points]
    s[place[two] + 1] = SECOND[points[two]]
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    sizes = np.diff(np.append(place[starts] if len(raw) else [], len(s))).astype(np.int64) - 4
    code = s[: len(s) - 4].copy()
    for j in range(1, ORDER):
        code = code * A + s[j : len(s) - 4 + j]
    inside = np.ones(len(code), bool)  # the windows that begin in the last four symbols of a text run into the next one
    ends = np.cumsum(sizes + 4)[:-1]
    for j in range(1, 5):
        inside[ends - j] = False
    return code[inside], sizes


def chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of about CHUNK characters; a longer text is a slice of its own."""
    at, held = 0, 0
    for i, t in enumerate(batch["text"]):
        held += len(t or "") + 5
        if held >= CHUNK:
            yield batch.iloc[at : i + 1]
            at, held = i + 1, 0
    if at < len(batch):
        yield batch.iloc[at:]


def _counted(texts: DataFrame, order: int) -> DataFrame:
    """(kind, gram, n): n-grams of ``order`` of (kind, text), counted in each task and summed by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, rows in batch.groupby("kind"):
                for part in chunks(rows):
                    codes, _ = grams(part["text"].tolist())
                    gram, n = np.unique(codes % A**order, return_counts=True)
                    yield pd.DataFrame({"kind": kind, "gram": gram.astype("int32"), "n": n})

    return texts.mapInPandas(run, "kind int, gram int, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def _collected(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, grams and counts as arrays. They travel as bytes, a row a batch: a table of as many rows takes the driver many times their size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: pa.array([np.asarray(batch.column(c)).astype(t).tobytes()], pa.binary()) for c, t in PACKED.items()}
            yield pa.RecordBatch.from_pydict(columns)

    rows = counted.select(*PACKED).mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED)).collect()
    return tuple(np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)]) for c, t in PACKED.items())


PACKED = {"kind": "int16", "gram": "int32", "n": "int64"}


@dataclass
class Model:
    """(grams, counts) of each class and the shared order-2 distribution; small, while the table of log ratios is made where it is used.

    The table has a row for each context: contexts never seen use their last 3 symbols.
    """

    counts: dict[int, tuple[np.ndarray, np.ndarray]]
    shared: np.ndarray
    curve: Curve = field(default_factory=Curve)

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "shared": self.shared, "curve": self.curve}

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of every context, and the log ratios of the next symbol, row by row. Without both classes every ratio is 0."""
        return tabulate(self.counts, self.shared) if set(self.counts) == {TOXIC, ORDINARY} else (np.zeros(A**4, np.int32), np.zeros(A, np.float32))

    def lengthwise(self, texts: list[str | None]) -> np.ndarray:
        row_of, table = self.dense
        codes, sizes = grams(texts)
        ratio = table[row_of[codes >> 5].astype(np.int64) * A + (codes & 31)]
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(ratio.astype(np.float64), starts) / (sizes + SOFT) if len(sizes) else np.zeros(0)


def _interpolate(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted shares of each row of ``counts``, the discount going to ``lower`` of the same shape."""
    total = counts.sum(1, keepdims=True)
    kinds = (counts > 0).sum(1, keepdims=True)
    share = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1)
    return np.where(total > 0, share, lower)


def _left_kinds(seen: np.ndarray, order: int) -> np.ndarray:
    """Continuation counts of all n-grams of ``order``, from the distinct codes of the order above."""
    return np.bincount(np.unique(seen) % A**order, minlength=A**order).astype(np.float64)


def shared_backoff(trigrams: np.ndarray) -> np.ndarray:
    """Order-2 distribution (last symbol, next) from the distinct trigrams of all documents."""
    two = _left_kinds(trigrams, 2).reshape(A, A)
    one = ((two > 0).sum(0) + 0.5) / ((two > 0).sum() + 0.5 * A)
    return _interpolate(two, np.broadcast_to(one, (A, A)))


def tabulate(counts: dict[int, tuple[np.ndarray, np.ndarray]], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of contexts and the table of log ratios from (grams, counts) of each class and the shared order-2 distribution."""
    logs4, classes = [], []
    for kind in (TOXIC, ORDINARY):
        codes, n = counts.get(kind, (np.zeros(0, np.int64), np.zeros(0)))
        three = _interpolate(_left_kinds(np.unique(codes % A**4), 3).reshape(-1, A), np.tile(shared, (A, 1)))
        four = _interpolate(_left_kinds(codes, 4).reshape(-1, A), np.tile(three, (A, 1)))
        logs4.append(np.log(four))
        classes.append((codes, n, four))
    contexts = np.unique(np.concatenate([codes // A for codes, _, _ in classes]))
    table = np.empty((A**3 + len(contexts), A), np.float32)
    table[: A**3] = logs4[0] - logs4[1]
    for at in range(0, len(contexts), 2**15):  # blocks bound what is in memory besides the table
        some = contexts[at : at + 2**15]
        logs5 = []
        for codes, n, four in classes:
            lo, hi = np.searchsorted(codes, [some[0] * A, (some[-1] + 1) * A])
            raw = np.zeros((len(some), A))
            raw[np.searchsorted(some, codes[lo:hi] // A), codes[lo:hi] % A] = n[lo:hi]
            logs5.append(np.log(_interpolate(raw, four[some % A**3])))
        table[A**3 + at : A**3 + at + len(some)] = logs5[0] - logs5[1]
    table = table.reshape(-1)
    row_of = (np.arange(A**4) % A**3).astype(np.int32)
    row_of[contexts] = A**3 + np.arange(len(contexts))
    return row_of, table


def train(docs: DataFrame, labels: DataFrame, learn: Column, folds: int = 3) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic). Only rows where ``learn`` (a column over doc_id) is true
    give labels. All of them are counted; the curve is cross-fitted: a row of a fold (by a hash of its id) is scored by counts
    of the other folds.

    A label is used once per doc_id, the largest where they differ; null labels are none. Without any labelled row of a
    class both models fall back to the shared counts, and every score is the same."""
    spark = docs.sparkSession
    marks = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("kind"))
    mine = docs.select("doc_id", "text").where(learn & F.col("doc_id").isNotNull())
    # labels grow with the documents, so this is a shuffled join whatever their size
    labelled = mine.join(marks.hint("merge"), "doc_id").select("kind", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"), "text")
    labelled = stage(labelled, "toxicity-labelled")  # read for the counts and again for the curve
    shared_rows = _collected(_counted(docs.select(F.lit(ALL).alias("kind"), "text"), 3))[1].astype(np.int64)  # at most 32^3
    # at most 2 * folds * 32^5, in practice the n-grams of the languages
    kind, gram, n = _collected(_counted(labelled.select((F.col("kind") + 2 * F.col("fold")).alias("kind"), "text"), ORDER))
    order = np.argsort(gram, kind="stable")
    gram, n, kind = gram[order], n[order], kind[order]
    shared = shared_backoff(shared_rows)

    def fitted(without: int | None = None) -> Model:
        counts = {}
        for k in (TOXIC, ORDINARY):
            mine = (kind % 2 == k) & (kind // 2 != without if without is not None else True)
            if mine.any():
                codes = gram[mine]
                first = np.flatnonzero(np.diff(codes, prepend=-1))
                counts[k] = (codes[first], np.add.reduceat(n[mine], first))
        return Model(counts, shared)

    width = 1.0 / 2048
    points = []
    for fold in range(folds):
        sent = spark.sparkContext.broadcast(fitted(without=fold))

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in chunks(batch):
                    x = sent.value.lengthwise(part["text"].tolist())
                    place = np.clip(np.round(x / width), -BINS // 2, BINS // 2).astype("int32")
                    yield pd.DataFrame({"kind": part["kind"].to_numpy("int32"), "bin": place})

        mine = labelled.where(F.col("fold") == fold).select("kind", "text")
        points.append(mine.mapInPandas(bins, "kind int, bin int").groupBy("kind", "bin").count().toPandas())
        sent.destroy(blocking=True)
    points = pd.concat(points)
    model = fitted()
    model.curve = curve_of(points, width)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text; others are ignored). Null text: as empty, whose one symbol is the blank
    after it. Null doc_id stays null, repeated rows are scored each, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch):
                p = sent.value.curve.probability(sent.value.lengthwise(part["text"].tolist()))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": p})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged; texts are scored where they are read."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{[n.lower() for n in names].index('text')}"

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            scored = [sent.value.curve.probability(sent.value.lengthwise(p["text"].tolist())) for p in chunks(t.to_frame("text"))]
            yield pd.Series(np.concatenate(scored) if scored else np.zeros(0))

    return plain.where(toxic(F.col(at).cast("string")) < threshold).toDF(*names)
