"""Embedding whitening with components found by spectrum slicing.

Entries become integers, so sums are exact. The covariance of the distinct vectors is summed centred, one matrix a task, and
its leading eigenpairs are found from the matrix alone (``spectrum``). Rows are projected where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfolio.llm import spectrum
from panelfolio.llm.common import others, stage

SCALE, SHIFT = 64, 1_000_000
ROWS = 4096  # rows of a block of a product
NEW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LIMIT = float(2**62)


def integer_vector(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry; null where the vector or an entry is null or not finite, or an entry is too large
    for a long."""
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(scaled(x)) >= LIMIT))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(scaled(x)).cast("long") + SHIFT))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten()).reshape(len(rows), size)


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs, or in Python's integers where these are too small."""
    largest = max([1, *map(abs, sums), n * int(np.abs(x.astype(float)).max(initial=0.0))])
    if largest < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled_deviation(x, n, sums) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of squares of n * x - S in every row, exact; null where a long is too small."""
    d = scaled_deviation(x, n, sums)
    if d.dtype != object and float(np.abs(d.astype(float)).max(initial=0.0)) ** 2 * max(1, d.shape[1]) < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (int(sum(int(e) ** 2 for e in row)) for row in d)]


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(0).slice(at, ROWS), size)


def _summed(fit: DataFrame, size: int, width: int, part) -> np.ndarray:
    """The sum of the vectors ``part(x)`` over blocks x of the fit list: one vector a task, added entry by entry."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for x in _batches(batches, size):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width)), "value": pa.array(total)})

    out = np.zeros(width)
    for r in fit.select("x").mapInArrow(gather, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sums of every dimension."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for x in _batches(batches, size):
            safe = float(np.abs(x.astype(float)).max(initial=0.0)) * len(x) < LIMIT
            total = total + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int64()), "s": pa.array(map(Decimal, total), pa.decimal128(38, 0))})

    summed = fit.select("x").mapInArrow(gather, "at long, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(summed)]


def _square(upper: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = upper
    return out + np.triu(out, 1).T


@dataclass
class Whitening:
    """``n`` distinct vectors with sums ``sums``; eigenvalues, eigenvectors (rows) and the trace of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def size(self) -> int:
        return len(self.sums)

    def usable(self) -> np.ndarray:
        """Eigenvalues that rounding alone does not explain."""
        return self.values > (self.size * spectrum.EPS * self.values.max(initial=0.0))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; nan along directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            w = centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.values)
        w[:, ~self.usable()] = np.nan
        return w


def fit(vectors: DataFrame, components: int = 16) -> Whitening:
    """The whitening of the distinct integer vectors ``x`` of that length which most of them have (the longer of equals)."""
    distinct = stage(vectors.select("x").distinct(), "whitening-fit")
    common = distinct.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, size = common["n"], common["size"]
    distinct = distinct.where(F.size("x") == size)
    sums = _sums(distinct, size)
    upper = np.triu_indices(size)

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)
        return (y.T @ y)[upper]

    covariance = _square(_summed(distinct, size, len(upper[0]), products), size) / n
    values, basis = spectrum.leading(covariance, components)
    out = Whitening(n, sums, values, basis, float(np.trace(covariance)))
    kept = out.usable()
    k = int(kept.sum())
    if k:
        mean = _summed(distinct, size, k, lambda x: out.project(x)[:, kept].sum(axis=0)) / n
        part = np.triu_indices(k)

        def spread(x: np.ndarray) -> np.ndarray:
            w = out.project(x)[:, kept] - mean
            return (w.T @ w)[part]

        out.identity_error = float(np.abs(_square(_summed(distinct, size, len(part[0]), spread), k) / n - np.eye(k)).max())
    return out


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """``embeddings`` (vec_id, embedding, ...) -> a row for each vector and component (vec_id, component, n, deviation, whitened,
    explained, identity_error), other columns kept but for those of these names and the embedding.

    Vectors that are null or hold null or non-finite entries leave, as do empty ones and entries of 2^56 or more, which no long
    holds. The length of the vectors is that of most distinct ones (the longer of equals); others leave too, since they
    share no space. Repeated rows and ids stay as rows, while the fit counts each distinct vector once. Equal eigenvalues
    get orthogonal components. Along directions without variance ``whitened`` is null. ``deviation`` is null where it
    exceeds a long. Fewer dimensions than ``components``: all. Empty table: no rows.
    """
    kept = [c for c in embeddings.columns if c.lower() != "embedding"]
    rows = embeddings.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), integer_vector(F.col("embedding")).alias("x"))
    rows = rows.where("x is not null and size(x) > 0")
    model = fit(rows, components)
    size, k = model.size, len(model.values)
    rows = rows.where(F.size("x") == size)
    explained = (model.values / model.trace if model.trace else np.zeros(k)).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            w = model.project(x)
            columns = {"row": batch.column("row"), "deviation": pa.array(deviations(x, model.n, model.sums), pa.int64()),
                       "whitened": pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, dtype=np.int32), pa.array(w.ravel(), mask=np.isnan(w.ravel())))}
            yield pa.RecordBatch.from_pydict(columns)

    if not k:
        return rows.where("false").select(*[F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in NEW.split(", "))])
    schema = f"row {rows.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>"
    done = rows.mapInArrow(project, schema).select("row", "deviation", F.posexplode("whitened").alias("at", "w"))
    shares = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    error = F.lit(model.identity_error).cast("double")
    return done.select(*others(embeddings.select(*[f"`{c}`" for c in kept]), "row", [p.split()[0] for p in NEW.split(", ")]),
                       F.col("row.vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       F.col("w").alias("whitened"), shares.alias("explained"), error.alias("identity_error"))
