"""Quality by compression: Zstandard dictionaries of good and of bad texts.

Two dictionaries are trained from labelled texts. A text is cut into blocks of ``BLOCK`` bytes, so that the dictionary and
not the text's own beginning decides throughout, and every block is compressed with each dictionary. The difference of the
two compressed sizes, divided by the text's size, is positive for texts like the good ones; isotonic regression on other
labelled rows turns it into a score. (A logistic curve is thrown by the few good texts with very negative differences.)

A Zstandard dictionary has a fixed size whatever it is trained from, so training takes a bounded sample: ``SAMPLE`` labelled ids of
each class, those with the smallest hash, one text each, and of these in the same order as many whole texts as ``SAMPLE_BYTES``
hold. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.llm.calibration import Curve, curve_of

BLOCK = 1024
SAMPLE = 2_000  # labelled rows of each class that train a dictionary
SAMPLE_BYTES = 48 << 20  # of each class; a text beyond it by itself trains nothing
DICTIONARY = 112_640  # bytes
LEVEL = 3
SOFT = 64.0  # bytes added to a text's size, so that a few bytes do not decide
STEP = 1.0 / 4096
EDGE = 8192
CURVE = 3  # one learning id in so many sets the curve


def blocks(data: bytes) -> list[bytes]:
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained at ``DICTIONARY`` bytes, or at the first half, quarter and so on that the samples are enough for. Samples too
    few for any are a dictionary as they are, whole."""
    pieces = [b for s in samples for b in blocks(s)]
    size = DICTIONARY
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b"".join(pieces).ljust(8, b"\x00")


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: Curve = field(default_factory=Curve)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.bad, self.good):
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def difference(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> float:
    data = (text or "").encode("utf-8", "replace")
    bad, good = compressors
    gap = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(data))
    return gap / (len(data) + SOFT)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, quality). Only rows where ``learn`` (a column over doc_id) is true give
    labels: one in ``CURVE`` by hash sets the curve, so that this sees the classes in their true proportion; of the others
    the first ``SAMPLE`` of each class by another hash train the dictionaries. Very long texts are compressed whole, block by block.

    A label is used once per doc_id, the largest where they differ; null labels are none. Without labelled rows of both
    classes every score is 0.5."""
    marks = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("kind"))
    marks = marks.withColumn("place", F.xxhash64("doc_id", F.lit("quality"))).withColumn("sets_curve", F.pmod(F.xxhash64("doc_id"), F.lit(CURVE)) == 0)
    sample = None
    for kind in (0, 1):
        first = marks.where("not sets_curve").where(F.col("kind") == kind).orderBy("place", "doc_id").limit(SAMPLE)
        sample = first if sample is None else sample.unionByName(first)
    chosen = [(int(r["doc_id"]), int(r["kind"]), int(r["place"])) for r in sample.select("doc_id", "kind", "place").collect()]  # 2 * SAMPLE ids at most
    if {k for _, k, _ in chosen} != {0, 1}:
        return Model(b"\x00" * 8, b"\x00" * 8)
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, "doc_id long, kind int, place long")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn & F.col("doc_id").isNotNull())
    one = mine.join(F.broadcast(ids), "doc_id").groupBy("kind", "place", "doc_id").agg(F.min("text").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("kind").orderBy("place", "doc_id"))
    texts = one.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("kind", "doc_id", "text").toPandas()
    model = Model(*(dictionary([t.encode("utf-8", "replace") for t in texts.loc[texts["kind"] == k].sort_values("doc_id")["text"]]) for k in (1, 0)))
    sent = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = sent.value.compressors()
        for batch in batches:
            x = np.array([difference(t, pair) for t in batch["text"]], float)
            yield pd.DataFrame({"kind": batch["kind"].to_numpy("int32"), "bin": np.clip(np.round(x / STEP), -EDGE, EDGE).astype("int32")})

    rest = marks.where("sets_curve").select("doc_id", "kind")
    # labels grow with the documents, so this is a shuffled join whatever their size
    points = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(CURVE)) == 0).join(rest.hint("merge"), "doc_id").select("kind", "text").mapInPandas(bins, "kind int, bin int").groupBy("kind", "bin").count().toPandas()
    model.curve = curve_of(points, STEP)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text; others are ignored). Null text: as empty, whose difference is 0. Null doc_id stays null, repeated rows are scored each, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, m = sent.value.compressors(), sent.value
        for batch in batches:
            x = np.array([difference(t, pair) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": m.curve.probability(x)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
