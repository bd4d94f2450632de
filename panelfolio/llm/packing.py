"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task keeps at most ``open_bins`` sequences open. A bitset has bit f set while some open
sequence has f free tokens, so the tightest fit for a piece of n tokens is the lowest set bit at or above n. A piece that
fits nowhere opens a sequence; if that would be one too many, the fullest open one closes first.

Tokenising runs where the texts are read; only descriptors (id, piece, length, checksum) are shuffled, by a hash of
the whole descriptor, so neither a hot source nor a very long document gathers in one task. The descriptors are staged: their number sets the number
of packing tasks, each large enough that its last open sequences do not matter, and a lost executor does not tokenise again.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import parts, stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = PIECES + ", row long"  # row: unique; it deals the copies of a repeated document apart
PACKED = PIECES + ", sequence_id long, offset long"
END_OF_TEXT = "<|endoftext|>"
_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str):
    """A byte-level BPE from the lines of a rank file; the one special string takes the id after the last rank."""
    key = zlib.crc32(ranks)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: len(table)})
    return _ENCODERS[key]


def token_ids(bpe, text: str) -> list[int]:
    return bpe.encode(text, allowed_special="all") if END_OF_TEXT in text else bpe.encode_ordinary(text)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one takes the remainder."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def tokenised_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text). Null and empty texts are the end id alone."""
    with open(ranks_path, "rb") as f:  # a vocabulary file has a fixed size, under 1 MB
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, row = encoder(ranks.value, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for row, (doc_id, text) in enumerate(zip(batch["doc_id"], batch["text"]), row + 1):
                ids = np.array(token_ids(bpe, text or "") + [end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length]), row))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, NUMBERED)


class OpenBins:
    """The open sequences of one task."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_bits = self.open = self.used = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        taken = stack.pop()
        if not stack:
            self.free_bits ^= 1 << free
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """(sequence number, offset) for a piece of 1 to ``capacity`` tokens."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit and length < self.capacity:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            number, free = self.used, self.capacity
            self.used += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 8192, pieces_per_task: int = 100_000) -> DataFrame:
    """Give every piece a sequence and its gapless offset there. Sequence ids are unique over tasks, in no order."""
    staged = stage(pieces, "pieces")
    tasks = parts(staged.count(), pieces_per_task)
    order = F.xxhash64("doc_id", "piece", "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            numbers, offsets = zip(*placed) if placed else ((), ())
            yield batch.drop(columns=["order", "row"]).assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=np.array(numbers, "int64") + base, offset=np.array(offsets, "int64"))

    dealt = staged.withColumn("order", order).repartition(tasks, "order").sortWithinPartitions("order", "row", "piece")
    return dealt.mapInPandas(run, PACKED)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, open_bins: int = 8192) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; other columns are ignored). Returns ``PACKED``.

    A document is its token ids and then id 0. Only a document longer than ``capacity`` is cut. Null text: as empty, one
    piece of one token. Null doc_id: stays null. Repeated rows: each is packed. Empty table: no rows.
    """
    return pack(tokenised_pieces(docs, ranks_path, pattern, capacity), capacity, open_bins)
