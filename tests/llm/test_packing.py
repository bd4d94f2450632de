import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import LONG, empty_documents, hard_documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from panelfolio.llm import packing

RANKS = P.path("byte_bpe_50k.tiktoken")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizer_file(text):
    with open(RANKS, "rb") as f:
        bpe = packing.encoder(f.read(), P.PATTERN)
    for t in (text, text + "<|endoftext|>" + text):
        assert packing.token_ids(bpe, t) == tokenizer_once().encode(t, add_special_tokens=False).ids


_ONE = []


def tokenizer_once():
    if not _ONE:
        _ONE.append(tokenizer())
    return _ONE[0]


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= capacity
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_hold_the_documents_ids(spark, capacity):
    docs = hard_documents(spark)
    rows = packing.pack_documents(with_clashes(docs, ["piece", "order", "row", "sequence_id"]), RANKS, P.PATTERN, capacity).collect()
    want = []
    for d in docs.collect():
        ids = np.array(tokenizer_once().encode(d["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, s in enumerate(starts):
            part = ids[s : first if k == 0 else s + capacity]
            want.append((d["doc_id"], k, s, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=key) == sorted(want, key=key)
    check_layout(rows, capacity)


def test_empty_table_and_long_text(spark):
    assert packing.pack_documents(empty_documents(spark), RANKS, P.PATTERN).count() == 0
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    rows = packing.pack_documents(docs, RANKS, P.PATTERN).collect()
    assert sum(r["length"] for r in rows) == len(tokenizer_once().encode(LONG).ids) + 1


def test_bins_are_nearly_full_and_bounded():
    rng = np.random.default_rng(3)
    bins, seen = packing.OpenBins(2048, 50), 0
    lengths = rng.integers(1, 1500, 20000).tolist()
    for n in lengths:
        bins.place(n)
        assert bins.open <= 50
        seen += n
    assert bins.used < 1.05 * seen / 2048


def test_tightest_fit_and_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the sequence with 3 free, not that with 4
    assert bins.place(5) == (2, 0) and bins.place(8) == (3, 0)  # the fullest open one, with 4 free, closed
    assert bins.place(4) == (2, 5)
