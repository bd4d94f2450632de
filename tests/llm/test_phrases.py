import hashlib

import numpy as np
from helpers import empty_documents, hard_documents, with_clashes

from panelfolio.llm import phrases as P


def one(text):
    return P.written(P.sketches([P.code_points(text)])[0])


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(n))


def test_results_against_texts_taken_one_by_one(spark):
    docs = [(3 * i, words(i, 5 + 9 * i)) for i in range(40)] + [(200, None), (201, ""), (202, "abc"), (203, "x" * 5000), (204, words(3, 30000)), (205, "日本語 \U0001f600 text" * 9), (206, words(206, 50))]
    for size in (4000, 5):
        got = {r["doc_id"]: r for r in P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), rows_per_range=size).collect()}
        assert len(got) == len(docs)
        for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
            text, after, n = text or "", after or "", len(text or "") // 4
            changed = text[: len(text) - n] + after[:n]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == (one(text), one(changed))
            a, b, c = (P.sketches([P.code_points(t)])[0] for t in (text, changed, after))
            assert r["near_edited"] == P.likeness(a, b) and r["near_next"] == P.likeness(a, c)


def test_equal_substrings_share_phrases_at_any_offset():
    body = words(1, 600)
    for head in ("", "x", "some words before ", "zzzzz"):
        a, b = P.sketches([P.code_points(body), P.code_points(head + body)])
        assert P.likeness(a, b) > 0.85
    a, b = P.sketches([P.code_points(body), P.code_points(words(2, 600))])
    assert P.likeness(a, b) < 0.1


def test_labels_differ_between_neighbours_and_phrases_are_short():
    names = P.mixed(np.random.default_rng(0).integers(0, 26, 20000).astype(np.uint64))
    names = names[np.append(True, names[1:] != names[:-1])]
    label = P.tossed(names, np.array([0]))
    assert label.max() < 8 and (label[1:] != label[:-1]).all()
    assert np.diff(np.flatnonzero(P.begins(names, np.array([0])))).max() <= 16


def test_likeness_estimates_the_share_of_equal_names():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.9):
        found = []
        for _ in range(60):
            common, own = rng.integers(0, 2**32, int(4000 * share)), rng.integers(0, 2**32, (2, int(2000 * (1 - share))))
            a, b = (np.unique(np.concatenate([common, o])).astype(np.uint32)[: P.KEPT] for o in own)
            found.append(P.likeness(a, b))
        assert abs(np.mean(found) - share) < 0.03
    assert P.likeness(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) == 1.0


def test_hard_rows_and_empty_table(spark):
    docs = with_clashes(hard_documents(spark), ["doc", "range", "sentinel"])
    rows = P.fingerprints(docs, rows_per_range=2).collect()
    assert len(rows) == docs.count() and sum(r["doc_id"] is None for r in rows) == 2
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert P.fingerprints(empty_documents(spark)).count() == 0
