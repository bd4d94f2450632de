import math
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, hard_documents, with_clashes

from panelfolio.llm import jaccard
from panelfolio.llm.components import components


def near_group(rng, n, words=60, edits=3):
    base = [f"w{i}" for i in rng.integers(0, 10_000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
            w[at] = f"v{rng.integers(0, 10_000)}"
        out.append(" ".join(w))
    return out


def brute(rows, threshold=0.8):
    sets = [frozenset(jaccard.shingles(t).tolist()) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[top(i)] = min(d, first.get(top(i), d))
    return Counter((d, first.get(top(i)), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 8])
def test_classes_and_links_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: a bucket spreads over many tasks
    rng = np.random.default_rng(6)
    texts = near_group(rng, 60) + near_group(rng, 25, 30, 2) + [" ".join(f"u{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(80)]
    texts += [texts[0]] * 12 + [texts[70].upper()] * 3 + ["", None, "  ", "short text", "Short  text", "a b c d e"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(int(i), None if t is None else str(t)) for i, t in rows]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute(rows)


def test_hard_rows_and_kept_documents(spark):
    docs = with_clashes(hard_documents(spark), ["doc", "row", "node", "first", "text_key"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, None], key=str)
    assert jaccard.near_duplicates(empty_documents(spark)).count() == 0 and jaccard.keep_one(empty_documents(spark)).count() == 0


def test_pruning_bound_is_the_posterior():
    for n, m in jaccard.fewest_matches(0.8, 1e-6):
        tail = lambda k: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)
        # the same from the density s^m (1-s)^(n-m), integrated
        s = np.linspace(0, 1, 400_001)
        density = s**m * (1 - s) ** (n - m)
        assert math.isclose(density[s >= 0.8].sum() / density.sum(), tail(m), rel_tol=0.02)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(130, 200), (300, 301), (301, 300), (-5, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "node long, root long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}, 200: 100, 300: -5, 301: -5}
