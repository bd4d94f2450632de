import math

import numpy as np
import pytest
from helpers import LONG, empty_documents, hard_documents, with_clashes
from pyspark.sql import functions as F

from panelfolio.llm import quality, toxicity

WORDS = "ertion tien anesble that rean thonener hean ntble rendlynd onatwh whnd heiner are thingeawh thtion ndre onouth onedea onan haonen".split()
RUDE = ["idiot", "moron", "stupid", "loser"]


def corpus(spark, n=1800):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(WORDS, int(rng.integers(20, 80))).tolist()
        toxic, good = int(i % 4 == 0), int(i % 3 > 0)
        if toxic:
            for at in rng.integers(0, len(words), 4):
                words[at] = str(rng.choice(RUDE))
        text = " ".join(words) if good else "%%% ".join(w + "$$$" for w in words)
        docs.append((i, text))
        if i % 10 < 8:
            labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def learn():
    return F.col("doc_id") % 10 < 6


@pytest.mark.parametrize("n", [900, 1800])
@pytest.mark.parametrize("name,module", [("toxic", toxicity), ("quality", quality)])
def test_held_out_accuracy(spark, name, module, n):
    docs, labels, rows = corpus(spark, n)
    model = module.train(docs, labels, learn())
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    held = [(got[i], t if name == "toxic" else q) for i, q, t in rows if i % 10 >= 6]
    assert len(got) == n and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_hard_rows(spark, module):
    docs, labels, _ = corpus(spark, 300)
    model = module.train(docs, labels, learn())
    hard = with_clashes(hard_documents(spark), ["score", "kind", "label"])
    rows = module.score(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3)}
    assert len(empty) == 1  # null as empty
    assert module.score(empty_documents(spark), model).count() == 0


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_all_score_the_same(spark, module, name):
    docs = hard_documents(spark)
    for labels in ([], [(1, 1)], [(1, None), (None, 1), (4, 0)], [(1, 1), (1, 1), (99, 0)]):
        model = module.train(docs, spark.createDataFrame(labels, f"doc_id long, {name} int"), F.lit(True))
        scores = {round(r["score"], 12) for r in module.score(docs, model).collect()}
        assert len(scores) == 1
    model = module.train(empty_documents(spark), spark.createDataFrame([], f"doc_id long, {name} int"), F.lit(True))
    assert module.score(docs, model).count() == docs.count()


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, labels, rows = corpus(spark)
    model = toxicity.train(docs, labels, learn())
    wide = docs.withColumn("score", F.lit("x")).withColumn("c1", F.lit(1))
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}


def _models(counts, shared, order, code):
    """Interpolated Kneser-Ney probability of the last symbol of ``code``, written as the definition has it."""
    a = toxicity.A
    if order == 2:
        return shared[(code // a) % a, code % a]
    table = counts[order]
    context = [table.get(code // a * a + w, 0) for w in range(a)]
    lower = _models(counts, shared, order - 1, code % a ** (order - 1))
    if not sum(context):
        return lower
    kinds = sum(c > 0 for c in context)
    return (max(table.get(code, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * lower) / sum(context)


def test_ratios_are_those_of_the_definition():
    rng = np.random.default_rng(4)
    texts = {1: ["stupid idiot loser", "moron the stupid"], 0: [" ".join(rng.choice(WORDS, 30)) for _ in range(5)]}
    counts = {k: np.unique(toxicity.grams(t)[0], return_counts=True) for k, t in texts.items()}
    everything = np.unique(np.concatenate([c[0] for c in counts.values()]) % toxicity.A**3)
    shared = toxicity.shared_backoff(everything)
    assert np.allclose(shared.sum(1), 1)
    model = toxicity.Model(counts, shared)
    by_order = {}
    for k, (codes, n) in counts.items():
        tables = {5: dict(zip(codes.tolist(), n.tolist()))}
        for order in (4, 3):
            seen = tables[order + 1] if order == 4 else tables[4]
            left = {}
            for g in seen:
                left[g % toxicity.A**order] = left.get(g % toxicity.A**order, 0) + 1
            tables[order] = left
        by_order[k] = tables
    codes, sizes = toxicity.grams(["the idiot and qqq 12 stupid"])
    want = sum(math.log(_models(by_order[1], shared, 5, c) / _models(by_order[0], shared, 5, c)) for c in codes.tolist())
    assert math.isclose(model.lengthwise(["the idiot and qqq 12 stupid"])[0], want / (sizes[0] + toxicity.SOFT), rel_tol=1e-4)


def test_whole_texts_count():
    pair = quality.Model(quality.dictionary([b"good words here " * 50]), quality.dictionary([b"%%$$ " * 200])).compressors()
    assert quality.difference(LONG, pair) != quality.difference(LONG + "%%$$ " * 3000, pair)
    codes, sizes = toxicity.grams([LONG, "", None, "é"])
    assert sizes.tolist() == [len(LONG) + 1, 1, 1, 3] and len(codes) == sizes.sum()


SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cjk": "".join(chr(0x4E00 + 37 * i) for i in range(200))}


@pytest.mark.parametrize("script", SCRIPTS)
def test_every_script(spark, script):
    """Words of random letters, a quarter of the texts with words of a second vocabulary."""
    rng = np.random.default_rng(5)
    letters = list(SCRIPTS[script])
    word = lambda: "".join(rng.choice(letters, int(rng.integers(2, 5) if script == "cjk" else rng.integers(3, 9))))
    ordinary, rude = [word() for _ in range(200)], [word() for _ in range(4)]
    docs, labels = [], []
    for i in range(3000):
        words = rng.choice(ordinary, int(rng.integers(20, 60))).tolist()
        if i % 4 == 0:
            for at in rng.integers(0, len(words), 3):
                words[at] = str(rng.choice(rude))
        docs.append((i, ("" if script == "cjk" else " ").join(words)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 10 < 7)
    held = [(r["score"] >= 0.7, r["doc_id"] % 4 == 0) for r in toxicity.score(df, model).collect() if r["doc_id"] % 10 >= 7]
    caught, false = sum(p for p, y in held if y), sum(p for p, y in held if not y)
    assert caught >= 0.9 * sum(y for _, y in held) and false <= 0.02 * len(held)


def test_every_symbol_of_every_text_has_its_window():
    texts = ["ab é", "идиот", "漢字 x", "\U0001f600!", ""]
    codes, sizes = toxicity.grams(texts)
    assert sizes.tolist() == [6, 6, 7, 3, 1] and len(codes) == sizes.sum()
    alone = np.concatenate([toxicity.grams([t])[0] for t in texts])
    assert codes.tolist() == alone.tolist()


def test_dictionaries_of_few_samples():
    rng = np.random.default_rng(6)
    few = [" ".join(rng.choice(WORDS, 40)).encode() for _ in range(40)]
    trained = quality.dictionary(few)
    assert trained[:4] == b"\x37\xa4\x30\xec" and len(trained) < quality.DICTIONARY  # a dictionary of a smaller size
    assert quality.dictionary([b"two words"]) == b"two words" and quality.dictionary([]) == b"\x00" * 8


def test_sample_is_bounded_in_texts_and_bytes(spark, monkeypatch):
    docs, labels, _ = corpus(spark, 300)
    same = quality.train(docs, labels, learn())
    again = quality.train(docs.unionByName(docs), labels, learn())  # a repeated row is one text of the sample
    assert (same.good, same.bad) == (again.good, again.bad)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    long = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", 500)).otherwise(F.col("text")))
    model = quality.train(long, labels, learn())
    assert {len(model.good) <= 2000, len(model.bad) <= 2000} == {True}
