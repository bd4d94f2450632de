import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from panelfolio.llm import spelling
from helpers import empty_documents, hard_documents


def one_edit(s, t):
    if abs(len(s) - len(t)) > 1 or s == t:
        return False
    s, t = sorted((s, t), key=len)
    i = next((i for i in range(len(s)) if s[i] != t[i]), len(s))
    return s[i + (len(s) == len(t)) :] == t[i + 1 :]


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def grouped(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("key", F.lit(1)).withColumn("root", F.lit("x"))
    return sorted(tuple(r) for r in spelling.group_variants(df).collect())


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11)))
        counts[base] = rng.randint(5, 4000)
        for _ in range(8):
            at, c = rng.randrange(len(base)), rng.choice("abcdeé")
            word = rng.choice([base[:at] + base[at + 1 :], base[:at] + c + base[at:], base[:at] + c + base[at + 1 :], base + c, c + base])
            if len(word) >= 6:
                counts.setdefault(word, rng.randint(5, 300))
                base = rng.choice([base, word])
    assert grouped(spark, counts) == brute(counts)


def test_large_groups_are_cut_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 3)
    rng = random.Random(5)
    counts = {}
    while len(counts) < 150:  # many words share their first or last halves, or all but one letter
        word = "prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(5, 7)))
        counts[word if rng.random() < 0.5 else word[6:] + word[:6]] = rng.randint(5, 3000)
    for c in "abcdefghijklmnopqrstuvwxyzéüÿ":
        counts["same" + c + "rest"] = ord(c)
        counts["same" + c + "arest"] = 7 * ord(c)
    assert grouped(spark, counts) == brute(counts)


def test_words_against_brute_force(spark):
    rows = [(i, "Straße naïve Größen GRÖSSEN wörter x× ÷ab" * 3 + " İstanbul words2words under_score") for i in range(40)]
    rows += [(None, "nullid nullid"), (7, None), (8, ""), (9, "longrun" * 5000 + " repeat " * 300_000)]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit("y"))
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 11 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, one_in=11).collect()}
    assert got == want and len(got) == 8


def test_hard_rows_and_empty_tables(spark):
    words = spelling.count_words(hard_documents(spark), least_count=1)
    assert {r["word"] for r in words.collect()} == {"consectetur"}
    assert spelling.group_variants(spelling.count_words(empty_documents(spark))).count() == 0
