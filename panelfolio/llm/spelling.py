"""Grouping of spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart let s be the shorter (or either). It gives two disjoint chunks of half its length, its first and its
last letters; one edit leaves one of them whole. The other word gives its positional grams of that size. A chunk before
the edit stays where it is, one behind it moves by the difference of the lengths, one at most, so only grams at these
places can meet a chunk and no others are written: a word of any length gives a fixed number of rows.

Words that share a chunk and their lengths meet by its hash. A group of so many words that its pairs exceed ``PAIRS`` is not
paired: what lies outside the shared chunk holds the edit, and is cut into two chunks again, one of which the edit leaves whole.
This goes on for such groups until their words agree on all but one letter, which bounds a group by the alphabet. So all
links are found, and candidates grow with the words. Candidates are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
RUNS, HELD, LETTERS = 100_000, 200_000, 8_000_000  # runs read at once; words and letters counted before they are handed on
PAIRS = 10_000


def lowered(run: str) -> str:
    """Only A to Z change."""
    return run.lower() if run.isascii() else run.translate(SMALL)


def _counts(text: str) -> Iterator[Counter]:
    if len(text) < 1_000_000:
        yield Counter(RUN.findall(text))
        return
    runs = (m.group() for m in RUN.finditer(text))
    while part := Counter(islice(runs, RUNS)):
        yield part


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = None) -> DataFrame:
    """Maximal runs of letters in ``docs`` (doc_id, text, ...), lower-cased from A to Z -> word, n; those of ``least_length`` code points
    and ``least_count`` occurrences or more.

    ``one_in`` plants misspellings: where it divides the CRC-32 h of "doc_id:run", code point h % length is deleted. Null and
    empty texts have no words; a null id is an empty one. Repeated rows count again. Counts are summed in each task first.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for counts in _counts(text.as_py() or ""):
                    for run, n in counts.items():
                        if len(run) < least_length:
                            continue
                        word = lowered(run)
                        if one_in:
                            h = zlib.crc32(f"{doc_id or ''}:{word}".encode())
                            if h % one_in == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        if word not in total:
                            held += len(word)
                        total[word] += n
                    if len(total) >= HELD or held >= LETTERS:
                        yield out()
                        total.clear()
                        held = 0
        yield out()

    counted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(gather, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _meeting(gram: bool) -> Column:
    """The hash by which words meet: all letters outside the part of s (from a to b) that holds the edit, and what is fixed."""
    behind = F.col("b") + F.col("d") if gram else F.col("b")
    return F.xxhash64("size", "d", "a", "b", F.expr("substring(word, 1, a)"), F.substring(F.col("word"), behind + 1, F.length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Both chunks of the part from a to b: where the first stays whole the edit is behind it, where the last does, before it.

    With an insertion (d = 1) the edit is a gap between letters, so a part of one letter, and an odd one, are cut one letter later.
    """
    half = F.floor((F.col("b") - F.col("a") + F.col("d")) / 2).cast("int")
    parts = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") - half).alias("b")))
    cut = rows.select("word", "gram", "size", "d", F.explode(parts).alias("p")).select("word", "gram", "size", "d", "p.a", "p.b").distinct()
    return cut.withColumn("key", F.when(F.col("gram"), _meeting(True)).otherwise(_meeting(False)))


def near_words(words: DataFrame) -> DataFrame:
    """All pairs (word, other) of the distinct ``word``s that differ by one inserted, deleted or replaced code point, either way round."""
    roles = F.explode(F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(d).alias("d")) for g in (False, True) for d in (0, 1)]))
    whole = words.select("word", roles.alias("r")).select("word", "r.gram", "r.d", (F.length("word") - F.when(F.col("r.gram"), F.col("r.d")).otherwise(0)).alias("size"))
    rows = _halves(whole.select("word", "gram", "size", "d", F.lit(0).alias("a"), F.col("size").alias("b")))
    found = []
    while True:
        groups = rows.groupBy("key").agg(F.count_if(~F.col("gram")).alias("chunks"), F.count_if("gram").alias("grams")).where("chunks > 0 and grams > 0")
        large = (F.col("chunks") * F.col("grams") > PAIRS) & (F.col("b") - F.col("a") > 1 - F.col("d"))
        rows = stage(rows.join(groups, "key").withColumn("large", large).drop("chunks", "grams"), "spelling-chunks")
        small = rows.where("not large")
        left = small.where("not gram").select("key", "d", F.col("word").alias("word"))
        pairs = left.join(small.where("gram").select("key", F.col("word").alias("other")), "key").where("(d = 1 or word < other) and levenshtein(word, other, 1) = 1")
        found.append(stage(pairs.select("word", "other").distinct(), "spelling-pairs"))
        if rows.where("large").isEmpty():
            break
        rows = _halves(rows.where("large").drop("key", "large"))
    one = found[0]
    for more in found[1:]:
        one = one.unionByName(more)
    one = one.distinct()
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other")))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``words`` (word, n; distinct words) -> word, form, root, n, n_near, form_n.

    The form of a word is its near word of largest n (of equals the first in code-point order) where that is at least ``ratio``
    (2 or more) times its own n, else null; root follows forms to the last, the word itself without one. Null words leave.
    An empty table has no rows.
    """
    words = stage(words.where("word is not null").select("word", "n"), "spelling-words")
    near = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    is_form = -F.col("best.minus") >= F.col("n") * ratio
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    known = stage(known, "spelling-forms")
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps, of which each multiplies n by the ratio
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return known.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
