"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers. DataFrame functions only.

Two first-order models over 66 characters are trained from labelled samples. Random: strings hashed from numbers in the
usual alphabets (hexadecimal, base 64, upper case) and the values the fixed patterns find in the corpus. Ordinary: the
identifiers and words of ``SAMPLE`` different documents. A run of at least ``LEAST`` token characters is a secret if its log-likelihood
ratio, in thousandths of a nat for each transition, reaches ``THRESHOLD``; of a run that does not, the segments of ``LEAST``
characters or more that do, such as a key behind a path. Ratios are rounded to integers, so sums do not
depend on their order. The models are 66 x 66 numbers, a bound no corpus moves, and travel as a constant.

Spans are found where the text is read: the parts between matches give the offsets, in code points. Nothing is shuffled but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import others

# The patterns of the base scan and the least lengths of what they match.
WORDS = "(?i)password|passwd|secret|token|api_?key"
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET) + 1
RUN = "[A-Za-z0-9+/_-]"
LEAST = 20
THRESHOLD = 600
SAMPLE = 1_000  # documents whose words train the ordinary model
RANDOM_SAMPLE = 2_000  # hashed strings of each alphabet
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.char_length(s))


def find(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as ``SPAN``; value is the match's ``group``."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    rows = F.arrays_zip(_lengths(F.split(text, pattern, -1)).alias("gap"), _lengths(matched).alias("size"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + row["size"]).alias("end"), row["value"].alias("value"))
        return F.struct((begin + F.coalesce(row["size"], F.lit(0))).alias("at"), F.when(row["size"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    return F.aggregate(rows, start, step)["found"]


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and kind. A cheap search comes first, since few texts have any."""
    none = F.array().cast(f"array<{SPAN}>")
    assign = F.when(text.rlike(WORDS), F.filter(find(text, ASSIGN, "assign", 2), lambda s: F.char_length(s["value"]) >= 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), F.filter(find(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= 20)).otherwise(none)
    # runs of 24 and more are what is left of all runs once the shorter ones are dropped
    hexes = F.when(text.rlike("[0-9a-f]{24}"), find(text, "[0-9a-f]{24,}", "hex")).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _transitions(tokens: DataFrame) -> DataFrame:
    """(random, code, n) of (random, token): code = previous character * SIZE + next, 0 for characters outside the alphabet."""
    codes = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = tokens.select("random", codes.alias("c")).where(F.size("c") > 1)
    pairs = pairs.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * SIZE + F.get("c", i))).alias("code"))
    return pairs.groupBy("random", "code").agg(F.count(F.lit(1)).alias("n"))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled tokens (random, token): see the module's text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbers = spark.range(RANDOM_SAMPLE).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    drawn = numbers.select(F.explode(F.array(F.substring("h", 1, 32), F.regexp_replace(F.base64(F.unhex("h")), "=", ""), F.upper(F.substring("h", 1, 20)),
                                             F.substring(F.upper(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "")), 1, 20))).alias("token"))
    found = docs.select(text.alias("text")).where(F.col("text").rlike(f"{WORDS}|AKIA|[0-9a-f]{{24}}")).select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s["value"])).alias("token"))
    # only keys are ranked, so that no task gathers texts; copies of a chosen text are one
    keyed = docs.select(text.alias("text")).withColumn("key", F.md5("text"))
    keys = keyed.select("key").distinct().orderBy("key").limit(SAMPLE)
    chosen = keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("text").alias("text"))
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_]{3,}"), F.lit(0))).alias("token"))
    return drawn.unionByName(found).select(F.lit(True).alias("random"), "token").unionByName(words.select(F.lit(False).alias("random"), "token"))


def train(labelled: DataFrame) -> list[int]:
    """Log-likelihood ratios of all SIZE * SIZE transitions in thousandths of a nat, from (random, token)."""
    counts = _transitions(labelled).groupBy("code").agg(
        F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(~F.col("random"), F.col("n")).otherwise(0)).alias("o"))
    every = labelled.sparkSession.range(SIZE * SIZE).select(F.col("id").alias("code"))
    full = every.join(counts, "code", "left").na.fill(0)
    totals = full.groupBy(F.floor(F.col("code") / SIZE).alias("previous")).agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    rows = full.join(totals, F.floor(F.col("code") / SIZE) == F.col("previous"))
    share = lambda n, total: (F.col(n) + F.lit(0.5)) / (F.col(total) + F.lit(0.5 * SIZE))
    ratio = F.round(F.log(share("r", "tr") / share("o", "to")) * 1000).cast("int")
    return [r["v"] for r in rows.select("code", ratio.alias("v")).orderBy("code").collect()]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _segments(excess: Column) -> Column:
    """Segments (start, end), in characters and end exclusive, of a run whose transitions exceed the threshold by ``excess`` (first item 0).

    Every segment has ``LEAST`` characters or more and a mean that reaches the threshold, and no such segment is left outside
    them. One is opened where the running sum reaches the running minimum of the sums at least ``LEAST`` - 1 transitions before,
    goes on to the largest sum after it, and begins at the smallest sum of its first transitions.
    """
    least = LEAST - 1
    none = F.array().cast("array<struct<start:int,end:int>>")
    number = lambda v, name: F.lit(v).cast("long").alias(name)
    place = lambda v, name: F.lit(v).cast("int").alias(name)
    # p, q: sums up to transition j and j - least; low, at: least q since ``free``, the first character a segment may begin at
    # first, start, end, base, peak: the last segment, where it was opened, and the sums at its start and end
    start = F.struct(place(-1, "j"), number(0, "p"), number(0, "q"), number(None, "low"), place(0, "at"), place(0, "free"), place(0, "first"),
                     place(None, "start"), place(None, "end"), number(None, "base"), number(None, "peak"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        moved = F.struct((a["j"] + 1).alias("j"), (a["p"] + x["new"]).alias("p"), (a["q"] + x["old"]).alias("q"))
        return _let(moved, lambda m: _let(F.struct(
            (m["j"] - least >= a["free"]).alias("may"),
            ((m["j"] - least >= a["free"]) & (a["low"].isNull() | (m["q"] <= a["low"]))).alias("lower"),
            F.coalesce(m["p"] > a["peak"], F.lit(False)).alias("longer")), lambda t: _let(F.struct(
                F.when(t["lower"], m["q"]).otherwise(a["low"]).alias("low"), F.when(t["lower"], m["j"] - least).otherwise(a["at"]).alias("at")),
                lambda l: _next(a, m, t, l))))

    def _next(a: Column, m: Column, t: Column, l: Column) -> Column:
        opened = ~t["longer"] & t["may"] & (m["p"] >= l["low"])
        better = t["longer"] & (m["q"] < a["base"]) & (m["j"] - least > a["start"]) & (m["j"] - least - a["first"] < least)
        ends = opened | t["longer"]
        pick = lambda new, shifted, old, name: F.when(opened, new).when(better, shifted).otherwise(a[old]).alias(name)
        closed = F.when(opened & a["start"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), (a["end"] + 1).alias("end"))))).otherwise(a["out"])
        return F.struct(m["j"].alias("j"), m["p"].alias("p"), m["q"].alias("q"), F.when(ends, F.lit(None).cast("long")).otherwise(l["low"]).alias("low"), l["at"].alias("at"),
                        F.when(ends, m["j"] + 1).otherwise(a["free"]).alias("free"), F.when(opened, l["at"]).otherwise(a["first"]).alias("first"),
                        pick(l["at"], m["j"] - least, "start", "start"), F.when(ends, m["j"]).otherwise(a["end"]).alias("end"),
                        pick(l["low"], m["q"], "base", "base"), F.when(ends, m["p"]).otherwise(a["peak"]).alias("peak"), closed.alias("out"))

    def finish(a: Column) -> Column:
        return F.when(a["start"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), (a["end"] + 1).alias("end")))))

    moves = _let(excess, lambda e: F.transform(e, lambda v, j: F.struct(v.alias("new"), F.coalesce(F.get(e, j - least), F.lit(0).cast("long")).alias("old"))))
    return F.aggregate(moves, start, step, finish)


def markov_spans(text: Column, ratios: list[int], threshold: int = THRESHOLD) -> Column:
    """Runs of token characters whose ratio reaches the threshold, and of other runs the segments that reach it."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def excess(span: Column) -> Column:
        codes = F.transform(F.split(span["value"], ""), lambda c: F.instr(F.lit(ALPHABET), c))
        return _let(codes, lambda c: F.transform(c, lambda v, j: F.when(j == 0, F.lit(0)).otherwise(F.get(table, F.get(c, j - 1) * SIZE + v) - threshold).cast("long")))

    def within(span: Column, e: Column) -> Column:
        # the ends of a key may score low, so a segment goes on to the next of / _ - on either side, but not into another
        def part(found: Column, s: Column, k: Column) -> Column:
            cut = lambda a, b: F.split(F.substring(span["value"], a + 1, b - a), "[/_-]", -1)
            before = cut(F.coalesce(F.when(k > 0, F.get(found, k - 1)["end"]), F.lit(0)), s["start"])
            after = cut(s["end"], F.coalesce(F.get(found, k + 1)["start"], span["end"] - span["start"]))
            more = F.when((k == 0) | (F.size(before) > 1), F.char_length(F.element_at(before, -1))).otherwise(0)
            sides = F.struct((s["start"] - more).alias("a"), (s["end"] + F.char_length(F.get(after, 0))).alias("b"))
            return _let(sides, lambda x: F.struct((span["start"] + x["a"]).alias("start"), span["kind"].alias("kind"), (span["start"] + x["b"]).alias("end"),
                                                  F.substring(span["value"], x["a"] + 1, x["b"] - x["a"]).alias("value")).cast(SPAN))

        return _let(_segments(e), lambda found: F.transform(found, lambda s, k: part(found, s, k)))

    def likely(span: Column) -> Column:
        return _let(excess(span), lambda e: F.when(F.aggregate(e, F.lit(0).cast("long"), lambda a, v: a + v) >= 0, F.array(span)).otherwise(within(span, e)))

    runs = find(text, f"{RUN}{{{LEAST},}}", "markov")
    return F.when(text.rlike(f"{RUN}{{{LEAST}}}"), F.flatten(F.transform(runs, likely))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _outside(span: Column, base: Column) -> Column:
    """The parts of ``span`` outside all ``base`` spans, which are in order of their starts."""
    part = lambda a, b: F.struct(a.alias("start"), span["kind"].alias("kind"), b.alias("end"), F.substring(span["value"], a - span["start"] + 1, b - a).alias("value")).cast(SPAN)
    begin = F.struct(span["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["parts"], F.array(part(acc["at"], b["start"])))).otherwise(acc["parts"]).alias("parts"))

    meets = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(meets, begin, step, lambda acc: F.when(acc["at"] < span["end"], F.concat(acc["parts"], F.array(part(acc["at"], span["end"])))).otherwise(acc["parts"]))


def scan(docs: DataFrame, ratios: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (text, ...) plus base_spans and spans, arrays of ``SPAN`` in code points, end exclusive.

    Null text: as empty, no spans. Of a model's span the parts outside base spans stay; base spans always stay. Columns
    named as the two new ones are replaced. Repeated rows are scanned each; an empty table gives no rows.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("scanned", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    both = row.select("row", base_spans(F.col("scanned")).alias("base"), markov_spans(F.col("scanned"), ratios, threshold).alias("model"))
    apart = F.flatten(F.transform("model", lambda m: _outside(m, F.col("base"))))
    both = both.select("row", F.col("base").alias("base_spans"), F.array_sort(F.concat("base", apart)).alias("spans"))
    return both.select(*others(docs, "row", ["base_spans", "spans"]), "base_spans", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, kept).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, rest))
