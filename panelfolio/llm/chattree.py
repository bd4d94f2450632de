"""Chat formatting as prefix trees: conversations that share their first turns share those tokens.

A turn becomes ``<|im_start|>role newline text<|im_end|> newline`` as token ids; "<|" inside a role or text gets a backslash in the
middle, which reading back removes. A node is a turn together with all turns before it, named by a chained hash. Each
node belongs to the smallest conversation through it (its owner), so a conversation's own nodes are one run at the end of its path, its
segment, and every path is a short list of leading parts of segments. Ordered by those lists (deeper branches first, then by owner)
the segments of a tree are its depth-first order, so no tree is ever gathered: a hot first turn is a key only for counts, and
offsets come from sums over range partitions.

The layout has one row per node: its place in its tree's token sequence, position ids counted along the path, the tokens, which of
them bear loss, and the intervals of the sequence that its last token attends to (its own part being causal).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.llm.common import parts, stage
from panelfolio.llm.packing import encoder

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "conv long, depth int, node string, role string, position long, tokens array<int>, n_tokens int, loss_from int, loss_to int"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
NO_ID = -(2**63)  # stands for a null conv_id inside


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_line(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


class Template:
    """Token ids of turns, and back. The two control strings have ids of their own after the vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        self.bpe = encoder(ranks, pattern)
        self.open, self.close = self.bpe.n_vocab, self.bpe.n_vocab + 1
        self.newline = self.bpe.encode_ordinary("\n")

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        head = [self.open] + self.bpe.encode_ordinary(role_line(role) + "\n")
        body = self.bpe.encode_ordinary(escaped(text))
        loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
        return head + body + [self.close] + self.newline, *loss

    def text(self, ids: list[int]) -> str:
        out, plain = [], []
        for i in ids:
            if i in (self.open, self.close):
                out += [self.bpe.decode_bytes(plain), (OPEN if i == self.open else CLOSE).encode()]
                plain = []
            else:
                plain.append(i)
        return b"".join([*out, self.bpe.decode_bytes(plain)]).decode()

    def parsed(self, formatted: str) -> tuple[str, str]:
        role, text = formatted[len(OPEN) : -len(CLOSE) - 1].split("\n", 1)
        return role_of(role), unescaped(text)


class Layout(NamedTuple):
    nodes: DataFrame  # tree_id, segment, depth, start, position, tokens, loss_from, loss_to, attends
    members: DataFrame  # conv, tree_id, parts: the leading parts of segments that are its path


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def formatted_turns(conversations: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Every turn as tokens, its depth, position id and node name. Turns go by turn number, ties by role and text; a task streams
    them, so that a conversation of any length takes one turn's memory."""
    sent = conversations.sparkSession.sparkContext.broadcast(ranks)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = Template(sent.value, pattern)
        last, depth, position, name = None, 0, 0, b""
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                if conv != last:
                    last, depth, position, name = conv, 0, 0, b""
                r = role.encode()
                name = hashlib.sha256(b"%b%d:%b%b" % (name, len(r), r, text.encode())).digest()
                tokens, loss_from, loss_to = template.turn(role, text)
                out.append((conv, depth, name.hex()[:32], role, position, tokens, len(tokens), loss_from, loss_to))
                depth, position = depth + 1, position + len(tokens)
            yield pd.DataFrame(out, columns=["conv", "depth", "node", "role", "position", "tokens", "n_tokens", "loss_from", "loss_to"])

    return _by_conversation(rows, "turn", "role", "text").mapInPandas(run, TURNS)


def _with_offsets(segments: DataFrame, per_part: int) -> DataFrame:
    """``start`` of each segment in its tree: running sums inside range partitions of (tree, path), their totals, and the
    offset at which the tree begins."""
    spark = segments.sparkSession
    n = parts(segments.count(), per_part)
    dealt = stage(segments.repartitionByRange(n, "tree_id", "path").withColumn("part", F.spark_partition_id()), "chat-segments")
    before, bases = 0, []
    for row in dealt.groupBy("part").agg(F.sum("length").alias("length")).orderBy("part").collect():  # one row per range partition
        bases.append((row["part"], before))
        before += row["length"]
    inside = Window.partitionBy("part").orderBy("tree_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    placed = dealt.join(base, "part").withColumn("at", F.col("base") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
    begins = placed.groupBy("tree_id").agg(F.min("at").alias("begin"))
    return placed.join(begins, "tree_id").select("conv", "tree_id", "first_depth", "first_position", (F.col("at") - F.col("begin")).alias("start"))


def build(conversations: DataFrame, ranks_path: str, pattern: str, segments_per_part: int = 50_000) -> Layout:
    """Lay out ``conversations`` (conv_id, turn, role, text; other columns are ignored), both tables written to the shared folder.

    Null text or role: as empty. Null conv_id: one conversation of its own. Null turn: before all others. Repeated rows are turns each. Equal
    conversations share all nodes. Empty table: no rows.
    """
    with open(ranks_path, "rb") as f:  # a vocabulary file has a fixed size, under 1 MB
        ranks = f.read()
    turns = stage(formatted_turns(conversations, ranks, pattern), "chat-turns")
    owners = turns.groupBy("node").agg(F.min("conv").alias("owner"))
    steps = turns.select("conv", "depth", "node", "position", "n_tokens").join(owners, "node")
    before = F.lag("owner").over(Window.partitionBy("conv").orderBy("depth"))
    change = F.when(before.isNull() | (before != F.col("owner")), F.struct("depth", "owner", "position"))
    paths = steps.withColumn("change", change).groupBy("conv").agg(
        F.array_sort(F.collect_list("change")).alias("path"), F.max(F.col("depth") + 1).alias("turns"), F.max(F.col("position") + F.col("n_tokens")).alias("length"))
    paths = stage(paths.withColumn("last", F.element_at("path", -1)).withColumn("tree_id", F.col("path")[0]["owner"]), "chat-paths")
    order = F.transform(F.slice("path", 2, F.size("path")), lambda e: F.struct((-e["depth"]).alias("up"), e["owner"].alias("owner")))
    own = paths.where(F.col("last.owner") == F.col("conv"))
    segments = own.select("conv", "tree_id", order.alias("path"), (F.col("length") - F.col("last.position")).alias("length"),
                          F.col("last.depth").alias("first_depth"), F.col("last.position").alias("first_position"))
    placed = stage(_with_offsets(segments, segments_per_part), "chat-offsets")

    ends = F.transform("path", lambda e, i: F.struct(
        i.alias("i"), e["owner"].alias("segment"), e["depth"].alias("depth"), F.coalesce(F.get("path", i + 1)["depth"], F.col("turns")).alias("depth_end"),
        (F.coalesce(F.get("path", i + 1)["position"], F.col("length")) - e["position"]).alias("size")))
    pieces = paths.select("conv", "tree_id", F.explode(ends).alias("e"))
    starts = placed.select(F.col("conv").alias("segment"), "start")
    pieces = pieces.select("conv", "tree_id", "e.*").join(starts, "segment")
    part = F.struct("i", "segment", "depth", "depth_end", "start", (F.col("start") + F.col("size")).alias("end"))
    members = stage(pieces.groupBy("conv", "tree_id").agg(F.array_sort(F.collect_list(part)).alias("parts")), "chat-members")

    mine = turns.join(placed, "conv").where("depth >= first_depth").join(members.select("conv", "parts"), "conv")
    start = F.col("start") + F.col("position") - F.col("first_position")
    over = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.struct(p["start"].alias("from"), p["end"].alias("to")))
    self_part = F.array(F.struct(F.col("start").alias("from"), (start + F.col("n_tokens")).alias("to")))
    nodes = mine.select("tree_id", F.col("conv").alias("segment"), "depth", start.alias("start"), "position", "tokens", "loss_from", "loss_to", F.concat(over, self_part).alias("attends"))
    return Layout(stage(nodes, "chat-nodes"), members)


def read_back(layout: Layout, ranks_path: str, pattern: str) -> DataFrame:
    """One row per conversation, from the layout's tokens alone: turns, the text under the loss mask and their digests."""
    with open(ranks_path, "rb") as f:
        sent = layout.nodes.sparkSession.sparkContext.broadcast(f.read())
    wanted = layout.members.select("conv", F.explode("parts").alias("p"))
    wanted = wanted.select("conv", F.col("p.segment").alias("segment"), F.explode(F.sequence(F.col("p.depth"), F.col("p.depth_end") - 1)).alias("depth"))
    found = wanted.join(layout.nodes.select("segment", "depth", "tokens", "loss_from", "loss_to"), ["segment", "depth"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = Template(sent.value, pattern)
        now = None  # conv, turns, digest, loss characters, loss digest, characters
        row = lambda: (None if now[0] == NO_ID else now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
        for batch in batches:
            out = []
            for conv, tokens, lo, hi in zip(batch["conv"], batch["tokens"], batch["loss_from"], batch["loss_to"]):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = template.text(tokens)
                role, text = template.parsed(formatted)
                loss = unescaped(template.text(tokens[lo:hi]))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
            yield _rows(out)
        if now is not None:
            yield _rows([row()])

    return _by_conversation(found, "depth").mapInPandas(run, READ)


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return frame.astype({"conv_id": "Int64"})
