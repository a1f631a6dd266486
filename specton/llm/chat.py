"""Chat formatting on a prefix tree: conversations that share their first turns share those turns' tokens.

Each turn becomes one chunk, ``<|im_start|>role\\ntext<|im_end|>\\n``. A turn's node is named by the hash of all turns up to
it, so equal beginnings of conversations are one node. Nodes on a way without forks are a segment; a segment's path is the
hashes at its head and at the heads of those above it. Nodes in the order of path and depth are in depth-first order; a
range partitioning by them, running sums in each part and one row for each part give every node the place of its tokens
in the one emitted stream, its position ids (counted along its own conversation) and the intervals of its ancestors'
tokens, one a segment, which with the causal part of its own tokens are all that it attends to.

Conversations are read turn by turn in sorted partitions and never held whole, a node's name has a fixed size, and what is
kept for a node grows with the forks above it, not with its depth.

Texts may hold the control strings: a backslash becomes two and ``<|`` becomes ``<\\|`` (in roles also a line feed becomes
``\\n``), which ``unescape`` turns back.

Defined results: a null text or role is empty; rows of a conversation are taken by turn, then role, then text, and
repeated rows are turns each; a null conv_id is a conversation of its own; an empty table gives no nodes. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specton.llm.common import staged
from specton.llm.packing import Encoder

#: Nodes of one part of the emitted stream, on average.
PART = 20_000
#: Bytes of a node's name, and of each head in a path.
STEP = 16

_CHUNK = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

MEMBERS = "conv string, depth int, name binary, parent binary, role string, chunk string, loss_begin int, loss_end int"
NODES = "name binary, parent binary, path binary, depth int, role string, chunk string, loss_begin int, loss_end int, conversations long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def members(turns: DataFrame) -> DataFrame:
    """A row for each turn of each conversation: the tree node it is at, that of the turn before, and its formatted chunk."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chain, depth = "", b"", -1  # depth -1: before the first conversation
        for pdf in batches:
            rows = []
            for conv, role, text in zip(pdf["conv"], pdf["role"], pdf["text"], strict=True):
                if depth < 0 or conv != now:
                    now, chain, depth = conv, b"", 0
                head = f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n"
                body = escape(text)
                chunk = f"{head}{body}<|im_end|>\n"
                above, chain = chain, hashlib.sha256(chain + chunk.encode("utf-8", "surrogatepass")).digest()
                trained = role == "assistant"
                rows.append((conv, depth, chain[:STEP], above[:STEP] or None, role, chunk, len(head) if trained else 0, len(head) + len(body) if trained else 0))
                depth += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return _by_conversation(rows, "turn", "role", "text").mapInPandas(walk, MEMBERS)


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """Whole conversations, one after the other, in each partition. conv is the id's digits, null for none."""
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _paths(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, path: the names of the segment heads down to each node. A head has no parent, or one with other children."""
    forks = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select(F.col("parent").alias("fork"))
    heads = nodes.select("name", "parent").join(forks, F.col("parent") == F.col("fork"), "left").where("parent IS NULL OR fork IS NOT NULL").select("name", F.lit(True).alias("head"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = b""
        for pdf in batches:
            paths = []
            for depth, name, head in zip(pdf["depth"], pdf["name"], pdf["head"], strict=True):
                path = name if depth == 0 else path + name if head else path
                paths.append(path)
            yield pd.DataFrame({"name": pdf["name"], "path": paths})

    rows = members.select("conv", "depth", "name").join(heads, "name", "left").select("conv", "depth", "name", F.coalesce("head", F.lit(False)).alias("head"))
    return _by_conversation(rows, "depth").mapInPandas(walk, "name binary, path binary").groupBy("name").agg(F.first("path").alias("path"))


def tree(members: DataFrame, tokenizer: str, part: int = PART) -> DataFrame:
    """The emitted stream, a row for each node: name, parent, path, depth, role, chunk, the characters under the loss mask,
    conversations through it, tokens, length and start in the stream, position of the first token, ancestors' intervals."""
    nodes = staged(members.groupBy("name").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "role", "chunk", "loss_begin", "loss_end")], F.count("*").alias("conversations")))
    parts = max(1, -(-nodes.count() // part))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, at, number = Encoder(tokenizer), 0, TaskContext.get().partitionId()
        for pdf in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encode(pdf["chunk"].tolist())]
            length = np.array([len(x) for x in ids], np.int64)
            ends = at + np.cumsum(length)
            yield pdf.assign(tokens=ids, length=length, within=ends - length, part=number)
            at = int(ends[-1]) if len(ends) else at

    own = nodes.join(_paths(members, nodes), "name").select(*[c.split()[0] for c in NODES.split(", ")])
    placed = staged(own.repartitionByRange(parts, "path", "depth").sortWithinPartitions("path", "depth").mapInPandas(emit, f"{NODES}, tokens array<int>, length long, within long, part int"))
    totals = placed.groupBy("part").agg(F.sum("length").alias("total"))  # a row for each PART nodes
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = placed.select("name", "path", "part", "within", "length").join(totals.select("part", before.alias("base")), "part").select("name", "path", (F.col("base") + F.col("within")).alias("start"), "length")
    segments = staged(where.groupBy("path").agg(F.min("start").alias("first"), F.sum("length").alias("size")))
    up = segments.select("path", F.explode(F.expr(f"transform(sequence(1, length(path) div {STEP}), i -> substring(path, 1, i * {STEP}))")).alias("up"))
    each = segments.select(F.col("path").alias("up"), "first", (F.col("first") + F.col("size")).alias("end"))
    above = up.where("up <> path").join(each, "up").groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("start"), "end"))).alias("above"), F.sum(F.col("end") - F.col("first")).alias("passed"))
    places = where.select("name", "path", "start").join(segments.select("path", "first").join(above, "path", "left"), "path")
    below = F.when(F.col("start") > F.col("first"), F.array(F.struct(F.col("first").alias("start"), F.col("start").alias("end"))))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    found = places.select("name", "start", (F.coalesce("passed", F.lit(0)) + F.col("start") - F.col("first")).alias("position"), F.concat(F.coalesce("above", none), F.coalesce(below, none)).alias("ancestors"))
    return placed.drop("within", "part").join(found, "name")


def conversations(members: DataFrame, tree: DataFrame) -> DataFrame:
    """conv, depth, chunk, loss: each conversation's formatted text read along its path in the tree, a row a turn, in order
    within its partition; loss is the part of the chunk under the loss mask."""
    loss = F.substring(F.col("chunk"), F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin"))
    own = members.select("conv", "depth", "name").join(tree.select("name", "chunk", loss.alias("loss")), "name")
    return _by_conversation(own.select("conv", "depth", "chunk", "loss"), "depth")


DIGESTS = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DIGESTS.split(", ")]
        now: list | None = None  # conv, turns, their hash, characters under the mask, their hash, formatted characters

        def done() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        for pdf in batches:
            rows = []
            for conv, depth, chunk, loss in zip(pdf["conv"], pdf["depth"], pdf["chunk"], pdf["loss"], strict=True):
                if depth == 0:
                    if now:
                        rows.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, t in _CHUNK.findall(chunk):
                    now[1] += 1
                    now[2].update(f"{unescape(r)}\n{unescape(t)}\n".encode("utf-8", "surrogatepass"))
                said = unescape(loss)
                now[3] += len(said)
                now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(chunk)
            yield pd.DataFrame(rows, columns=columns)
        if now:
            yield pd.DataFrame([done()], columns=columns)

    return conversations.mapInPandas(read, DIGESTS).select(F.col("conv").cast("long").alias("conv_id"), *[c.split()[0] for c in DIGESTS.split(", ")[1:]])
