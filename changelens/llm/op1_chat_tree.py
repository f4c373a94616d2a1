"""Chat formatting as a prefix tree.

Conversations that share their first turns share those turns' tokens. Every distinct conversation is a
path of turn digests; in the order of the paths each conversation adds only the nodes beyond what it has in
common with the one before, which is the depth-first order of the tree. So the tree comes from one range
exchange by path, and a first turn that a third of all conversations share is spread over tasks like any other.
Equal conversations are merged before.

A task numbers the nodes of its range by itself. What ranges share (the ancestors that a range's first
conversation has in the ranges before) is settled from one row per range: its first and last path and
their nodes, which is all that goes to the driver. Nodes that a range repeats are dropped, so each shared token is emitted once.

A node's row holds its place (`start`, counted over the whole output) and number (`no`, likewise), its tokens, the position of its first token
(the tokens above it, so positions run from 0 along every path), its parent's start, and `attention`: the merged intervals of
places and numbers of its ancestors, which it may attend to beside its own tokens up to each. A conversation that nobody branches
off is one interval, so its cost is in proportion to its turns; the intervals give a path back. The loss mask of a node is
the token range [loss_from, loss_to): the text of an assistant's turn.

Template: <|im_start|>role LF text <|im_end|> LF. The two marks are ids above the vocabulary. In texts every `<`,
backslashes, `|` gets one more backslash, which leaves no `<|` and is undone exactly; in roles backslashes
and line feeds are escaped besides.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), role and text, repeated rows are
turns of their own; every row without a conversation id is a conversation of its own without id; an empty table gives empty
tables; extra columns are not read. A path costs 16 bytes a turn.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import BATCH_BYTES, spark_arrow, stored

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_NODE = ("block int, no long, shared int, depth int, key string, role string, at long, n_tokens int, position long, "
         "tokens array<int>, loss_from int, loss_to int, parent long, own array<struct<start: long, end: long, first: long, last: long>>, "
         "spine array<struct<at: long, n: int, no: long>>, stack array<struct<at: long, n: int, no: long>>, low array<binary>, high array<binary>")
_FINAL = ("start long, no long, n_tokens int, tree long, depth int, role string, position long, tokens array<int>, loss_from int, loss_to int, "
          "parent long, attention array<struct<start: long, end: long, first: long, last: long>>, key string")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", role))


class Codec:
    """Turns to ids and back with a byte-level tokenizer; the marks are the two ids above its vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[list[int], int, int]]:
        """Per turn its ids and the range of the text's ids."""
        parts = [s for role, text in turns for s in (escape_role(role) + "\n", escape(text))]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return [([self.start, *h, *t, self.end, *self.line], 1 + len(h), 1 + len(h) + len(t)) for h, t in zip(ids[::2], ids[1::2], strict=True)]

    def text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def decode(self, ids: list[int]) -> tuple[str, str, int]:
        """Role, text and formatted characters of a turn."""
        if ids[0] != self.start or ids[-1 - len(self.line)] != self.end or ids[-len(self.line) :] != self.line:
            raise ValueError("not the tokens of one turn")
        inner = self.text(ids[1 : -1 - len(self.line)])
        role, _, text = inner.partition("\n")
        return unescape_role(role), unescape(text), len(START) + len(inner) + len(END) + 1


def whole_conversations(turns: DataFrame) -> DataFrame:
    """The stored conversations: conv_id, turns (role, text) in order, path (a digest per turn), key (a digest of the path)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    convs = turns.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    path = F.transform("turns", lambda t: F.unhex(F.md5(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), path.alias("path"))
    return stored(convs.withColumn("key", F.md5(F.array_join(F.transform("path", F.hex), ""))), "conversations")


def _joined(intervals: tuple, start: int, n: int, no: int) -> tuple:
    """Intervals with the node at `start`: the last one grows if the node follows it."""
    if intervals and intervals[-1][1] == start and intervals[-1][3] == no:
        last = intervals[-1]
        return (*intervals[:-1], (last[0], start + n, last[2], no + 1))
    return (*intervals, (start, start + n, no, no + 1))


def _range_nodes(ordered: DataFrame, tokenizer: str) -> DataFrame:
    """The nodes of every range as its task sees them, places and numbers counted from 0, and a last row about the range.

    A node's ancestors are the first `shared` nodes of the range's first path (its spine), then `own`, merged.
    """
    schema = T.StructType.fromDDL(_NODE)
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, block = Codec(tokenizer), TaskContext.get().partitionId()
        no = at = 0
        path: list[bytes] = []
        low: list[bytes] = []
        spine: list[tuple] = []
        stack: list[tuple] = []  # (at, n, no, tokens above it, spine nodes up to it, own intervals up to it)
        first = True
        for b in batches:
            new, todo = [], []
            for key, turns, own in zip(*(b.column(c).to_pylist() for c in ("key", "turns", "path")), strict=True):
                common = 0
                while common < min(len(path), len(own)) and path[common] == own[common]:
                    common += 1
                new.append((key, common, turns[common:], first))
                todo += [(t["role"], t["text"]) for t in turns[common:]]
                low = own if first else low
                path, first = own, False
            ids, rows = iter(codec.encode(todo)), []
            for key, common, turns, on_spine in new:
                del stack[common:]
                for k, t in enumerate(turns):
                    tokens, start, end = next(ids)
                    if t["role"] != LOSS_ROLE:
                        start = end
                    above = stack[-1] if stack else (0, 0, 0, 0, 0, ())
                    position = above[3] + above[1]
                    rows.append((block, no, above[4], len(stack), key if k == len(turns) - 1 else None, t["role"], at, len(tokens), position, tokens, start, end,
                                 above[0] if stack else None, [dict(zip(("start", "end", "first", "last"), x, strict=True)) for x in above[5]], None, None, None, None))
                    if on_spine:
                        spine.append((at, len(tokens), no))
                        stack.append((at, len(tokens), no, position, above[4] + 1, ()))
                    else:
                        stack.append((at, len(tokens), no, position, above[4], _joined(above[5], at, len(tokens), no)))
                    no, at = no + 1, at + len(tokens)
            if rows:
                yield _batch(rows, arrow)
        if not first:
            as_rows = lambda nodes: [{"at": x[0], "n": x[1], "no": x[2]} for x in nodes]
            yield _batch([(block, None, *[None] * 12, as_rows(spine), as_rows(stack), low, path)], arrow)

    return ordered.select("key", "turns", "path").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _seams(nodes: DataFrame) -> dict[int, tuple[int, int, int, list[tuple[int, int, int]]]]:
    """Per range: the tokens and the nodes before it, how many tokens of its spine repeat, and (start, n, no) of the nodes that do."""
    out, tokens, count = {}, 0, 0
    path: list = []
    stack: list[tuple[int, int, int]] = []
    for r in nodes.filter("no IS NULL").select("block", "spine", "stack", "low", "high").orderBy("block").toLocalIterator():  # a row for each range
        n = 0
        while n < min(len(path), len(r.low)) and path[n] == r.low[n]:
            n += 1
        shared = stack[:n]
        repeated = sum(x.n for x in r.spine[:n])
        out[r.block] = (tokens, count, repeated, shared)
        last = r.stack[-1]
        stack = [shared[i] if x.no < n else (tokens + x["at"] - repeated, x.n, count + x.no - n) for i, x in enumerate(r.stack)]
        tokens, count, path = tokens + last["at"] + last.n - repeated, count + last.no + 1 - n, r.high
    return out


def _placed(nodes: DataFrame, seams) -> DataFrame:
    """The nodes at their final places and numbers, those that a range repeats left out; `seams` is broadcast."""
    schema = T.StructType.fromDDL(_FINAL)
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            rows = []
            for x in b.to_pylist():
                tokens, count, repeated, shared = seams.value[x["block"]]
                n = len(shared)
                if x["no"] < n:
                    continue
                if x["block"] not in held:
                    held.clear()
                    held[x["block"]] = [()]
                    for node in shared:
                        held[x["block"]].append(_joined(held[x["block"]][-1], *node))
                place = lambda at: tokens + at - repeated  # noqa: B023, E731
                number = lambda no: count + no - n  # noqa: B023, E731
                attention = held[x["block"]][min(x["shared"], n)]
                parts = [(i["start"], i["end"], i["first"], i["last"]) for i in x["own"]]
                if x["shared"] > n:  # the rest of the spine stands in a row
                    parts = [(repeated, x["spine_end"], n, x["shared"]), *parts]
                for start, end, low, high in parts:
                    start, end, low, high = place(start), place(end), number(low), number(high)
                    if attention and attention[-1][1] == start and attention[-1][3] == low:
                        attention = (*attention[:-1], (attention[-1][0], end, attention[-1][2], high))
                    else:
                        attention = (*attention, (start, end, low, high))
                start = place(x["at"])
                if x["parent"] is None:
                    parent = None
                elif x["depth"] <= x["shared"] and x["depth"] <= n:
                    parent = shared[x["depth"] - 1][0]
                else:
                    parent = place(x["parent"])
                rows.append((start, number(x["no"]), x["n_tokens"], attention[0][0] if attention else start, x["depth"], x["role"], x["position"], x["tokens"], x["loss_from"], x["loss_to"], parent,
                             [dict(zip(("start", "end", "first", "last"), i, strict=True)) for i in attention], x["key"]))
            if rows:
                yield _batch(rows, arrow)

    return nodes.mapInArrow(run, schema)


def build(turns: DataFrame, out_dir: str, tokenizer: str) -> None:
    """Write `nodes` and `conversations` (conv_id, key of its last node) under `out_dir`.

    Nodes: start, no, n_tokens, tree (start of its root), depth, role, position, tokens, loss_from, loss_to, parent (its start),
    attention (merged intervals of its ancestors: start, end in places, first, last in numbers), key (of the conversations that end here, else null).
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    convs = whole_conversations(turns)
    distinct = convs.groupBy("key").agg(F.first("turns").alias("turns"), F.first("path").alias("path"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    nodes = stored(_range_nodes(ordered, tokenizer), "nodes")
    seams = spark.sparkContext.broadcast(_seams(nodes))  # a path for each range
    ends = nodes.filter("no IS NULL").select("block", "spine")
    # where the spine ends that a node shares: joined as a row for each range
    rows = nodes.filter("no IS NOT NULL").drop("spine", "stack", "low", "high").join(F.broadcast(ends), "block")
    last = F.get("spine", F.col("shared") - 1)
    rows = rows.withColumn("spine_end", F.when(F.col("shared") > 0, last["at"] + last["n"])).drop("spine")
    _placed(rows, seams).write.option("compression", "zstd").parquet(f"{out_dir}/nodes")
    convs.select("conv_id", "key").write.option("compression", "zstd").parquet(f"{out_dir}/conversations")


def position_ids(nodes: DataFrame) -> DataFrame:
    """The nodes with `position_ids`, one for each token."""
    return nodes.withColumn("position_ids", F.sequence("position", F.col("position") + F.col("n_tokens") - 1))


def read_turns(spark: SparkSession, out_dir: str, tokenizer: str) -> DataFrame:
    """no, role, text, loss_text and formatted_chars of every node, from its tokens and loss range."""
    schema = T.StructType.fromDDL("no long, role string, text string, loss_text string, formatted_chars long")
    arrow = spark_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer)
        for b in batches:
            rows = []
            for no, tokens, low, high in zip(*(b.column(c).to_pylist() for c in ("no", "tokens", "loss_from", "loss_to")), strict=True):
                role, text, chars = codec.decode(tokens)
                rows.append((no, role, text, unescape(codec.text(tokens[low:high])), chars))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return spark.read.parquet(f"{out_dir}/nodes").select("no", "tokens", "loss_from", "loss_to").mapInArrow(run, schema)


def read_conversations(spark: SparkSession, out_dir: str, tokenizer: str) -> DataFrame:
    """conv_id, turns (role, text, loss_text, formatted_chars) in order, put together from the tree's nodes.

    Distinct conversations are put together once and then joined to their ids; the rows of a node that many
    share, or of a conversation with many copies, are on the side of the join that can be split.
    """
    ends = spark.read.parquet(f"{out_dir}/nodes").filter("key IS NOT NULL")
    path = F.flatten(F.transform("attention", lambda i: F.sequence(i["first"], i["last"] - 1)))
    steps = ends.select("key", F.explode(F.array_append(path, F.col("no"))).alias("no"))  # numbers grow along a path
    turns = steps.join(read_turns(spark, out_dir, tokenizer), "no").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "role", "text", "loss_text", "formatted_chars"))).alias("turns"))
    return spark.read.parquet(f"{out_dir}/conversations").join(turns, "key").drop("key")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of conversations read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["formatted_chars"])
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), chars.alias("formatted_chars"))
