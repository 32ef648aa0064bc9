"""Chat formatting of reply trees.

Messages point to the message they answer.  Root-to-leaf paths come from
iterative self-joins with doubling steps: after round k each message knows the
one 2^k replies above it, with the score sum of those between, so
a thread of n messages takes log2(n) rounds.  A tree's branches (leaves) are ranked
by score and the best ones walked up by the same steps; texts are joined only to
the messages of chosen paths.  Each path is formatted as one conversation.

The template marks turns with ``<|im_start|>role`` and ``<|im_end|>``.  Inside texts
``<|`` is escaped by a backslash after ``<`` (one more where there are some
already), so no text can hold a mark and parsing restores it exactly.

Defined results: null texts and roles count as empty; null scores as 0; a reply
to a message that is not there starts a tree; messages on a cycle of replies have
no root and are in no path; ties of branches take the smaller leaf; repeated rows
need distinct nodes (:func:`thread_nodes` numbers them); a null conversation is one
of its own; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_arrow

START, END = "<|im_start|>", "<|im_end|>\n"
_MARKED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Roles whose texts are trained on.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return _MARKED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (code points) of learned texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def thread_nodes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply chains ``conv, node, parent, role, text``; null turns come first."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("__t"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("__t").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    rows = rows.withColumn("node", node)
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def best_paths(tree: DataFrame, best: int = 1) -> DataFrame:
    """``conv, leaf, score, rank, node, back`` of the ``best`` root-to-leaf paths of each conversation.

    ``tree`` has ``conv`` (not null), ``node``, ``parent``, ``score``; ``back`` counts replies from the leaf.
    """
    nodes, kind = tree.select("conv", "node"), tree.schema["node"].dataType
    parents = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    step = tree.join(parents, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum")
    )
    now = cut(step, "chat-step")
    first = now.where("up is not null").select("conv", "node", "up")
    steps, rooted, total = [], now.where("up is null").select("conv", "node", "sum"), None
    while True:
        open_ = now.where("up is not null")
        left = open_.count()
        if not left or left == total:
            break  # all reached a root, or what is left goes round
        total = left
        steps.append(open_.select("conv", "node", "up"))
        above = open_.select("conv", "node", "up", "sum").unionByName(rooted.withColumn("up", F.lit(None).cast(kind)))
        above = above.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"))
        # Messages that reached their root are set aside; only open ones are joined again.
        now = cut(open_.join(above, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum")), "chat-step")
        rooted = rooted.unionByName(now.where("up is null").select("conv", "node", "sum"))
    inner = first.select("conv", F.col("up").alias("node"))
    leaves = rooted.join(inner, ["conv", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("sum"), "node"))
    path = leaves.select("conv", F.col("node").alias("leaf"), F.col("sum").alias("score"), rank.alias("rank")).where(F.col("rank") <= best)
    path = path.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in range(len(steps) - 1, -1, -1):
        found = path.join(steps[k], ["conv", "node"], "left")
        both = F.array(F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + 2**k).alias("back")))
        path = found.select("conv", "leaf", "score", "rank", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x")).select("conv", "leaf", "score", "rank", "x.*")
    return path


def format_trees(tree: DataFrame, best: int = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per chosen path: ``conv, leaf, score, rank, formatted`` and ``loss_spans`` (array of start and end).

    ``tree`` has ``conv``, ``node`` (unique in it), ``parent``, ``score``, ``role`` and ``text``.
    """
    kind = tree.schema["conv"].dataType
    # A string that is never null, for joins.
    keyed = tree.select(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")).alias("conv"), F.col("conv").alias("own"), "node", "parent", "score", "role", "text")
    paths = best_paths(keyed.select("conv", "node", "parent", "score"), best)
    turns = paths.join(keyed.select("conv", "own", "node", "role", "text"), ["conv", "node"])
    turn = F.struct((-F.col("back")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv", "leaf").agg(F.first("own").alias("own"), F.first("score").alias("score"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.select("own", "leaf", "score", "rank", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a conversation may be long: one at a time
                one = batch.slice(i, 1)
                text, spans = format_turns(list(zip(one.column(4)[0].as_py(), one.column(5)[0].as_py())), learned)
                columns = [*(one.column(j) for j in range(4)), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], span)]
                yield pa.RecordBatch.from_arrays(columns, ["conv", "leaf", "score", "rank", "formatted", "loss_spans"])

    fields = rows.schema.fields
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return map_arrow(rows, run, T.StructType([T.StructField("conv", kind), *fields[1:4], T.StructField("formatted", T.StringType()), T.StructField("loss_spans", spans)]))


def read_back(formatted: DataFrame, id_col: str = "conv") -> DataFrame:
    """Digests of what the formatted text and its loss mask hold."""
    source = formatted.select(id_col, "formatted", "loss_spans")
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                turns = parse_turns(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                out.append((len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names)

    types = (T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType())
    return map_arrow(source, run, T.StructType([source.schema.fields[0], *(T.StructField(n, k) for n, k in zip(names[1:], types))]))
