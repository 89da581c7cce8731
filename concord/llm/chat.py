"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share the nodes of these turns.
Each tree, one for each different first turn, becomes one sequence: its nodes
are laid out depth-first and every node's text is emitted once. A node carries
the position of its first character in any conversation through it, and the
stretch of the sequence that may attend to it: that of its subtree. A character
attends to an earlier one exactly if it lies in the stretch of that one's node.

Lengths and positions count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.operators.skew import global_rank
from concord.session import pinned

# The control strings of the template.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, END, ROLE, TEXT)
ESCAPE = "\\"
ASSISTANT = "assistant"
BLOCK = 4096  # conversations whose lengths one task adds up

_PART = re.compile(r"\\(.)|(<s>|</s>|\[INST\]|\[/INST\])", re.DOTALL)


def escape(text: Column) -> Column:
    """The text with a backslash before every control string, and every backslash doubled."""
    found = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROLS:
        found = F.replace(found, F.lit(control), F.lit(ESCAPE + control))
    return found


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_text(role: Column, text: Column) -> Column:
    """One turn in the template; NULL parts count as empty."""
    empty = F.lit("")
    return F.concat(
        F.lit(BEGIN + ROLE), escape(F.coalesce(role, empty)), F.lit(TEXT), escape(F.coalesce(text, empty)), F.lit(END)
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, role, start = [], None, 0
    for found in _PART.finditer(formatted):
        control = found.group(2)
        if control == ROLE:
            start = found.end()
        elif control == TEXT:
            role, start = unescape(formatted[start : found.start()]), found.end()
        elif control == END:
            turns.append((role, unescape(formatted[start : found.start()])))
    return turns


def _turn_rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn with its place, formatted text, node and parent node, and the length of all before it."""
    rows = turns.select(
        F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        turn_text(F.col(role), F.col(text)).alias("formatted"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "formatted")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # equal turns are turns of their own
    rows = rows.withColumn("depth", F.row_number().over(order) - 1).withColumn("size", F.length("formatted").cast("long"))
    lanes = [F.xxhash64(F.lit(i), F.col("depth"), F.col("formatted")) for i in (1, 2)]
    prefix = F.concat(*[F.lpad(F.hex(F.bit_xor(x).over(so_far)), 16, "0") for x in lanes])
    rows = rows.withColumn("node", prefix).withColumn("position", F.sum("size").over(so_far) - F.col("size"))
    return rows.withColumn("parent", F.lag("node").over(order))


def _starts(nodes: DataFrame) -> DataFrame:
    """Where each node begins if all trees follow each other: by the conversation that brings it, then by depth."""
    brought = nodes.groupBy("rank").agg(F.sum("size").alias("size")).withColumn("block", F.expr(f"rank DIV {BLOCK}"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = brought.groupBy("block").agg(F.sum("size").alias("all"))  # one row for BLOCK conversations
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("block").orderBy("rank")
    offsets = brought.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(blocks, "block")
    offsets = offsets.select("rank", (F.col("ahead") + F.col("within")).alias("offset"))
    own = Window.partitionBy("rank").orderBy("depth")
    local = nodes.withColumn("local", F.sum("size").over(own) - F.col("size"))
    return local.join(offsets, "rank").withColumn("start", F.col("offset") + F.col("local")).drop("offset", "local")


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The packed trees, and the way of each conversation through them.

    Nodes: (tree, node, parent, depth, formatted, start, end, visible_until,
    position, loss_start, loss_end), one row for each different sequence of turns.
    ``start``, ``end`` and ``visible_until`` are places in the tree's sequence;
    the loss span covers the escaped text of an assistant's turn and is NULL
    for other roles. Routes: (conv, depth, node).

    Turns follow by ``turn``, NULL first, ties by their formatted text; a
    repeated row is a turn of its own. NULL roles and texts count as empty, and
    rows without a key form one conversation. An empty table gives empty frames.
    Other columns are not read.

    Nodes are named by a 128-bit sum of the hashes of their turns and depths.
    Depth-first order needs no walk: conversations sorted by their sequence of
    nodes are the leaves from left to right, and a node's place is that of the
    first conversation through it, then its depth.
    """
    rows = pinned(_turn_rows(turns, key, turn, role, text))
    steps = F.array_sort(F.collect_list(F.struct("depth", "node")))  # one conversation
    paths = rows.groupBy("conv").agg(F.concat_ws("", F.transform(steps, lambda x: x["node"])).alias("path"))
    ranked = global_rank(paths, ["path", "conv"], "rank").select(
        F.col("conv").alias("ranked_conv"), "rank", F.substring("path", 1, 32).alias("tree")
    )
    routed = rows.join(ranked, F.col("conv").eqNullSafe(F.col("ranked_conv")))
    nodes = routed.groupBy("node").agg(
        F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.min("size").alias("size"), F.min("position").alias("position"),
        F.first("tree").alias("tree"), F.first("parent").alias("parent"), F.first("role").alias("role"), F.first("formatted").alias("formatted"),
    )
    nodes = pinned(_starts(nodes))
    last = routed.groupBy("rank").agg(F.max_by("node", "depth").alias("node"))
    ends = last.join(nodes.select("node", (F.col("start") + F.col("size")).alias("until")), "node").select("rank", "until")
    reach = routed.select("node", "rank").join(ends, "rank").groupBy("node").agg(F.max("until").alias("until"))
    roots = nodes.groupBy("tree").agg(F.min("start").alias("first"))
    placed = nodes.join(reach, "node").join(roots, "tree")
    start = F.col("start") - F.col("first")
    end = start + F.col("size")
    head = len(BEGIN + ROLE + TEXT) + F.length(escape(F.col("role")))
    assistant = F.col("role") == ASSISTANT
    packed = placed.select(
        "tree", "node", "parent", "depth", "formatted", start.alias("start"), end.alias("end"),
        (F.col("until") - F.col("first")).alias("visible_until"), "position",
        F.when(assistant, start + head).alias("loss_start"), F.when(assistant, end - len(END)).alias("loss_end"),
    )
    return packed, rows.select("conv", "depth", "node")


READ = "conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """Digests of every conversation, from the packed text alone.

    The nodes on a conversation's way are joined in order, parsed and
    unescaped; the loss text is what the loss spans cut out of them.
    """
    span = F.struct(
        "depth", "formatted", (F.col("loss_start") - F.col("start")).alias("a"), (F.col("loss_end") - F.col("start")).alias("b")
    )
    found = routes.join(nodes.drop("depth"), "node").groupBy("conv").agg(F.array_sort(F.collect_list(span)).alias("way"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for way in batch.column(1):
                parts = way.as_py()
                whole = "".join(p["formatted"] for p in parts)
                told = parse(whole)
                loss = "".join(unescape(p["formatted"][p["a"] : p["b"]]) for p in parts if p["a"] is not None)
                said = "".join(f"{role}\n{text}\n" for role, text in told)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
                for column, value in zip(out, (len(told), digests[0], len(loss), digests[1], len(whole)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return found.mapInArrow(rows, READ.format(kind=routes.schema["conv"].dataType.simpleString()))
