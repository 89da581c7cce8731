import hashlib
import random

import pytest

from concord.llm import chat
from tests.llm import cases

KINDS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["", "\\", "\\\\", "<s>", "</s>", "[INST]", "\\[INST]", "<", "</", "[/INST]x", "a\\", "é😀</s>[INST] ok [/INST]", None]


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(map(repr, out))


def _talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant"]) if turn else "user"
            rows.append((conv, turn, role, rng.choice(TRICKY) if turn > 1 else rng.choice(["hi", "hello"])))
    return rows


def test_round_trip(spark):
    rows = _talks(1)
    nodes, routes = chat.format_chats(spark.createDataFrame(rows, KINDS))
    assert sorted(map(repr, (tuple(r)[:5] for r in chat.read_back(nodes, routes).collect()))) == plain(rows)


@pytest.mark.parametrize("repeated", [False, True])
def test_trees_are_packed_depth_first(spark, repeated):
    rows = _talks(2)
    if repeated:
        rows = [r for r in rows for _ in range(1 + (r[0] + r[1]) % 3)]
    nodes, routes = chat.format_chats(spark.createDataFrame(rows, KINDS))
    found = {r.node: r for r in nodes.collect()}
    read = {r.conv: r.formatted_chars for r in chat.read_back(nodes, routes).collect()}
    ways = {}
    for r in routes.collect():
        ways.setdefault(r.conv, []).append((r.depth, r.node))
    prefixes = set()
    for conv, way in ways.items():
        texts = [found[n].formatted for _, n in sorted(way)]
        prefixes |= {tuple(texts[: i + 1]) for i in range(len(texts))}
        length = 0
        for depth, node in sorted(way):
            own = found[node]
            assert own.depth == depth and own.position == length and own.end - own.start == len(own.formatted)
            length += len(own.formatted)
            seen = {n for n, r in found.items() if r.tree == own.tree and r.start <= own.start < r.visible_until}
            assert seen == {n for d, n in way if d <= depth}
            assert own.parent == (None if depth == 0 else dict(way)[depth - 1])
        assert length == read[conv]
    assert len(found) == len(prefixes)
    for tree in {r.tree for r in found.values()}:
        at = 0
        for r in sorted((r for r in found.values() if r.tree == tree), key=lambda r: r.start):
            assert r.start == at
            at = r.end
    for r in found.values():
        assert (r.loss_start is not None) == r.formatted.startswith("<s>[INST]assistant[/INST]")


def test_parse_and_escape(spark):
    texts = [(i, t) for i, t in enumerate(TRICKY) if t is not None]
    escaped = spark.createDataFrame(texts, "i int, t string").select("i", chat.escape("t").alias("e")).collect()
    for r in escaped:
        assert chat.unescape(r.e) == TRICKY[r.i]
        assert chat.parse(f"<s>[INST]{r.e}[/INST]{r.e}</s>") == [(TRICKY[r.i], TRICKY[r.i])]


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "user", "before"), (1, 1, None, None), (None, 0, "assistant", "x"),
        (None, 1, "user", "y"), (2, 0, "user", "hi " * 50_000), (3, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, KINDS)
    df = df.select("*", *[chat.F.lit("x").alias(c) for c in ("node", "rank", "depth", "start", "path", "conv", "size")])
    nodes, routes = chat.format_chats(df)
    assert sorted(map(repr, (tuple(r)[:5] for r in chat.read_back(nodes, routes).collect()))) == plain(rows)
    nodes, routes = chat.format_chats(spark.createDataFrame([], KINDS))
    assert nodes.isEmpty() and chat.read_back(nodes, routes).isEmpty()


def test_given_table(spark):
    df = spark.read.parquet(f"{cases.SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    nodes, routes = chat.format_chats(df)
    assert sorted(map(repr, (tuple(r)[:5] for r in chat.read_back(nodes, routes).collect()))) == plain(rows)
