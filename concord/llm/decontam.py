"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: a copy
with at most e edits leaves at least one piece untouched. Exact hits of pieces
are found for all items at once, each hit names the stretch of text where its
item could lie, and Myers' bit-parallel algorithm gives the smallest edit
distance between the item and any part of that stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.1  # edits per character of an item
GRAM = 4
BLOCK_BYTES = 32 << 20  # items matched in one pass over the documents

ITEM_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

Hit = tuple[int, int, int]  # edit distance, start and end in the normalized text


def normalize(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive parts of nearly equal length, with their offsets."""
    n = min(errors + 1, len(item))
    bounds = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def myers(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of ``item`` in ``text``, or None above the limit.

    Bit i of the vectors tells how the distance changes between rows i and
    i + 1 of a column; the match may start anywhere. Among equals the first end
    counts.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0) if m <= limit else None
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All items of one block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = {i: normalize(t) for i, t in items}
        self.items = {i: t for i, t in self.items.items() if t}
        self.errors = {i: budget(t, rate) for i, t in self.items.items()}
        self.grams = {i: {t[j : j + GRAM] for j in range(len(t) - GRAM + 1)} for i, t in self.items.items()}
        self.automaton = ahocorasick.Automaton()
        spots: dict[str, list] = {}
        for i, t in self.items.items():
            for offset, piece in pieces(t, self.errors[i]):
                spots.setdefault(piece, []).append((i, offset + len(piece)))
        for piece, owners in spots.items():
            self.automaton.add_word(piece, owners)
        if spots:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, Hit]:
        """The best hit of every item that occurs in the text within its budget."""
        if not self.items:
            return {}
        body = normalize(text)
        stretches: dict[int, list[list[int]]] = {}
        for end, owners in self.automaton.iter(body):
            for i, until in owners:
                start = end + 1 - until
                stretch = [max(0, start - self.errors[i]), start + len(self.items[i]) + self.errors[i]]
                found = stretches.setdefault(i, [])
                if found and stretch[0] <= found[-1][1]:
                    found[-1][0] = min(found[-1][0], stretch[0])
                    found[-1][1] = max(found[-1][1], stretch[1])
                else:
                    found.append(stretch)
        hits = {}
        for i, found in stretches.items():
            if (at := body.find(self.items[i])) >= 0:
                hits[i] = (0, at, at + len(self.items[i]))
            elif self.errors[i] and (hit := self._closest(i, body, found)):
                hits[i] = hit
        return hits

    def _hopeless(self, i: int, body: str, a: int, b: int) -> bool:
        """Whether no match within budget can lie there, as the place is too short or lacks too many character runs.

        Each character that is missing is an edit, and each edit spoils at most
        GRAM of the item's runs.
        """
        if min(b, len(body)) - a < len(self.items[i]) - self.errors[i]:
            return True
        grams, spoiled = self.grams[i], self.errors[i] * GRAM
        if len(grams) <= spoiled:
            return False
        there = {body[j : j + GRAM] for j in range(a, min(b, len(body)) - GRAM + 1)}
        return len(grams - there) > spoiled

    def _closest(self, i: int, body: str, stretches: list[list[int]]) -> Hit | None:
        item, best = self.items[i], None
        for a, b in stretches:
            if self._hopeless(i, body, a, b):
                continue
            if found := myers(item, body[a:b], self.errors[i]):
                if best is None or found[0] < best[0]:
                    # The start is the end of the best match of the reversed item, read backwards from here.
                    end = a + found[1]
                    head = myers(item[::-1], body[max(0, end - len(item) - found[0]) : end][::-1], found[0])
                    best = (found[0], end - (head[1] if head else len(item)), end)
        return best


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_BYTES (or one longer item), in the order of their keys; at least one block.

    The driver reads the stated test set a part at a time and holds one block;
    each block travels with the tasks of one pass over the documents, so what a
    task holds is bounded, too.
    """
    block: list[tuple] = []
    size = 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        if block and size + len(row[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def _matcher(block: list[tuple], rate: float) -> Matcher:
    """Items go by their place in the block, so that those with one key or none are all looked for."""
    return Matcher([(place, item) for place, (_, item) in enumerate(block)], rate)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """(key, item, distance, start, end): items found in documents, one row per document row and item row.

    Positions count characters of the normalized text (lower case, one space
    between words). An item of n characters may differ in ``rate * n`` edits,
    rounded down; of several places the closest and then the first counts. NULL
    and blank items match nothing, NULL and empty documents hold nothing. A
    repeated document row reports again, each item row reports on its own even
    if others share its key, and a NULL key on either side stays NULL. Texts and
    items may have any length. An empty table on either side gives
    no row. Other columns are not read.
    """
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    schema = f"key {kinds[0]}, item {kinds[1]}, distance int, start int, end int"
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = []
    for block in _blocks(items, item_key, item_text):

        def rows(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for place, hit in sorted(matcher.find(t.as_py()).items()):
                        for column, value in zip(out, (k, block[place][0], *hit), strict=True):
                            column.append(value)
                types = [batch.column(0).type, ITEM_TYPES[kinds[1]], pa.int32(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "item", "distance", "start", "end"])

        found.append(narrow.mapInArrow(rows, schema))
    return reduce(DataFrame.union, found)


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with their columns unchanged.

    Items count whether or not they have a key of their own. Rows pass through one by one: repeated rows, NULL keys and NULL texts stay
    unless their own text holds an item.
    """
    kept = docs
    for block in _blocks(items, item_key, item_text):
        kept = kept.where(~_holds(block, rate)(F.col(text)))
    return kept


def _holds(block: list[tuple], rate: float):
    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(block, rate)
        for batch in texts:
            yield pd.Series([bool(matcher.find(t)) for t in batch], dtype=bool)

    return holds
