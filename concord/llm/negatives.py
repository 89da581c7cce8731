"""Hard negatives by Kronecker-packed products.

All vectors are whole numbers. A block of candidates is packed by component: the
components of all its candidates, with a bias that makes none negative, are
fields of one wide integer, wide enough apart that a whole inner product fits
each. An anchor multiplies each of these integers by its own biased component,
once, and adds them up; every field then holds one biased inner product, from
which the exact one follows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.grid import against, first, longs, matrix, numbered
from concord.session import pinned

SCALE = 256  # fixed value
EXACT = 1 << 52  # whole doubles below this are exact
MOST = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit numbers, or Python's where those would not do."""
    if not vectors.size or np.abs(vectors).max() < EXACT / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in vectors.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(vectors.shape)


class Packed:
    """A block of candidates as one wide integer for each component."""

    def __init__(self, candidates: np.ndarray, anchor_bound: int):
        self.n, self.dim = candidates.shape
        self.anchor_bias = anchor_bound
        self.bias = max(map(abs, (int(candidates.min(initial=0)), int(candidates.max(initial=0)))))
        bits = (self.dim * 2 * self.anchor_bias * 2 * self.bias).bit_length()
        self.bytes = next((b for b in (1, 2, 4, 8) if bits <= 8 * b - 1), bits // 8 + 1)
        raised = candidates + self.bias
        self.fields = [self._joined(raised[:, j]) for j in range(self.dim)]
        self.sums = raised.sum(axis=1) if self.bytes <= 8 else raised.astype(object).sum(axis=1)

    def _joined(self, column: np.ndarray) -> int:
        if self.bytes <= 8:
            return int.from_bytes(column.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in column), "little")

    def products(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of an anchor with all candidates; those beyond 64 bits show the nearest there is."""
        own = [int(x) for x in anchor]
        total = sum(((x + self.anchor_bias) * field for x, field in zip(own, self.fields, strict=True)), 0)
        raw = total.to_bytes(self.bytes * self.n, "little")
        less = self.bias * sum(own)
        if self.bytes <= 8:
            biased = np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64)
            return biased - self.anchor_bias * self.sums - less
        exact = (
            int.from_bytes(raw[at * self.bytes : (at + 1) * self.bytes], "little") - self.anchor_bias * int(self.sums[at]) - less
            for at in range(self.n)
        )
        return np.array([max(-MOST, min(MOST, x)) for x in exact], np.int64)


def _bound(values: np.ndarray) -> int:
    return max(map(abs, (int(values.min(initial=0)), int(values.max(initial=0)))))


def _positives(n: int, scale: int):
    def pick(stated: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor the first n other rows of its label in this block."""
        out: list[tuple] = []
        anchors, candidates = whole(matrix(stated), scale), whole(matrix(rows), scale)
        labels, own = longs(rows, "label"), longs(stated, "label")
        ids, row = longs(rows, "id"), longs(rows, "row")
        a_row = longs(stated, "row")
        for label in np.unique(own) if len(rows) else ():
            at = np.flatnonzero(labels == label)
            mine = np.flatnonzero(own == label)
            if not len(at):
                continue
            packed = Packed(candidates[at], _bound(anchors[mine]))
            for a in mine.tolist():
                scores = packed.products(anchors[a])
                others = np.flatnonzero(row[at] != a_row[a])
                for i in first(scores, ids[at], others, n).tolist():
                    out.append((int(a_row[a]), int(ids[at][i]), int(row[at][i]), int(scores[i])))
        names = ("row", "positive_id", "positive_row", "positive_score")
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(names)})

    return pick, "row bigint, positive_id bigint, positive_row bigint, positive_score bigint"


def _negatives(n: int, scale: int, low: int, high: int):
    def pick(stated: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor and positive the first n rows of another label in this block whose score is in the band."""
        out: list[tuple] = []
        if len(rows) and len(stated):
            anchors, candidates = whole(matrix(stated), scale), whole(matrix(rows), scale)
            labels, own, ids, row = longs(rows, "label"), longs(stated, "label"), longs(rows, "id"), longs(rows, "row")
            packed = Packed(candidates, _bound(anchors))
            for a, (a_row, positives) in enumerate(zip(longs(stated, "row").tolist(), stated.column("positives").to_pylist(), strict=True)):
                scores, others = packed.products(anchors[a]), labels != own[a]
                for p in positives:
                    best = p["positive_score"]
                    within = others & (scores <= high * best // 100) & (scores >= -(-low * best // 100))
                    for i in first(scores, ids, np.flatnonzero(within), n).tolist():
                        out.append((a_row, p["place"], best, p["positive_id"], int(ids[i]), int(row[i]), int(scores[i])))
        names = ("row", "place", "positive_score", "positive_id", "negative_id", "negative_row", "negative_score")
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(names)})

    fields = "row bigint, place bigint, positive_score bigint, positive_id bigint, negative_id bigint, negative_row bigint, negative_score bigint"
    return pick, fields


def _first_of(df: DataFrame, group: list[str], name: str, n: int, place: str) -> DataFrame:
    """The first n of each group; tasks cut their own rows to n first, before the shuffle."""
    order = [F.col(f"{name}_score").desc(), F.col(f"{name}_id"), F.col(f"{name}_row")]
    found = df.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return found.where(F.col(place) <= n)


def mine(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` names.

    A score is the inner product of whole components, floor(scale * x). The
    positives of an anchor are its first rows of the same label; a negative of
    an anchor and a positive has another label and from ``low`` to ``high``
    hundredths of the positive's score. Higher scores come first, ties by
    smaller key.

    Rows without a label, a vector, all components finite, or a key take no
    part. Each repeated row counts, also as an anchor of its own; rows with
    vectors of another length than the anchor's are no candidates of it. An
    anchor without positives or without negatives in the band, and an empty
    table, give no rows; a positive with a negative score has none. Scores
    beyond 64 bits are taken as the largest or least 64-bit number. Other
    columns are not read.
    """
    given = F.col(label) if isinstance(label, str) else label
    told = numbered(df, vector, F.col(key).cast("bigint").alias("id"), given.cast("bigint").alias("label"), is_anchor.alias("is_anchor"))
    rows = pinned(told.where(F.col("id").isNotNull() & F.col("label").isNotNull()))
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    near = _first_of(against(anchors, rows, *_positives(positives, scale)), ["row"], "positive", positives, "place")
    told = F.struct(F.col("place").cast("bigint").alias("place"), "positive_id", "positive_score")
    lists = near.groupBy("row").agg(F.sort_array(F.collect_list(told)).alias("positives"))  # a few for each anchor
    stated = pinned(anchors.join(lists, "row"))
    found = _first_of(against(stated, rows, *_negatives(negatives, scale, low, high)), ["row", "place"], "negative", negatives, "rank")
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    return found.join(names, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
