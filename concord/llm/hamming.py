"""Nearest neighbours by multi-index hashing of learned binary codes.

A code holds the signs of a vector under learned rotations: iterative
quantization turns the principal axes of a sample so that signs lose least, and
does so again from other starts for more bits. Largest inner products become
smallest angles by one more component, which gives all rows one length.

Each block of rows has an index: codes are cut into substrings, and each
substring has a directory of its values with the rows that hold them. Two codes
within a radius of r differ in at most r // m bits in one of m substrings (in one
less in all but the first r % m + 1 of them), so that probing every substring's
directory within that finds every code within the radius. Those are ranked by
their inner products as floats. A query that finds too few in a block looks
again with a larger radius.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.grid import against, longs, matrix, numbered
from concord.session import pinned

SAMPLE = 4096  # rows the rotations and the radius are learned from; every row is indexed
BITS = 128
SUBSTRINGS = 4
WORD = 32  # bits in a substring
ROUNDS = 20
COVER = 0.97  # share of the sample's true neighbours that the radius holds
SLACK = 1e-9  # of a float product, before it is added up in order


@dataclass(frozen=True)
class Model:
    """Rotations for vectors of one length, the length that all rows get, and the radius of a search."""

    turn: np.ndarray
    length: float
    radius: int


def _with_length(vectors: np.ndarray, length: float) -> np.ndarray:
    """Rows of one length, by a further component; where the inner product is largest, the angle is least."""
    unit = vectors / length if length > 0 else vectors
    rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    return np.column_stack([unit, rest])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Queries of length one, without the further component; the largest component goes first against overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.column_stack([scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), np.zeros(len(vectors))])


def rotations(rows: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Columns whose signs are the code: as many quantized rotations side by side as give the bits."""
    dim = rows.shape[1]
    _, axes = np.linalg.eigh(rows.T @ rows)
    made, start = [], np.random.default_rng(7)
    while sum(t.shape[1] for t in made) < bits:
        turn = np.linalg.qr(start.normal(size=(dim, dim)))[0]
        laid = rows @ axes
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(laid.T @ np.where(laid @ turn > 0, 1.0, -1.0))
            turn = u @ v
        made.append(axes @ turn)
    return np.column_stack(made)[:, :bits]


def codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as one unsigned 32-bit number for each substring."""
    signs = np.packbits(vectors @ turn > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(signs).view("<u4").reshape(len(vectors), -1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, length: float, rows: int, near: int) -> Model:
    """Rotations and a radius from a sample of a table with so many rows.

    The radius holds ``COVER`` of the neighbours that sampled rows have in the
    sample. Of a sample's rows so many count as neighbours as its share of the
    table leaves of ``near``.
    """
    data = _with_length(sample, length)
    turn = rotations(data)
    asked = sample[: min(len(sample), 512)]
    told, held = codes(_unit(asked), turn), codes(data, turn)
    n = min(len(sample) - 1, max(1, -(-near * len(sample) // max(rows, 1))))
    if n < 1:
        return Model(turn, length, BITS)
    products = asked @ sample.T
    products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argpartition(-products, n - 1, axis=1)[:, :n]
    apart = np.sort(distance(told[:, None, :], held[best]).ravel())
    return Model(turn, length, int(apart[min(len(apart) - 1, int(COVER * len(apart)))]))


@cache
def ball(radius: int) -> np.ndarray:
    """All 32-bit words with at most so many bits set."""
    sets = (sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in combinations(range(WORD), n))
    return np.fromiter(sets, np.uint32)


SMALL_BALL = 2  # up to this radius a ball's words are looked up one by one if the directory is larger


class Index:
    """The substrings' directories over the codes of one block of rows."""

    def __init__(self, held: np.ndarray):
        self.codes = held
        self.parts = []
        for i in range(held.shape[1]):
            order = np.argsort(held[:, i], kind="stable")
            values, counts = np.unique(held[:, i], return_counts=True)
            self.parts.append((values, np.cumsum(counts) - counts, counts, order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within the radius, in order."""
        m = len(self.parts)
        found = np.zeros(len(self.codes), bool)
        for i, (values, starts, counts, order) in enumerate(self.parts):
            own = radius // m if i <= radius % m else radius // m - 1
            if own < 0:
                continue
            if own <= SMALL_BALL and len(ball(own)) < len(values):
                wanted = ball(own) ^ code[i]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                hits = at[values[at] == wanted]
                for s, n in zip(starts[hits].tolist(), counts[hits].tolist()):
                    found[order[s : s + n]] = True
            else:
                hits = np.bitwise_count(values ^ code[i]) <= own
                found[order[np.repeat(hits, counts)]] = True
        near = np.flatnonzero(found)
        return near[distance(self.codes[near], code) <= radius]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so that equal vectors have equal ones."""
    total = np.zeros(len(vectors))
    for x, q in zip(vectors.T, query, strict=True):
        total = total + x * q
    return total


def _search(models: dict[int, Model], near: int):
    def pick(stated: pa.Table, rows: pa.Table) -> pa.Table:
        """For each query the nearest rows of this block that lie within its radius."""
        out: list[tuple] = []
        if len(rows) and len(stated):
            held, asked = matrix(rows), matrix(stated)
            ids, row, q_row, q_id = longs(rows, "id"), longs(rows, "row"), longs(stated, "row"), longs(stated, "id")
            model = models.get(held.shape[1]) or Model(rotations(np.eye(held.shape[1] + 1)), float(rows.column("length")[0].as_py()), BITS // 2)
            index = Index(codes(_with_length(held, model.length), model.turn))
            told = codes(_unit(asked), model.turn)
            for q in range(len(asked)):
                radius, wanted = model.radius, min(near + 1, len(held))
                chosen = index.within(told[q], radius)
                while len(chosen) < wanted:
                    radius = min(BITS, radius + SUBSTRINGS)
                    chosen = index.within(told[q], radius)
                chosen = chosen[row[chosen] != q_row[q]]
                rough = held[chosen] @ asked[q]
                if len(chosen) > near:
                    least = np.partition(rough, len(rough) - near)[len(rough) - near]
                    chosen = chosen[rough >= least - SLACK * np.abs(rough).max()]
                exact = products(held[chosen], asked[q])
                for i in np.lexsort((ids[chosen], -exact))[:near].tolist():
                    out.append((int(q_row[q]), int(q_id[q]), int(ids[chosen[i]]), int(row[chosen[i]]), float(exact[i])))
        columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
        return pa.table([*columns, pa.array([x[4] for x in out], pa.float64())], ["row", "query_id", "id", "other", "score"])

    return pick, "row bigint, query_id bigint, id bigint, other bigint, score double"


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", near: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the ``near`` rows with the largest inner products found for the rows that ``is_query`` names.

    Every row is indexed and searched; the rotations and the radius are learned
    from at most ``SAMPLE`` rows, those whose keys hash least. A query has
    ``near`` rows, or all others if there are fewer. Scores are double products
    of the given vectors, nearest first, ties by smaller key.

    Rows whose vector is NULL, zero or holds a NULL or non-finite component, or
    that have no key, take no part. Each repeated row counts, also as a query
    of its own, and is a candidate of its copies. Rows with vectors of another
    length than the query's are no candidates; a length that the sample does
    not have gets unlearned rotations. An empty table gives no rows. Other
    columns are not read.
    """
    told = numbered(df, vector, F.col(key).cast("bigint").alias("id"), is_query.alias("is_query"))
    told = told.where(F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = pinned(told.withColumn("length", F.sqrt(square)))
    of_each = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    sample = rows.orderBy(F.xxhash64("id", "row")).limit(SAMPLE).select("dim", "vector").collect()  # a bounded sample
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.vector)
    known = of_each.where(F.col("dim").isin(list(by_dim))).collect() if by_dim else []  # one row for each length in the sample
    models = {r.dim: learn(np.array(by_dim[r.dim]), r.length, r.n, near) for r in known}
    queries = rows.where("is_query").select("row", "dim", "id", "vector")
    found = against(queries, rows.drop("is_query"), *_search(models, near))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "id", "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near)
    return ranked.select("query_id", "rank", "id", "score")
