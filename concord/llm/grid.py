"""Stated rows against all rows, in blocks of bounded size.

Every block of the stated rows meets every block of all rows in one group. Rows
go to blocks by a number of their own, so that equal keys or vectors do not
gather in one block, and blocks of vectors of another length never meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATED_BLOCK = 256  # rows in a block; each of these blocks reads all rows once
ROWS_BLOCK = 32_768


def numbered(df: DataFrame, vector: str, *columns: Column) -> DataFrame:
    """(row, dim, the columns, vector) of rows whose vector and components are there and finite.

    Floats stay floats while they move; any other numbers are doubles.
    """
    kind = "float" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "double"
    numbers = F.col(vector).cast(f"array<{kind}>")
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = df.select(*columns, numbers.alias("vector")).where(F.col("vector").isNotNull() & whole)
    return told.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id())


def against(stated: DataFrame, rows: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each block of the stated rows and each block of all rows with vectors of one length.

    Both frames have (row, dim) and should be pinned. There are as many blocks
    as keep each near its bound, so that what ``fn`` returns for a stated row
    comes from few blocks.
    """
    tall = max(1, -(-stated.count() // STATED_BLOCK))
    wide = max(1, -(-rows.count() // ROWS_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stated.withColumn("q_block", block(tall)).withColumn("r_block", every(wide))
    right = rows.withColumn("r_block", block(wide)).withColumn("q_block", every(tall))
    by = ["dim", "q_block", "r_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a block as a matrix of doubles."""
    vectors = table.column("vector").combine_chunks()
    numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return numbers.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def first(scores: np.ndarray, names: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """The first n of the chosen places, by higher score, then smaller name, in order."""
    if len(chosen) > n:
        least = np.partition(scores[chosen], len(chosen) - n)[len(chosen) - n]
        chosen = chosen[scores[chosen] >= least]
    return chosen[np.lexsort((names[chosen], -scores[chosen]))][:n]
