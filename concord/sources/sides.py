"""The two sides of a comparison as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.rows import Pair


@dataclass(frozen=True)
class Table:
    """A named table or view; ``where`` filters this side in every check."""

    name: str
    where: str | None = None


@dataclass(frozen=True)
class ParquetFiles:
    """Parquet data at a path, as a table would be."""

    path: str
    where: str | None = None


@dataclass(frozen=True)
class Query:
    """A SELECT statement as a side."""

    sql: str


@dataclass(frozen=True)
class SqlFile:
    """A file whose text is a SELECT statement; it must lie under a base folder."""

    path: str
    base_dir: str = "."


@dataclass(frozen=True)
class Derived:
    """A column computed on each side before comparing, under one target name."""

    name: str
    target: str
    source_expression: str | None = None
    target_expression: str | None = None


Side = Table | ParquetFiles | Query | SqlFile


def strip_terminator(sql: str) -> str:
    """One trailing semicolon and the space around it do not belong to a query."""
    text = sql.strip()
    return text[:-1].rstrip() if text.endswith(";") else text


def read_sql_file(side: SqlFile) -> str:
    base = Path(side.base_dir).resolve()
    path = (base / side.path).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{side.path!r} lies outside {side.base_dir!r}")
    return path.read_text(encoding="utf-8")


def load(spark: SparkSession, side: Side | DataFrame) -> DataFrame:
    """Read a side; a filter stays an expression, so it reaches the scan."""
    if isinstance(side, DataFrame):
        return side
    if isinstance(side, Table):
        df = spark.table(side.name)
    elif isinstance(side, ParquetFiles):
        df = spark.read.parquet(side.path)
    elif isinstance(side, Query):
        return spark.sql(strip_terminator(side.sql))
    else:
        return spark.sql(strip_terminator(read_sql_file(side)))
    return df.where(F.expr(side.where)) if side.where else df


def label(side: Side | DataFrame) -> str:
    """How a result names a side."""
    if isinstance(side, Table):
        return side.name
    if isinstance(side, ParquetFiles):
        return side.path.rstrip("/").rsplit("/", 1)[-1]
    if isinstance(side, SqlFile):
        return Path(side.path).name or side.path
    return "(custom query)"


def derive(
    source: DataFrame, target: DataFrame, mapping: Sequence[Pair | Derived | tuple[str, str]], exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, list[Pair]]:
    """Compute derived columns and drop excluded ones; plain pairs remain.

    An excluded name counts on either side of a pair.
    """
    pairs = []
    for m in mapping:
        if isinstance(m, Derived):
            if m.source_expression:
                source = source.withColumn(m.name, F.expr(m.source_expression))
            if m.target_expression:
                target = target.withColumn(m.target, F.expr(m.target_expression))
            pairs.append(Pair(m.name, m.target))
        else:
            pairs.append(m if isinstance(m, Pair) else Pair(*m))
    kept = [p for p in pairs if p.source not in exclude and p.target not in exclude]
    gone_source = {p.source for p in pairs} - {p.source for p in kept} | set(exclude)
    gone_target = {p.target for p in pairs} - {p.target for p in kept} | set(exclude)
    return source.drop(*gone_source), target.drop(*gone_target), kept


def capped(df: DataFrame, max_rows: int | None) -> DataFrame:
    """A row cap, only where a caller asks for one."""
    if max_rows is None:
        return df
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    return df.limit(max_rows)
