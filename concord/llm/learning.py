"""Labelled documents, all or a bounded sample, and a trainer that runs as one Spark task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import remainder

BROADCAST_KEYS = 5_000_000  # labels that are counted first and then held by every executor; more are joined by a shuffle
MAX_TRAIN_CHARS = 200_000  # longer texts are left out of bounded samples, never out of scoring


class Adam:
    """Step sizes from running moments, one pair of them for each parameter array."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, s, p = self.mean[k], self.square[k], self.params[k]
            m *= 0.9
            m += np.float32(0.1) * g
            s *= 0.999
            s += np.float32(0.001) * g * g
            step = np.sqrt(s)
            step += 1e-8
            np.divide(m, step, out=step)
            step *= rate
            if self.decay:
                step += self.rate * self.decay * p
            p -= step


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _usable(labels: DataFrame, label: str, key: str) -> DataFrame:
    return (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(key, 4) != 2))
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max(label).cast("int").alias("__label"))
    )


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, float]:
    """(key, label, text, lang) of all labelled documents with a text, and the share of label 1 among all labels.

    Held-out keys (crc32 of the key modulo 4 is 2), NULL keys and labels other
    than 0 and 1 take no part; of several labels of a key the largest counts.
    Several documents of a key all stay.
    """
    usable = _usable(labels, label, key)
    ones, n = usable.agg(F.sum("__label"), F.count(F.lit(1))).head()
    # Without its keys on every executor, a join would first move the texts of all documents.
    usable = F.broadcast(usable) if n <= BROADCAST_KEYS else usable
    found = docs.join(usable, F.col(key) == F.col("__key")).where(F.col(text).isNotNull())
    columns = [F.col(key).alias("key"), F.col("__label").alias("label"), F.col(text).alias("text"), F.col(lang).alias("lang")]
    return found.select(*columns), (ones or 0) / max(1, n)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, float]:
    """(key, label, text, lang) of at most ``rows`` labelled documents, and the share of label 1 among all labels.

    Half of the rows are meant for each label, chosen by a hash of the key.
    Held-out keys (crc32 of the key modulo 4 is 2), NULL keys and labels other
    than 0 and 1 take no part; of several labels of a key the largest counts,
    of several documents of a key the one with the least text. The driver holds the chosen keys only, at most ``rows`` of them.
    """
    usable = _usable(labels, label, key)
    counts = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    chosen = []
    for value in (0, 1):
        part = usable.where(F.col("__label") == value).orderBy(F.xxhash64("__key"), "__key").limit(rows // 2)
        chosen += [tuple(r) for r in part.collect()]
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    kind = labels.schema[key].dataType.simpleString()
    keys = docs.sparkSession.createDataFrame(chosen, f"__key {kind}, __label int")
    found = docs.join(F.broadcast(keys), F.col(key) == F.col("__key")).where(F.length(text) <= MAX_TRAIN_CHARS)
    columns = [F.col(key).alias("key"), F.col("__label").alias("label"), F.struct(F.col(text).alias("text"), F.col(lang).alias("lang")).alias("doc")]
    single = found.select(*columns).groupBy("key", "label").agg(F.min("doc").alias("doc"))
    return single.select("key", "label", "doc.text", "doc.lang"), prior


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """``fit`` of all rows of a bounded sample, in the order of their keys, run by one task that Spark can repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        model = pickle.dumps(fit(sorted(rows, key=repr)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").head()
    return pickle.loads(found[0]) if found else fit([])
