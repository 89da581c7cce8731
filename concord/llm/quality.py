"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. Learned
filters slide over byte embeddings within each chunk and are max-pooled; the
document's mean over its chunks passes one hidden layer and becomes one
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.learning import Adam, fit_in_task, labelled_sample, sigmoid

CHUNK, HOP = 512, 448  # bytes of a chunk, and from one chunk to the next
WIDTH, STEP = 12, 4  # bytes a filter sees, and from one position to the next
DIM, FILTERS, HIDDEN = 8, 32, 16
TRAIN_ROWS = 3000  # bound of the labelled sample
TRAIN_CHUNKS = 16  # chunks of one training text, spread evenly over it
EPOCHS, BATCH, RATE = 5, 32, 0.004
BLOCK = 256  # chunks in memory at once as filter inputs

Params = dict[str, np.ndarray]


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes; the last chunk is filled with zeros, and an empty text is one chunk of zeros."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (HOP, 1))


def _windows(p: Params, block: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * DIM) filter inputs."""
    embedded = p["embed"][block]
    s, positions = embedded.strides, (CHUNK - WIDTH) // STEP + 1
    view = np.lib.stride_tricks.as_strided(
        embedded, (len(block), positions, WIDTH * DIM), (s[0], STEP * s[1], s[2])
    )
    return np.ascontiguousarray(view)


def _filtered(p: Params, windows: np.ndarray) -> np.ndarray:
    flat = windows.reshape(-1, WIDTH * DIM) @ p["filters"] + p["bias"]
    return flat.reshape(len(windows), -1, FILTERS)


def _pooled(p: Params, block: np.ndarray) -> np.ndarray:
    return np.maximum(_filtered(p, _windows(p, block)).max(axis=1), 0)


def _head(p: Params, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(z @ p["mix"] + p["shift"])
    return h, h @ p["out"] + p["base"]


def score(p: Params, texts: list[str | None]) -> np.ndarray:
    """A probability of label 1 for each text, from all of its chunks."""
    sums, sizes = np.zeros((len(texts), FILTERS), np.float32), np.zeros(len(texts), np.int64)
    waiting, owners, held = [], [], 0

    def flush() -> None:
        nonlocal waiting, owners, held
        if waiting:
            pooled = _pooled(p, np.concatenate(waiting))
            np.add.at(sums, np.concatenate(owners), pooled)
        waiting, owners, held = [], [], 0

    for i, text in enumerate(texts):
        all_ = chunks(text)
        sizes[i] = len(all_)
        for at in range(0, len(all_), BLOCK):
            part = all_[at : at + BLOCK]
            waiting.append(part)
            owners.append(np.full(len(part), i))
            held += len(part)
            if held >= BLOCK:
                flush()
    flush()
    return sigmoid(_head(p, sums / sizes[:, None])[1]).astype(float)


def fit(rows: list[tuple], prior: float, seed: int = 7) -> Params:
    """Parameters learned from (key, label, text, lang) rows; classes weigh as ``prior`` says."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p: Params = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(f32),
        "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32),
        "mix": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f32),
        "shift": np.zeros(HIDDEN, f32),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(f32),
        "base": np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3))], f32),
    }
    data = []
    for _, label, text, _ in rows:
        all_ = chunks(text)
        pick = np.unique(np.linspace(0, len(all_) - 1, min(len(all_), TRAIN_CHUNKS)).astype(int))
        data.append((np.array(all_[pick]), label))
    ones = sum(label for _, label in data)
    if ones in (0, len(data)):
        return p
    weight = {1: prior * len(data) / ones, 0: (1 - prior) * len(data) / (len(data) - ones)}
    adam = Adam(p, RATE, 1e-4)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = [data[i] for i in order[at : at + BATCH]]
            adam.step(_gradients(p, batch, weight))
    return p


def _gradients(p: Params, batch: list[tuple], weight: dict[int, float]) -> Params:
    block = np.concatenate([c for c, _ in batch])
    sizes = np.array([len(c) for c, _ in batch])
    owner = np.repeat(np.arange(len(batch)), sizes)
    y = np.array([label for _, label in batch], np.float32)
    windows = _windows(p, block)
    raw = _filtered(p, windows)
    best = raw.argmax(axis=1)  # chunks x filters
    top = np.take_along_axis(raw, best[:, None, :], 1)[:, 0]
    z = np.zeros((len(batch), FILTERS), np.float32)
    np.add.at(z, owner, np.maximum(top, 0))
    z /= sizes[:, None]
    h, logit = _head(p, z)
    d = (sigmoid(logit) - y) * np.array([weight[int(v)] for v in y], np.float32) / len(batch)
    dh = d[:, None] * p["out"] * (1 - h * h)
    dz = dh @ p["mix"].T / sizes[:, None]
    g = dz[owner] * (top > 0)  # chunks x filters
    seen = windows[np.arange(len(block))[:, None], best]  # chunks x filters x inputs
    spots = block[np.arange(len(block))[:, None, None], best[:, :, None] * STEP + np.arange(WIDTH)]
    back = g[:, :, None, None] * p["filters"].T.reshape(FILTERS, WIDTH, DIM)[None]
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, spots.ravel(), back.reshape(-1, DIM))
    return {
        "embed": embed,
        "filters": np.einsum("cf,cfi->if", g, seen),
        "bias": g.sum(axis=0),
        "mix": z.T @ dh,
        "shift": dh.sum(axis=0),
        "out": h.T @ d,
        "base": np.array([d.sum()], np.float32),
    }


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Params:
    """Fit on at most ``rows`` labelled documents, half of each label where there are enough, as one Spark task."""
    sample, prior = labelled_sample(docs, labels, label, rows)
    return fit_in_task(sample, lambda found: fit(found, prior))


def classify(docs: DataFrame, model: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row, from its whole text only.

    NULL and empty texts share the score of a chunk of zeros. Repeated rows
    repeat, NULL keys stay, an empty table gives no row. Other columns are not
    read. Without labels of both kinds the score stays near their share.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(rows, f"key {narrow.schema['key'].dataType.simpleString()}, score double")
