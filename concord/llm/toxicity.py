"""Toxicity: a convolutional text classifier over hashed words, in numpy.

Words are hashed to embeddings; filters of several widths slide over a whole
document, each is max-pooled over all of its words, and the pooled values give
one probability. All labelled documents take part: four in five teach the
weights, the fifth sets the thresholds by language that decisions use; scores
never depend on those. They are dealt to shares by a hash of the key; in each
epoch a task trains on each share from common weights, and the weights are
averaged: those of a word over the tasks that met it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.learning import Adam, labelled_rows, sigmoid
from concord.session import pinned

BUCKETS, DIM = 1 << 18, 8
WIDTHS, FILTERS = (1, 2, 3), 16
PAD = max(WIDTHS) - 1
SHARE_CHARS = 48_000_000  # of labelled texts that one task trains on
FAN_IN = 8  # models averaged by one task
EPOCHS, BATCH, RATE, WORD_RATE = 5, 32, 0.01, 0.1
BLANKED = 0.3  # share of words hidden in training
SEGMENT = 4096  # words pooled at once; segments of a longer text overlap by PAD
BLOCK = 32768  # words in memory at once as filter inputs
CALIBRATION = 5  # one in so many labelled rows sets thresholds instead of weights
LEAST_POSITIVES = 15  # a language with fewer takes the common threshold
DEFAULT_THRESHOLD = 0.3
SLACK = 0.01  # differences of F1 that a calibration set of this size cannot tell
CUTS = np.arange(1, 20) / 20  # possible thresholds

Params = dict[str, np.ndarray]
_APART = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """Bucket numbers from 1 of the lower-cased words; ASCII punctuation separates like white space."""
    words = (text or "").lower().encode().translate(_APART).split()
    return (np.fromiter(map(crc32, words), np.uint32, len(words)) % BUCKETS + 1).astype(np.int32)


def _stream(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, and where each begins.

    The zeros after each part keep filters that start at one of its words, or
    just behind the last, from reaching into the next part.
    """
    sizes = np.array([len(x) + PAD + 1 for x in parts])
    ids = np.zeros(sizes.sum() + PAD, np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for x, at in zip(parts, starts, strict=True):
        ids[at : at + len(x)] = x
    return ids, starts


def _convolved(p: Params, ids: np.ndarray) -> np.ndarray:
    """(positions, filters of all widths) before the pooling."""
    x = p["embed"][ids]
    n = len(ids) - PAD
    out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        part = out[:, i * FILTERS : (i + 1) * FILTERS]
        part[:] = p["bias"][i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            part += x[j : n + j] @ p[f"w{w}"][j]
    return out


def score(p: Params, texts: list[str | None]) -> np.ndarray:
    """A probability of label 1 for each text, from all of its words."""
    return _score(p, map(word_ids, texts), len(texts))


def _score(p: Params, found: Iterable[np.ndarray], n: int) -> np.ndarray:
    pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    waiting, owners, places, held = [], [], [], 0

    def flush() -> None:
        nonlocal waiting, owners, places, held
        if waiting:
            ids, starts = _stream(waiting)
            spans = np.stack([starts, starts + places], axis=1).ravel()
            tops = np.maximum.reduceat(_convolved(p, ids), spans, axis=0)[::2]
            np.maximum.at(pooled, np.array(owners), tops)
        waiting, owners, places, held = [], [], [], 0

    for i, ids in enumerate(found):
        for at in range(0, len(ids) + 1, SEGMENT):
            waiting.append(ids[at : at + SEGMENT + PAD])
            owners.append(i)
            places.append(min(SEGMENT, len(ids) - at + 1))
            held += len(waiting[-1])
            if held >= BLOCK:
                flush()
    flush()
    return sigmoid(pooled @ p["out"] + p["base"]).astype(float)


def initial(prior: float, seed: int = 7) -> dict:
    """A model before the first epoch: small random weights, and an output that gives the share of label 1."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p: Params = {"embed": rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(f32)}
    p["embed"][0] = 0
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(f32)
    p["bias"] = np.zeros(FILTERS * len(WIDTHS), f32)
    p["out"] = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(f32)
    p["base"] = np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3))], f32)
    moments = {f"{kind} {k}": np.zeros_like(v) for kind in ("mean", "square") for k, v in p.items() if k != "embed"}
    squares = np.full(BUCKETS + 1, 1e-6, f32)  # of the gradients that each word's embedding has met
    return {"params": p, "moments": moments, "squares": squares, "steps": 0}


def fit(rows: Iterable[list[tuple]], prior: float, start: dict | None = None, epoch: int = 0, share: int = 0) -> dict:
    """``start`` after one epoch over blocks of (ids, label) rows; ``times`` says how many documents pooled each word."""
    start = start or initial(prior)
    p = {k: v.copy() for k, v in start["params"].items()}
    squares, times, n = start["squares"].copy(), np.zeros(BUCKETS + 1, np.int64), 0
    adam = Adam({k: v for k, v in p.items() if k != "embed"}, RATE * (1 - epoch / EPOCHS), 1e-4)
    adam.mean = {k: start["moments"][f"mean {k}"].copy() for k in adam.params}
    adam.square = {k: start["moments"][f"square {k}"].copy() for k in adam.params}
    adam.t = start["steps"]
    rng = np.random.default_rng((7, epoch, share))
    for data in rows:
        n += len(data)
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = [data[i] for i in order[at : at + BATCH]]
            batch = [(np.where(rng.random(len(x)) < BLANKED, 0, x), label) for x, label in batch]
            grads, words, moves = _gradients(p, batch)
            squares[words] += (moves * moves).mean(axis=1)
            times[words] += 1
            p["embed"][words] -= WORD_RATE * moves / np.sqrt(squares[words])[:, None]
            p["embed"][0] = 0
            adam.step(grads)
    moments = {f"{kind} {k}": v for kind in ("mean", "square") for k, v in getattr(adam, kind).items()}
    return {"params": p, "moments": moments, "squares": squares, "steps": adam.t, "times": times, "rows": n}


def _tops(p: Params, ids: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where in its span each filter is largest, and its value there; a long stream goes block by block."""
    best = np.zeros((len(spans), FILTERS * len(WIDTHS)), np.int64)
    top = np.full(best.shape, -np.inf, np.float32)
    for at in range(0, spans[-1][1], BLOCK):
        raw = _convolved(p, ids[at : at + BLOCK + PAD])
        for i, (a, b) in enumerate(spans):
            a, b = max(a - at, 0), min(b - at, len(raw))
            if a < b:
                place = raw[a:b].argmax(axis=0) + a
                value = np.take_along_axis(raw, place[None], 0)[0]
                more = value > top[i]
                best[i][more], top[i][more] = place[more] + at, value[more]
    return best, top


def _gradients(p: Params, batch: list[tuple]) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients of the dense parameters; the words whose embeddings were pooled, and their gradients."""
    ids, starts = _stream([x for x, _ in batch])
    y = np.array([label for _, label in batch], np.float32)
    best, top = _tops(p, ids, [(int(a), int(a) + len(x) + 1) for a, (x, _) in zip(starts, batch, strict=True)])
    z = np.maximum(top, 0)
    d = (sigmoid(z @ p["out"] + p["base"]) - y) / len(batch)
    g = d[:, None] * p["out"] * (top > 0)
    grads = {k: np.zeros_like(v) for k, v in p.items() if k[0] == "w"}
    met, backs = [], []
    for i, w in enumerate(WIDTHS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(w):
            spots = ids[best[:, part] + j]
            grads[f"w{w}"][j] = np.einsum("bf,bfd->df", g[:, part], p["embed"][spots])
            back = g[:, part, None] * p[f"w{w}"][j].T[None]
            met.append(spots.ravel())
            backs.append(back.reshape(-1, DIM))
    words, place = np.unique(np.concatenate(met), return_inverse=True)
    moves = np.zeros((len(words), DIM), np.float32)
    np.add.at(moves, place, np.concatenate(backs))
    dense = {"bias": g.sum(axis=0), "out": z.T @ d, "base": np.array([d.sum()], np.float32)}
    return grads | dense, words, moves


def _pack(model: dict) -> pa.RecordBatch:
    """A model with the embeddings of those words only that its task met."""
    met = np.nonzero(model["times"])[0]
    lean = {k: v for k, v in model["params"].items() if k != "embed"}
    words = {"words": met, "embed": model["params"]["embed"][met], "squares": model["squares"][met], "times": model["times"][met]}
    blob = pickle.dumps(words | {"params": lean, "moments": model["moments"], "steps": model["steps"], "rows": model["rows"]})
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([blob], pa.binary())], ["slot", "model"])


def average(blobs: Iterable[bytes]) -> dict | None:
    """The mean of packed models: dense parameters by rows, those of a word by how often each task met it."""
    embed, squares, times = np.zeros((BUCKETS + 1, DIM)), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1, np.int64)
    sums, rows, steps = None, 0, 0
    for blob in blobs:
        m = pickle.loads(blob)
        at, k = m["words"], m["times"]
        embed[at] += m["embed"].astype(float) * k[:, None]
        squares[at] += m["squares"].astype(float) * k
        times[at] += k
        own = {(kind, name): v.astype(float) * m["rows"] for kind in ("params", "moments") for name, v in m[kind].items()}
        sums = own if sums is None else {name: v + own[name] for name, v in sums.items()}
        rows, steps = rows + m["rows"], max(steps, m["steps"])
    if not rows:
        return None
    per = np.maximum(times, 1)
    found = {kind: {n: (v / rows).astype(np.float32) for (o, n), v in sums.items() if o == kind} for kind in ("params", "moments")}
    found["params"]["embed"] = (embed / per[:, None]).astype(np.float32)
    return found | {"squares": (squares / per).astype(np.float32), "times": times, "steps": steps, "rows": rows}


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = average(blob.as_py() for batch in batches for blob in batch.column(1))
    if found:
        yield _pack(found)


def _epoch(data: DataFrame, tasks: int, model: dict, prior: float, epoch: int) -> dict:
    """The model after one epoch, in which each task trains on its own share."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (list(zip(*_read(batch), strict=True)) for batch in batches)
        found = fit(blocks, prior, model, epoch, TaskContext.get().partitionId())
        if found["rows"]:
            yield _pack(found)

    trained = data.where("NOT aside").select("ids", "label").mapInArrow(local, MODEL)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        trained = trained.repartition(tasks, F.pmod("slot", F.lit(tasks))).sortWithinPartitions("slot").mapInArrow(_averaged, MODEL)
    whole = trained.repartition(1).sortWithinPartitions("slot").mapInArrow(_averaged, MODEL)
    found = average(r["model"] for r in whole.collect())
    if found is None:
        return model
    met = found.pop("times") > 0
    for new, old in ((found["params"]["embed"], model["params"]["embed"]), (found["squares"], model["squares"])):
        new[~met] = old[~met]
    return found


MODEL = "slot int, model binary"


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
    return [np.frombuffer(x.as_py(), np.int32) for x in batch.column(0)], batch.column(1).to_pylist()


def _shares(rows: DataFrame) -> tuple[DataFrame, int]:
    """(key, label, lang, ids, aside): one row for each key, that with the least text, dealt to shares and pinned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep, ids = [], []
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), strict=True)):
                if key != last:
                    keep.append(i)
                    ids.append(word_ids(text.as_py()).tobytes())
                last = key
            columns = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["key", "label", "lang", "ids"])

    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    shares = chars // SHARE_CHARS + 1
    order = F.xxhash64("key")
    dealt = rows.select("key", "label", "lang", "text").repartition(shares, F.pmod(order, F.lit(shares)))
    dealt = dealt.sortWithinPartitions(order, "key", "text", "lang")
    found = dealt.mapInArrow(read, f"key {rows.schema['key'].dataType.simpleString()}, label int, lang string, ids binary")
    return pinned(found.withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "key"), F.lit(CALIBRATION)) == 0)), shares


def _histogram(aside: DataFrame, model: dict) -> list[tuple]:
    """(lang, at, n, ones): how many rows and positives of each language reach ``at`` of the possible thresholds."""
    params = model["params"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _read(batch)
            at = np.searchsorted(CUTS, _score(params, ids, len(ids)), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(1), batch.column(2)], ["at", "label", "lang"])

    rows = aside.select("ids", "label", "lang").mapInArrow(scored, "at int, label int, lang string")
    sums = pinned(rows.groupBy("lang", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")))
    every = sums.groupBy("at").agg(F.sum("n"), F.sum("ones")).collect()
    enough = sums.groupBy("lang").agg(F.sum("ones").alias("positives")).where(F.col("positives") >= LEAST_POSITIVES)
    return [(None, *r) for r in every] + [tuple(r) for r in sums.join(enough.drop("positives"), "lang").collect()]


def _thresholds(histogram: list[tuple]) -> dict[str | None, float]:
    counts: dict = {}
    for lang, at, n, ones in histogram:
        own = counts.setdefault(lang, np.zeros((2, len(CUTS) + 1), np.int64))
        own[:, at] += n, ones
    found = {}
    for lang, (rows, ones) in counts.items():
        if ones.sum() < LEAST_POSITIVES:
            continue
        above, hits = (x[::-1].cumsum()[::-1][1:] for x in (rows, ones))
        f1 = 2 * hits / (above + ones.sum())
        good = CUTS[f1 >= f1.max() - SLACK]
        found[lang] = float(good[np.abs(good - DEFAULT_THRESHOLD).argmin()])
    return found


def calibrate(scores: np.ndarray, rows: list[tuple]) -> dict[str | None, float]:
    """For each language with enough positives, a threshold; under None, that of all languages.

    Among the thresholds whose F1 is within SLACK of the best, the one nearest to the default counts.
    """
    at = np.searchsorted(CUTS, scores, side="right")
    histogram = [(lang, i, 1, r[1]) for i, r in zip(at, rows, strict=True) for lang in {None, r[3]}]
    return _thresholds(histogram)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Fit on all labelled documents: EPOCHS epochs over those that teach, then thresholds from the others."""
    rows, prior = labelled_rows(docs, labels, label)
    data, shares = _shares(rows)
    kinds = data.where("NOT aside").select("label").distinct().count()
    model = initial(prior)
    if kinds < 2:
        return {"params": model["params"], "thresholds": {}}
    for epoch in range(EPOCHS):
        model = _epoch(data, shares, model, prior, epoch)
    return {"params": model["params"], "thresholds": _thresholds(_histogram(data.where("aside"), model))}


def threshold(model: dict, lang: Column) -> Column:
    """The calibrated threshold of a language; others, and NULL, take the common one."""
    found = F.lit(model["thresholds"].get(None, DEFAULT_THRESHOLD))
    for name, value in sorted((k, v) for k, v in model["thresholds"].items() if k is not None):
        found = F.when(lang == name, value).otherwise(found)
    return found


def toxicity(model: dict, text: Column) -> Column:
    """The score of each text as a column; NULL and empty texts share the score of no words."""
    params = model["params"]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(params, texts.tolist()), dtype=float)

    return scored(text)


def classify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, score, threshold, rejected) for each row; the score comes from its whole text only.

    NULL and empty texts share the score of no words. Repeated rows repeat,
    NULL keys stay, an empty table gives no row, other columns are not read.
    Without labels of both kinds the score stays near their share.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), toxicity(model, F.col(text)).alias("score"))
    cut = threshold(model, F.col("lang"))
    return narrow.select("*", cut.alias("threshold"), (F.col("score") >= cut).alias("rejected"))


def keep_clean(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the calibrated decision does not reject, with their columns unchanged."""
    return docs.where(toxicity(model, F.col(text)) < threshold(model, F.col(lang)))
