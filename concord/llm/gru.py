"""A gated recurrent language model in numpy, trained and applied by Spark tasks.

The model sees a bounded vocabulary: the most frequent words, an end mark, and
RARE groups of all other words, told apart by their last bytes. Its output is
class-factored: first one of CLASSES classes, then a member of it. A word of a
rare group then takes its share of the group by its count in the training
documents, so every text has a probability. Training is truncated
backpropagation through windows of STEPS tokens with the state carried on;
every partition trains on its own documents from common weights, and the
weights are averaged after each round. Scoring carries the state from window
to window over whole documents.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import remainder
from concord.llm.learning import Adam
from concord.session import pinned

CLASSES, MEMBERS = 16, 32
RARE = 32
VOCABULARY = CLASSES * MEMBERS
WORDS = VOCABULARY - RARE - 1  # frequent words that the model knows one by one; id 0 is the end
KNOWN = 1 << 17  # bound of the words whose counts travel with the tasks; the counts of all others are joined
HIDDEN = 16
STEPS, WINDOW = 16, 32  # tokens of a training and of a scoring window
TRAIN_LANES, LANES = 128, 512  # documents side by side
RATE = 0.01
ROUNDS = 2  # each learns from its own one of as many equal shares of the training documents
FAN_IN = 32  # models averaged by one task
HELD_OUT = (7, 2)  # fixed values: documents whose crc32 modulo 7 is 2 are never learned from
FLUSH = 200_000  # different words a counting task holds before it passes them on
LOG10 = float(np.log(10))

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def rare_group(word: bytes) -> int:
    return crc32(word[-2:]) % RARE


def rare_ids() -> np.ndarray:
    """The model ids of rare words by their last two bytes; a space stands before a single one."""
    pairs = [bytes([b]) if a == ord(" ") else bytes([a, b]) for a in range(256) for b in range(256)]
    return np.array([VOCABULARY - RARE + rare_group(p) for p in pairs], np.int32).reshape(256, 256)


@dataclass
class Corpus:
    """Counts of the training documents: all of them as a table, the bounded parts by value."""

    counts: DataFrame  # (word, n), end mark left out
    tokens: int  # all tokens, ends included
    types: int  # different tokens, the end included
    ends: int
    known: list[tuple[bytes, int]]  # the most frequent words, KNOWN of them at most, with their counts
    groups: np.ndarray  # (RARE, 2): tokens and types of each rare group

    @property
    def base_total(self) -> int:
        return self.tokens + self.types + 1


def training_documents(docs: DataFrame, key: str) -> DataFrame:
    modulus, out = HELD_OUT
    return docs.where(remainder(key, modulus) != out)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over whole texts: partial counts in the tasks, one shuffle of different words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) >= FLUSH:
                    yield flushed()
                    held = Counter()
        if held:
            yield flushed()

    partial = docs.select(F.col(text).alias("text")).mapInArrow(rows, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def gather(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Corpus:
    """Counts over all training documents."""
    training = training_documents(docs, key)
    counts = pinned(count_words(training, text))
    ends = training.count()
    tail = F.encode("word", "UTF-8")
    group = (F.crc32(F.substring(tail, -2, 2)) % RARE).alias("g")
    sums = counts.groupBy(group).agg(F.sum("n"), F.count(F.lit(1))).collect()  # RARE rows at most
    groups = np.zeros((RARE, 2))
    for g, n, kinds in sums:
        groups[g] = n, kinds
    tokens, types = int(groups[:, 0].sum()) + ends, int(groups[:, 1].sum()) + (ends > 0)
    known = _most_frequent(counts)
    for w, n in known[:WORDS]:
        groups[rare_group(w)] -= n, 1
    return Corpus(counts, tokens, types, ends, known, groups)


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most KNOWN words: all those above a count that leaves no more.

    The count comes from a histogram over steps of 2^(1/16), so that no task and
    not the driver holds more than the words that are kept.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted((tuple(r) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > KNOWN:
            break
        least = at
    found = counts.where(step >= least).collect() if least is not None else []
    return sorted(((w.encode(), n) for w, n in found), key=lambda x: (-x[1], x[0]))


class Reader:
    """Turns texts into model ids and count sums."""

    def __init__(self, corpus: Corpus):
        self.at = {w: i for i, (w, _) in enumerate(corpus.known)}
        self.logs = np.log10(np.array([n for _, n in corpus.known] + [0.0]) + 1)  # the last is for index -1
        self.totals = np.log10(corpus.groups.sum(axis=1) + 1)
        rare = [VOCABULARY - RARE + rare_group(w) for w, _ in corpus.known[WORDS:]]
        self.rare = rare_ids()
        self.model_ids = np.array([*range(1, 1 + min(WORDS, len(corpus.known))), *rare, 0], np.int32)

    def ids(self, words: list[bytes], index: np.ndarray) -> np.ndarray:
        """Model ids of the words and of the end mark."""
        found = np.append(self.model_ids[index], np.int32(0))
        unknown = np.nonzero(index < 0)[0]
        if len(unknown):
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)[unknown] - 1
            text = np.frombuffer(b" " + b" ".join(words), np.uint8)  # a word of one byte has a space before it
            found[unknown] = self.rare[text[ends - 1], text[ends]]
        return found

    def index(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))


def initial(corpus: Corpus, seed: int = 5) -> Params:
    """Small random weights, with output biases that give the counts' shares."""
    rng = np.random.default_rng(seed)
    f32, h = np.float32, HIDDEN
    share = np.full(VOCABULARY, 0.5)
    share[0] += corpus.ends
    for i, (_, n) in enumerate(corpus.known[:WORDS]):
        share[1 + i] += n
    share[VOCABULARY - RARE :] += corpus.groups[:, 0]
    order = np.argsort(-share, kind="stable")
    slot = np.empty(VOCABULARY, np.int64)
    slot[order] = np.arange(VOCABULARY)
    by_class = share[order].reshape(CLASSES, MEMBERS)
    return {
        "slot": slot,
        "input": rng.normal(0, 0.3, (VOCABULARY, 3 * h)).astype(f32),
        "state": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f32),
        "class": rng.normal(0, 0.05, (h, CLASSES)).astype(f32),
        "class_bias": np.log(by_class.sum(axis=1) / share.sum()).astype(f32),
        "member": rng.normal(0, 0.05, (CLASSES, h, MEMBERS)).astype(f32),
        "member_bias": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(f32),
    }


def _parts(a: np.ndarray) -> np.ndarray:
    """The columns of the update gate, the reset gate and the new value apart, so that each is one block of memory."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).transpose(1, 0, 2))


def _step(state: np.ndarray, h: np.ndarray, x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The states after inputs ``x``; ``room`` takes both gates, what the state gives to the new value, and that."""
    g, new = np.matmul(h, state, out=room[:3]), room[3]
    gates = g[:2]
    gates += x[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], g[2], out=new)
    new += x[2]
    np.tanh(new, out=new)
    after = h - new
    after *= gates[0]
    after += new
    return after


def _advance(p: Params, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after these ids, and what ``_step`` keeps."""
    room = np.empty((4, *h.shape), h.dtype)
    return _step(_parts(p["state"]), h, _parts(p["input"].take(ids, 0)), room), room


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums; states lie within 1, so logits stay far below the cut."""
    e = np.exp(np.minimum(logits, 80, out=logits))
    return e, e @ np.ones(e.shape[1], e.dtype)


def _outputs(p: Params, states: np.ndarray, targets: np.ndarray, grads: Params | None = None):
    """Natural log-probabilities of the targets; with ``grads``, also the gradient that reaches the states."""
    slot = p["slot"][targets]
    order = np.argsort((slot // MEMBERS).astype(np.uint8), kind="stable")
    slot, s = slot[order], states[order]
    cls, member = slot // MEMBERS, slot % MEMBERS
    every = np.arange(len(targets))
    logits = s @ p["class"] + p["class_bias"]
    prob, total = _exponents(logits)
    logp = logits[every, cls] - np.log(total)
    back = None
    if grads is not None:
        prob /= total[:, None]
        prob[every, cls] -= 1
        grads["class"] += s.T @ prob
        grads["class_bias"] += np.ones(len(prob), prob.dtype) @ prob
        back = prob @ p["class"].T
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in np.nonzero(np.diff(bounds))[0]:
        rows = slice(bounds[c], bounds[c + 1])
        logits = s[rows] @ p["member"][c]
        logits += p["member_bias"][c]
        prob, total = _exponents(logits)
        own, inner = every[: len(logits)], member[rows]
        logp[rows] += logits[own, inner] - np.log(total)
        if grads is not None:
            prob /= total[:, None]
            prob[own, inner] -= 1
            grads["member"][c] += s[rows].T @ prob
            grads["member_bias"][c] += np.ones(len(prob), prob.dtype) @ prob
            back[rows] += prob @ p["member"][c].T
    place = np.empty_like(order)
    place[order] = every
    return logp[place], None if back is None else back[place]


def _window(docs: list[np.ndarray], lens: np.ndarray, start: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, lanes) ids of the documents that reach beyond ``start``, and how many of them reach each step."""
    lanes = int((lens > start).sum())
    ids = np.zeros((steps, lanes), np.int32)
    for i in range(lanes):
        part = docs[i][start : start + steps]
        ids[: len(part), i] = part
    return ids, (lens[None, :lanes] > start + np.arange(steps)[:, None]).sum(axis=1)


def log_likelihoods(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each id sequence as a whole."""
    found = np.zeros(len(docs))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    table, state = _parts(p["input"]), _parts(p["state"])
    for at in range(0, len(order), LANES):
        group = order[at : at + LANES]
        own = [docs[i] for i in group]
        lens = np.array([len(d) for d in own])
        h, every = np.zeros((len(own), HIDDEN), np.float32), np.arange(len(own))
        room = np.empty((4, *h.shape), h.dtype)
        for start in range(0, int(lens[0]), WINDOW):
            ids, active = _window(own, lens, start, WINDOW)
            states, targets, lanes = [], [], []
            for t in range(WINDOW):
                n = active[t]
                if n == 0:
                    break
                states.append(h[:n].copy())
                targets.append(ids[t, :n])
                lanes.append(every[:n])
                h[:n] = _step(state, h[:n], table.take(ids[t, :n], 1), room[:, :n])
            logp, _ = _outputs(p, np.concatenate(states), np.concatenate(targets))
            found[group] += np.bincount(np.concatenate(lanes), logp, len(own))
    return found / LOG10


def learn(p: Params, docs: list[np.ndarray], adam: Adam) -> int:
    """One pass of truncated backpropagation over id sequences; gives the number of tokens."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    groups = [order[at : at + TRAIN_LANES] for at in range(0, len(order), TRAIN_LANES)]
    total = 0
    for k in np.random.default_rng(len(docs)).permutation(len(groups)):
        own = [docs[i] for i in groups[k]]
        lens = np.array([len(d) for d in own])
        h = np.zeros((len(own), HIDDEN), np.float32)
        for start in range(0, int(lens[0]), STEPS):
            ids, active = _window(own, lens, start, STEPS)
            total += int(active.sum())
            h = _learn_window(p, h[: ids.shape[1]], ids, active, adam)
    return total


def _learn_window(p: Params, h: np.ndarray, ids: np.ndarray, active: np.ndarray, adam: Adam) -> np.ndarray:
    grads = {k: np.zeros_like(v) for k, v in adam.params.items()}
    steps, n = int((active > 0).sum()), HIDDEN
    targets = np.concatenate([ids[t, : active[t]] for t in range(steps)])
    ends = np.concatenate(([0], np.cumsum(active[:steps])))
    spans = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    x, state, h = _parts(p["input"]).take(targets, 1), _parts(p["state"]), h.copy()
    states, room = np.empty((len(targets), n), h.dtype), np.empty((4, len(targets), n), h.dtype)
    for at in spans:
        own = h[: at.stop - at.start]
        states[at] = own
        own[:] = _step(state, own, x[:, at], room[:, at])
    _, back = _outputs(p, states, targets, grads)
    z, r, mixed, new = room
    # What a state's gradient is multiplied with on its way to the gates, for all steps at once.
    ways = np.empty((3, len(targets), n), h.dtype)
    np.multiply((states - new) * z, 1 - z, out=ways[0])
    np.multiply(1 - z, 1 - new * new, out=ways[2])
    np.multiply(ways[2] * mixed, r * (1 - r), out=ways[1])
    inner = ways.copy()  # the same on its way to the state's own products
    inner[2] *= r
    gate, dh, turned = np.empty_like(ways), np.zeros_like(h), np.ascontiguousarray(state.transpose(0, 2, 1))
    whole = np.empty_like(states)
    for at in reversed(spans):
        d = dh[: at.stop - at.start]
        whole[at] = d
        np.multiply(inner[:, at], d, out=gate[:, at])
        d *= z[at]
        for k in range(3):
            d += gate[k, at] @ turned[k]
        d += back[at]
    grads["state"] += np.matmul(states.T, gate).transpose(1, 0, 2).reshape(n, 3 * n)
    ways *= whole
    order = np.argsort(targets.astype(np.uint16), kind="stable")
    met, first = np.unique(targets[order], return_index=True)
    sums = np.add.reduceat(ways.take(order, 1), first, axis=1)
    grads["input"][met] = sums.transpose(1, 0, 2).reshape(len(met), 3 * n)
    scale = 1 / len(targets)
    for g in grads.values():
        g *= scale
    np.clip(grads["state"], -0.1, 0.1, out=grads["state"])
    adam.step(grads)
    return h


def train(docs: DataFrame, corpus: Corpus, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Params:
    """Weights learned from the training documents.

    Output biases and the split into classes come from the counts of all of
    them. The weights take one pass over all of them, dealt to ``rounds`` shares
    by a hash of the key. In each round every task trains on its documents of that round, starting from the same
    weights; then the tasks' weights are averaged by tokens, FAN_IN
    at a time, so that neither a task nor the driver holds more than that many.
    A task that is lost trains again from the same start to the same result.
    """
    model = initial(corpus)
    training = training_documents(docs, key)
    share = F.pmod(F.xxhash64(F.lit("round"), F.col(key)), F.lit(rounds))
    for k in range(rounds):
        start, rate = model, RATE / (1 + k)

        def local(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            reader, total = Reader(lean), 0
            p = {name: v.copy() for name, v in start.items()}
            adam = Adam({name: v for name, v in p.items() if name != "slot"}, rate)
            for batch in batches:
                found = []
                for t in batch.column(0):
                    words = words_of(t.as_py())
                    found.append(reader.ids(words, reader.index(words)))
                total += learn(p, found, adam)
            if total:
                yield _as_batch(TaskContext.get().partitionId(), total, p)

        lean = Corpus(None, corpus.tokens, corpus.types, corpus.ends, corpus.known[:WORDS], corpus.groups)
        part = training.where(share == k).select(F.col(text).alias("text"))
        tasks = part.rdd.getNumPartitions()
        trained = part.mapInArrow(local, MODEL)
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            trained = trained.repartition(tasks, F.pmod("slot", F.lit(tasks))).mapInArrow(_averaged, MODEL)
        found = [(r["tokens"], pickle.loads(r["model"])) for r in trained.collect()]
        model = average(found) if found else model
    return model


MODEL = "slot int, tokens bigint, model binary"


def _as_batch(slot: int, tokens: int, p: Params) -> pa.RecordBatch:
    columns = [pa.array([slot], pa.int32()), pa.array([tokens], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slot", "tokens", "model"])


def average(models: list[tuple[int, Params]]) -> Params:
    total = sum(n for n, _ in models)
    first = models[0][1]
    summed = {k: sum(p[k].astype(np.float64) * (n / total) for n, p in models) for k in first if k != "slot"}
    return {"slot": first["slot"]} | {k: v.astype(np.float32) for k, v in summed.items()}


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, sums, slot = 0, None, None
    for batch in batches:
        for n, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            p = pickle.loads(blob.as_py())
            slot = p["slot"]
            weighed = {k: v.astype(np.float64) * n for k, v in p.items() if k != "slot"}
            sums = weighed if sums is None else {k: sums[k] + v for k, v in weighed.items()}
            total += n
    if total:
        mean = {"slot": slot} | {k: (v / total).astype(np.float32) for k, v in sums.items()}
        yield _as_batch(TaskContext.get().partitionId(), total, mean)


SCORED = (
    "key {kind}, n_tokens bigint, n_known bigint, known_log double, model_log double, rare_log double, "
    "rare_total double, words array<string>, times array<int>"
)


def score(docs: DataFrame, corpus: Corpus, model: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row, over its whole text.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of
    the model. A NULL or empty text is one end mark. Repeated rows repeat, NULL
    keys stay, an empty table gives no row. Other columns are not read.

    Counts of the most frequent words, KNOWN of them at most, are looked up in the task; all other
    words of a document leave it with their numbers, meet their counts in a
    join and come back as sums.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lean = Corpus(None, corpus.tokens, corpus.types, corpus.ends, corpus.known, corpus.groups)
    end_known = int(corpus.ends > 0)
    end_log = float(np.log10(corpus.ends + 1))
    schema = SCORED.format(kind=narrow.schema["key"].dataType.simpleString())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lean)
        for batch in batches:
            ids, columns = [], [[] for _ in range(7)]
            for t in batch.column(1):
                words = words_of(t.as_py())
                index = reader.index(words)
                found = reader.ids(words, index)
                ids.append(found)
                groups = found[:-1][found[:-1] >= VOCABULARY - RARE] - (VOCABULARY - RARE)
                unknown = Counter(words[i] for i in np.nonzero(index < 0)[0].tolist())
                values = (
                    len(words) + 1,
                    int((index >= 0).sum()) + end_known,
                    float(reader.logs[index].sum()) + end_log,
                    float(reader.logs[index[index >= WORDS]].sum()),
                    float(reader.totals[groups].sum()),
                    [w.decode() for w in unknown],
                    list(unknown.values()),
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            n_tokens, n_known, known_log, rare_log, rare_total, unknown, times = columns
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(known_log, pa.float64()),
                    pa.array(log_likelihoods(model, ids), pa.float64()), pa.array(rare_log, pa.float64()),
                    pa.array(rare_total, pa.float64()), pa.array(unknown, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32())),
                ],
                NAMES,
            )

    read = pinned(narrow.mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id()))
    apart = read.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    apart = apart.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    sums = (
        apart.join(corpus.counts, "word")  # a word without a count adds log10(1), nothing
        .groupBy("row")
        .agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("far_log"), F.sum("k").alias("far_known"))
    )
    far = F.coalesce("far_log", F.lit(0.0))
    base = F.col("known_log") + far - F.col("n_tokens") * F.lit(float(np.log10(corpus.base_total)))
    full = F.col("model_log") + F.col("rare_log") + far - F.col("rare_total")
    return read.drop("words", "times").join(sums, "row", "left").select(
        "key",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        full.alias("score"),
    )


NAMES = ["key", "n_tokens", "n_known", "known_log", "model_log", "rare_log", "rare_total", "words", "times"]
