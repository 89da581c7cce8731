"""Document fingerprints from closed syncmers.

A run of K characters is a closed syncmer if the least hash among its inner
runs of S characters lies at its first or last place. Whether it is one depends
on these K characters alone, so an unchanged passage gives the same anchors in
any document, and a stretch of K - S + 1 places always holds at least one.
Anchors carry their positions, by which two documents are aligned.

A fingerprint keeps two sketches of every text, each the smallest hashes of its
anchors: one of runs of K, and one of runs of SHORT_K, which texts of a few
characters have as well. Two texts are always compared by sketches of the same
kind: by the second one if either is shorter than SHORT_TEXT, else by the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 14, 5
SHORT_K, SHORT_S = 3, 2  # with two marks ahead of the text, so that a text has as many runs as characters
SHORT_TEXT = 3 * K
SKETCH = 128  # anchor hashes in a fingerprint
BLOCK = 1 << 20  # characters hashed at once, whatever the length of a text
PART_BYTES = 64 << 20  # text that one task compares
CUT_ROWS = 50  # sampled rows for each cut between tasks

FIELDS = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_anchors bigint, edited_aligned bigint, next_aligned bigint, next_shift bigint"
)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _runs(x: np.ndarray, length: int) -> np.ndarray:
    """A polynomial over each run of ``length`` values, by doubling."""
    n = len(x) - length + 1
    total, at, power, done = None, x, _MULTIPLIER, 1
    rest, offset = length, 0
    while rest:
        if rest & 1:
            part = at[offset : offset + n]
            total = part.copy() if total is None else total * power + part
            offset += done
        rest >>= 1
        if rest:
            at = at[: len(at) - done] * power + at[done:]
            power = power * power
            done *= 2
    return total


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    done = 1
    at = x
    while done * 2 <= width:
        at = np.minimum(at[: len(at) - done], at[done:])
        done *= 2
    n = len(x) - width + 1
    return np.minimum(at[:n], at[width - done : width - done + n])


def _block_anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    values = codes.astype(np.uint64) + np.uint64(1)
    inner = _mix(_runs(values, s))
    least = _least(inner, k - s + 1)
    n = len(least)
    places = np.nonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))[0]
    first, last = inner[places], inner[places + k - s]
    middle = inner[places + (k - s) // 2]
    return places, _mix(first * _MULTIPLIER + _mix(middle * _MULTIPLIER + last)) >> np.uint64(32)


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in code points) and 32-bit hashes of all closed syncmers, in order; a text shorter than ``k`` has none."""
    return _anchors(_codes(text), k, s)


def _anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    with np.errstate(over="ignore"):
        for at in range(0, len(codes) - k + 1, BLOCK):
            places, hashes = _block_anchors(codes[at : at + BLOCK + k - 1], k, s)
            found.append((places + at, hashes))
    return np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])


def _sketch(found: np.ndarray, new: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest hashes of sorted anchors and their occurrence numbers, in order.

    An anchor that occurs n times counts n times, so repeated passages keep
    their weight.
    """
    if len(found) == 0:
        return found
    first = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    with np.errstate(over="ignore"):
        numbered = _mix(found * _MULTIPLIER + (np.arange(len(found)) - first).astype(np.uint64))
    return _smallest(numbered >> np.uint64(32), size)


def _new(ordered: np.ndarray) -> np.ndarray:
    """Marks the first of equal neighbours."""
    return np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest different values, in order."""
    few = 2 * size
    while True:
        some = np.sort(values if len(values) <= few else np.partition(values, few)[:few])
        found = some[_new(some)]
        if len(found) >= size or len(some) == len(values):
            return found[:size]
        few *= 8


def _short_sketch(codes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest hashes of different runs of SHORT_K, the first of which begin before the text.

    Both inner runs of such a run lie at an edge, so each of them is a closed
    syncmer. Hashes below a bound are looked at first, and all of them if these
    are too few.
    """
    if len(codes) == 0:
        return np.zeros(0, np.uint64)
    marked = np.concatenate((np.full(SHORT_K - 1, 0x110000, np.uint32), codes))
    low: list[np.ndarray] = []
    for at in range(0, len(codes), BLOCK):
        with np.errstate(over="ignore"):
            runs = _runs(marked[at : at + BLOCK + SHORT_K - 1].astype(np.uint64), SHORT_K)
            hashes = (_mix(runs) >> np.uint64(32)).astype(np.uint32)
        below = (1 << 32) * 8 * size // max(len(hashes), 8 * size)
        some = _smallest(hashes[hashes < below], size)
        low.append(some if len(some) >= size else _smallest(hashes, size))
    return low[0] if len(low) == 1 else _smallest(np.concatenate(low), size)


@dataclass(frozen=True)
class Fingerprint:
    """Both sketches of a text, with its different anchors in order and the first place of each."""

    length: int
    sketch: np.ndarray
    short: np.ndarray
    anchors: np.ndarray
    firsts: np.ndarray
    places: np.ndarray  # of all anchors, in the order of the text
    hashes: np.ndarray

    def __str__(self) -> str:
        return f"{as_text(self.sketch)}.{as_text(self.short)}"


def fingerprint(text: str | None, known: Fingerprint | None = None, kept: int = 0) -> Fingerprint:
    """The fingerprint of a whole text; NULL counts as empty, whose sketches are empty.

    If the first ``kept`` characters are those of a text with a ``known``
    fingerprint, the anchors inside them are taken over.
    """
    codes = _codes(text)
    start = max(0, kept - K + 1) if known else 0
    places, hashes = _anchors(codes[start:], K, S)
    places += start
    if start:
        taken = np.searchsorted(known.places, start)
        places, hashes = np.concatenate((known.places[:taken], places)), np.concatenate((known.hashes[:taken], hashes))
    order = np.argsort(hashes, kind="stable")
    found = hashes[order]
    new = _new(found)
    return Fingerprint(len(codes), _sketch(found, new), _short_sketch(codes), found[new], places[order][new], places, hashes)


def alike(a: Fingerprint, b: Fingerprint) -> float:
    """Likeness of two fingerprints by sketches of one kind: short runs if either text is short."""
    short = min(a.length, b.length) < SHORT_TEXT
    return likeness(a.short, b.short) if short else likeness(a.sketch, b.sketch)


def aligned(a: Fingerprint, b: Fingerprint) -> tuple[int, int | None]:
    """How many anchors two texts share at the commonest distance of their positions, and that distance.

    An anchor counts at its first place in each text. Of equally common
    distances the one nearest to zero counts, then the smaller. Without a
    common anchor: 0 and NULL.
    """
    if len(a.anchors) == 0 or len(b.anchors) == 0:
        return 0, None
    at = np.minimum(np.searchsorted(b.anchors, a.anchors), len(b.anchors) - 1)
    common = b.anchors[at] == a.anchors
    if not common.any():
        return 0, None
    shifts, counts = np.unique(b.firsts[at[common]] - a.firsts[common], return_counts=True)
    best = np.lexsort((shifts, np.abs(shifts), -counts))[0]
    return int(counts[best]), int(shifts[best])


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common anchors among all of both texts, from 0 to 1; two empty sketches are alike."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    first = np.nonzero(_new(both))[0][:size]
    counted = first[-1] + 1 + (first[-1] + 1 < len(both) and both[first[-1] + 1] == both[first[-1]])
    return float((counted - len(first)) / len(first))


def edited(text: str, next_: str) -> str:
    """The last quarter of the code points, rounded down, gives way to the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + next_[:n]


def positional_matches(left: DataFrame, right: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(left_key, right_key, shift, anchors): how many anchors two documents share at one distance of positions.

    An anchor that occurs several times in a document counts at its first
    place, so the rows of a pair stay bounded by its anchors. NULL and empty texts
    share nothing.
    """
    a, b = (_first_places(x, key, text) for x in (left, right))
    a = a.select(F.col("key").alias("left_key"), F.col("position").alias("here"), "anchor")
    b = b.select(F.col("key").alias("right_key"), F.col("position").alias("there"), "anchor")
    shift = (F.col("there") - F.col("here")).alias("shift")
    return a.join(b, "anchor").groupBy("left_key", "right_key", shift).agg(F.count(F.lit(1)).alias("anchors"))


def _first_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    return anchor_table(docs, key, text).groupBy("key", "anchor").agg(F.min("position").alias("position"))


def anchor_table(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(key, position, anchor): one row for each closed syncmer of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, hashes = anchors(batch.column(1)[i].as_py(), k, s)
                keys = batch.column(0).take(pa.array(np.full(len(places), i)))
                columns = [keys, pa.array(places), pa.array(hashes.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "position", "anchor"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(rows, f"key {kind}, position bigint, anchor bigint")


def _cuts(placed: DataFrame, parts: int | None) -> list[tuple]:
    """Places in the order of (key, hash) that cut the rows into parts of nearly equal counts.

    They come from a sample of CUT_ROWS rows for each part, chosen by a hash; only
    the work of tasks depends on them. Without ``parts`` there is one for
    each PART_BYTES of text, and at least as many as Spark shuffles into.
    """
    if parts is None:
        size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = F.xxhash64(F.lit(1), "key", "hash")
    rows = placed.select("key", "hash").distinct().orderBy(order, "key", "hash").limit(CUT_ROWS * parts)
    sample = [tuple(r) for r in rows.orderBy(F.col("key").asc_nulls_first(), "hash").collect()]
    return [sample[i] for i in sorted({len(sample) * i // parts for i in range(1, parts)} - {0}) if i < len(sample)]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Gives (key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_anchors, edited_aligned, next_aligned, next_shift):
    likeness from 0 to 1, and how many anchors lie at one common distance in
    both texts (in the edited text, in the next one, and that distance).
    Documents follow by ascending key of any type that Spark orders, NULL first, rows of one key
    in the order of a hash of their text, then the text; after the last comes the first, and a
    single document follows itself. NULL texts count as empty. Equal texts have
    equal fingerprints. An empty table gives no row; other columns are not read.

    Keys and hashes are cut into ranges of nearly equal counts, so that rows of one
    key, or without a key, spread over tasks; only rows with the same key and text
    stay together. Texts move once, to the task of their range, and the first of
    each range goes to the range before as well, so that every document meets the
    one that follows it.
    """
    spark = docs.sparkSession
    filled = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("key"), filled.alias("text"), F.xxhash64(filled).alias("hash"))
    kind = narrow.schema["key"].dataType.simpleString()
    cuts = _cuts(narrow, parts)
    parts = len(cuts) + 1
    place = F.struct("key", "hash")
    bounds = F.array(*[F.struct(F.lit(k).cast(kind).alias("key"), F.lit(h).cast("bigint").alias("hash")) for k, h in cuts])
    placed = narrow.withColumn("part", F.size(F.filter(bounds, lambda c: c <= place)) if cuts else F.lit(0))
    heads = placed.groupBy("part").agg(F.min(place).alias("first")).orderBy("part").collect()  # one row for each range
    firsts = [(*r["first"], heads[i - 1]["part"]) for i, r in enumerate(heads)]
    known = spark.createDataFrame(firsts, f"first_key {kind}, first_hash bigint, before int")
    at_head = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("hash") == F.col("first_hash"))
    ahead = placed.join(F.broadcast(known), at_head).groupBy("before").agg(F.min(F.struct("key", "hash", "text")).alias("x"))
    ahead = ahead.select("x.*", F.col("before").alias("part"), F.lit(True).alias("ahead"))
    rows = placed.withColumn("ahead", F.lit(False)).unionByName(ahead)
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.col("key").asc_nulls_first(), "hash", "text")
    ordered = ordered.select("key", "text", "ahead")
    names = ["key", *(f.split()[0] for f in FIELDS.split(", "))]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        out: list[list] = [[] for _ in names]
        held: list = ["", None]

        def marked(t: str) -> Fingerprint:
            if held[1] is None or held[0] != t:
                held[:] = [t, fingerprint(t)]
            return held[1]

        def read() -> Iterator[tuple]:
            nonlocal kinds
            for batch in batches:
                kinds = batch.column(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        def flushed() -> pa.RecordBatch:
            whole, real = pa.int64(), pa.float64()
            types = [kinds, whole, pa.string(), pa.string(), pa.string(), real, real, whole, whole, whole, whole]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        for (k, t, follows), (_, after, _) in pairwise(read()):
            if follows:
                continue
            own, changed = marked(t), edited(t, after)
            other = fingerprint(changed, own, len(t) - len(t) // 4)
            following = marked(after)
            values = (
                k, len(t), hashlib.sha256(changed.encode()).hexdigest(), str(own), str(other), alike(own, other),
                alike(own, following), len(own.hashes), aligned(own, other)[0], *aligned(own, following),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
            if len(out[0]) >= 1000:
                yield flushed()
                out = [[] for _ in names]
        if out[0]:
            yield flushed()

    return ordered.mapInArrow(compared, f"key {kind}, {FIELDS}")
