"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has one or more 64-bit words; bit i of a word is the majority of
bit i over the hashes of all word shingles. For a radius r the bits of a word
are dealt over the 2^(r+1) - 1 non-zero vectors of r + 1 bits, and each such
vector v gives a mask that keeps the bits whose vector has an odd product with
v. Any r bits leave at least one v that is orthogonal to all of them, so two
words that differ in at most r bits agree under some mask: every pair within
the radius meets in some table. With several words, a pair with fewer than
words * (r + 1) different bits has a word within the radius.

``similar_documents`` does not leave links to the bits: pairs count by the Jaccard
similarity of their sets of distinct shingles. Covering masks bring near copies
together, which fold into classes. What they leave apart is completed exactly.
In one order of all shingles, two sets with a similarity of t share one of the
first n - ceil(t n) + 1 shingles of each, n being its size; so each text also
meets others in the buckets of these. Shingles that are frequent in a sample of
texts come last in the order, so that few buckets are large.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import category
from concord.llm.graph import components
from concord.session import pinned

HASH_SEED = 42  # fixed value
BITS = 64
BLOCK = 1 << 16  # shingles hashed at once, whatever the length of a text
ROWS_PER_TASK = 2_000_000  # (bucket, node) rows that one task makes
SMALL_BUCKET = 32  # up to so many members of a bucket are compared with each other; others go by exact flips
SAMPLED_TEXTS = 5_000  # texts that show which shingles are frequent; this orders shingles and decides nothing else
FREQUENT = 8  # of the sampled texts that hold a shingle for it to count as frequent
BUCKET_BITS = 40  # of a hash that name a bucket; hashes that share them meet and are told apart when they are compared
SPREAD_LONGS = 8  # of 64 bits, by hash, of which a set marks those that one of its shingles falls on
PARITY_LONGS = 16, 64  # of 64 bits, by hash, each of which tells whether an odd number of a set's shingles falls on it: least, most
BINS = 512  # counts of a set's shingles by hash, which bound what two sets can share
EARLIER = 4  # of a member's buckets before each that it names there, so that a pair is made in one of the buckets it shares
COMPARED_BLOCK = 4096  # members of a bucket that meet as many others in one tile
TILE_ROWS = 100_000  # members of tiles that one task compares
TILE_PAIRS = 50_000_000  # pairs in them
PAIRS = 1 << 18  # compared at once


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def masks(radius: int) -> list[int]:
    """The masks of one word, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    dealt = [1 + (i % vectors) for i in range(BITS)]
    return [signed(sum(1 << i for i, d in enumerate(dealt) if (d & v).bit_count() & 1)) for v in range(1, vectors + 1)]


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes of another family, derived from those of the first."""
    if word == 0:
        return h
    x = h ^ np.uint64((word * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shingles(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of ``width`` words, in blocks; nothing for a text without words.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer
    words than ``width`` is one shingle.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(tokens))
    starts, ends = starts[: len(tokens) - span + 1], ends[span - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        s, e = starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist()
        yield np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(s, e, strict=True)], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, width)]))


def _majority(blocks: Iterable[np.ndarray], words: int) -> list[int]:
    ones, n = np.zeros((words, BITS), np.int64), 0
    for h in blocks:
        n += len(h)
        for w in range(words):
            bytes_ = _mixed(h, w).view(np.uint8).reshape(-1, 8)
            ones[w] += np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, axis=1, bitorder="little")
    return [int(x) for x in bits.view(np.int64).ravel()]


def fingerprint(text: str | None, width: int, words: int = 1) -> list[int]:
    """Majority bits over all shingles of ``width`` words; a text without words has all bits zero.

    Repeated shingles count each time.
    """
    return _majority(_shingles(text, width), words)


def fingerprints(docs: DataFrame, key: str, text: str, width: int, words: int = 1) -> DataFrame:
    """(key, text_hash, fp, node) for each row; ``fp`` is an array of ``words`` longs, the node its first word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width, words) for t in batch.column(2)]
            nodes = [fp[0] for fp in found]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "fp", "node"])

    narrow = docs.select(F.col(key).alias("key"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(rows, f"key {kind}, text_hash bigint, fp array<bigint>, node bigint")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _tables(distinct: DataFrame, words: int, radius: int) -> DataFrame:
    """(bucket, node): one row for each fingerprint and mask."""
    spots = [
        F.xxhash64(F.lit(w * 1000 + i), F.col("fp")[w].bitwiseAND(F.lit(m)))
        for w in range(words)
        for i, m in enumerate(masks(radius))
    ]
    conf = distinct.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), distinct.count() * len(spots) // ROWS_PER_TASK)
    # Each row becomes many, so that partitions sized for the rows that come in would be far too few.
    return distinct.repartition(tasks, "node").select("node", F.explode(F.array(*spots)).alias("bucket"))


def _pairs_in_small(members: DataFrame) -> DataFrame:
    """All pairs within buckets of few members."""
    grouped = members.groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    pairs = F.flatten(
        F.transform(
            "nodes",
            lambda x, i: F.transform(
                F.slice(F.col("nodes"), i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    return grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _flips(members: DataFrame) -> DataFrame:
    """Pairs up to two bits apart in large buckets, tied to the least of those around a common middle.

    Two fingerprints differ in at most two bits exactly if both are within one
    bit of some middle; each member names its 65 middles, and all members of a
    middle, which are within two bits of each other, are tied to the least.
    """
    middle = F.explode(F.array(F.col("node"), *[F.col("node").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)]))
    spread = members.select("node").distinct().select("node", middle.alias("middle"))
    least = spread.groupBy("middle").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread.join(least, "middle").select("a", F.col("node").alias("b"))


def _frequent(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Hashes of the shingles that many of a bounded sample of texts hold, in order.

    The sample takes different texts by their hash. As each frequent shingle
    takes its share of the sample's shingles, their number is bounded too.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], ["shingle"])

    told = docs.select(F.col(text).alias("text"), _text_hash(text).alias("text_hash"))
    part = max(1, told.count() // SAMPLED_TEXTS)
    sample = told.where(F.pmod("text_hash", F.lit(part)) == 0).dropDuplicates(["text_hash"]).limit(2 * SAMPLED_TEXTS)
    counts = sample.select("text").mapInArrow(rows, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = [r.shingle for r in counts.where(F.col("n") >= FREQUENT).select("shingle").collect()]
    return np.sort(np.array(found, np.int64)).view(np.uint64) if found else np.zeros(0, np.uint64)


def prefix_length(size: int, similarity: float) -> int:
    """How many first shingles of a set are enough to meet every set that is so similar."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order: rare before frequent, then by hash."""
    own = np.sort(shingles)
    known = np.sort(frequent)
    at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
    late = known[at] == own if len(known) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: prefix_length(len(own), similarity)]


def bins(shingles: np.ndarray) -> bytes:
    """How many shingles each bin has, in a byte each; a set that is too large for that has none."""
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % BINS, minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def spread(shingles: np.ndarray) -> np.ndarray:
    """The bits that a set's shingles fall on."""
    marked = np.zeros(SPREAD_LONGS * BITS, bool)
    marked[(shingles >> np.uint64(7)).astype(np.int64) % len(marked)] = True
    return np.packbits(marked, bitorder="little").view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The bits that an odd number of a set's shingles falls on.

    Where two sets differ in a bit, at least one shingle is in only one of them.
    What they share falls out, so that large sets with small differences are
    told apart as well as small ones. There are half as many bits as shingles or
    more, up to a bound; of sets with different numbers of bits, the halves of the
    longer ones fold by exclusive or.
    """
    least, most = PARITY_LONGS
    bits = BITS * min(most, max(least, 1 << (len(shingles) // 2 // BITS).bit_length()))
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def _set_prints(docs: DataFrame, key: str, text: str, width: int, similarity: float, frequent) -> DataFrame:
    """(key, text_hash, fp, node, size, prefix, bins, spread, parity) for each row; the node is a hash of the set of distinct shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, nodes, sizes, firsts, counts, marks, odd = [], [], [], [], [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), width)
                found.append(_majority((own[at : at + BLOCK] for at in range(0, len(own), BLOCK)), 1))
                nodes.append(signed(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED)))
                sizes.append(len(own))
                counts.append(bins(own))
                marks.append(spread(own).tobytes())
                odd.append(parity(own).tobytes())
                firsts.append((prefix(own, frequent.value, similarity) >> np.uint64(BITS - BUCKET_BITS)).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(nodes, pa.int64())]
            columns += [pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            columns += [pa.array(marks, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "fp", "node", "size", "prefix", "bins", "spread", "parity"])

    narrow = docs.select(F.col(key).alias("key"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(rows, f"key {kind}, text_hash bigint, fp array<bigint>, node bigint, size bigint, prefix array<bigint>, bins binary, spread binary, parity binary")


def _met(nodes: DataFrame, radius: int) -> DataFrame:
    """(bucket, node, size, members, times) of the buckets of masks and of first shingles that several nodes share.

    Copies share very many buckets; of those with equal members one stands for
    all, and ``times`` says for how many. Members are equal if their number and
    two sums without carry of their hashes are.
    """
    hashed = [F.xxhash64(F.lit(i), F.col("fp")[0].bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))]
    spots = F.array(*[F.shiftrightunsigned(h, BITS - BUCKET_BITS) for h in hashed])
    conf = nodes.sparkSession.conf
    made = nodes.agg(F.sum(F.size("prefix") + len(hashed))).first()[0] or 0
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), made // ROWS_PER_TASK)
    # Each row becomes many, so that partitions sized for the rows that come in would be far too few.
    tables = nodes.repartition(tasks, "node").select("node", F.explode(F.array_distinct(F.concat(spots, "prefix"))).alias("bucket"))
    marks = [F.bit_xor("node").alias("mark"), F.bit_xor(F.xxhash64("node")).alias("other_mark")]
    sizes = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *marks).where("members > 1")
    alike = sizes.groupBy("members", "mark", "other_mark").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    met = tables.join(alike.select("bucket", "members", "times"), "bucket")
    return met.join(nodes.select("node", "size"), "node")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sized(n: Column, m: Column, least: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(n, m) >= least * F.greatest(n, m)


def _folding(met: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that fold buckets: each member with the one that meets most others in all its buckets.

    In a group of copies that is the text they are copies of, as its shingles
    are in more of them than any edited one's. The pairs only save comparisons,
    but for buckets of two, of which they are all; ``_across`` finds what they
    leave apart.
    """
    meetings = met.groupBy("node").agg(F.sum(F.col("members") * F.col("times")).alias("meetings"))
    told = met.select("bucket", "node", "size").join(meetings, "node")
    hubs = told.groupBy("bucket").agg(F.max(F.struct("meetings", "node", "size")).alias("hub"))
    pairs = told.join(hubs, "bucket").where((F.col("node") != F.col("hub.node")) & _sized(F.col("size"), F.col("hub.size"), least))
    return pairs.select(*_ordered(F.col("hub.node"), F.col("node"))).distinct()


def _across(met: DataFrame, roots: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) in one bucket but in different classes.

    Of two classes one is not the largest of its bucket, so only members outside
    the largest are compared with the others; a bucket in one class drops out.
    The members of a large bucket are dealt to blocks, those of the largest class
    apart from the others, and two blocks meet in a tile. Tasks compare the
    members of a tile as arrays.

    Copies share most of their buckets. A pair of two classes meets in every
    open bucket that it shares, so it is passed over where the EARLIER buckets
    that both name have one in common: the first that it shares never has.
    """
    known = met.where("members > 2").select("bucket", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sums.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(COMPARED_BLOCK))
    dealt = largest.where("classes > 1").select(
        "bucket", "all", F.col("top.root").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("mains")
    )
    open_ = known.join(dealt, "bucket").withColumn("main", F.col("root") == F.col("top")).drop("top")
    before = Window.partitionBy("node").orderBy("bucket")
    for i in range(EARLIER):
        open_ = open_.withColumn(f"earlier{i}", F.coalesce(F.lag("bucket", i + 1).over(before), F.lit(-1)))
    open_ = pinned(open_.join(nodes.select("node", "parity"), "node"))

    hashed, whole = F.xxhash64("node"), F.col("all") <= COMPARED_BLOCK
    # Blocks of others come first. A small bucket is one tile, in which its largest class is a block that meets no other.
    own = F.when(F.col("main"), F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others")))
    last = F.when(whole, F.lit(0)).when(F.col("main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    met_by = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    rows = open_.withColumn("own", own).withColumn("with", met_by)
    tile = [F.when(whole, F.lit(0).cast("bigint")).otherwise(f("own", "with")).alias(c) for f, c in ((F.least, "low"), (F.greatest, "high"))]
    rows = rows.select("bucket", *tile, "own", "node", "size", "root", *[f"earlier{i}" for i in range(EARLIER)], "parity")

    tiles = F.when(whole, 1).when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    made = open_.agg(F.sum(tiles), F.sum(F.when(~F.col("main"), F.col("all")))).first()
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, (made[0] or 0) // TILE_ROWS, (made[1] or 0) // TILE_PAIRS)
    spots = ["bucket", "low", "high"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the tile that may go on in the next batch
        for batch in batches:
            found = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch])
            if not len(found):
                continue
            changes = np.flatnonzero(_changes(*[found[c].to_numpy() for c in spots]))
            begun = int(changes[-1]) + 1 if len(changes) else 0
            held = found.slice(begun)
            yield from told(found.slice(0, begun))
        if held is not None:
            yield from told(held)

    def told(found: pa.Table) -> Iterator[pa.RecordBatch]:
        for x, y in _close(found, least):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return rows.repartition(tasks, *spots).sortWithinPartitions(*spots, "own").mapInArrow(pairs, "a bigint, b bigint").distinct()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """For each row but the last, whether the next one differs."""
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def _close(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of two classes in a tile that can be so similar, by their sizes and parities.

    ``rows`` are those of whole tiles, in order of tile and block. Every bit in
    which the parities of two sets differ has a shingle that only one of them has,
    so that no similar pair is lost: they share half of what is left of both sizes
    without these.
    """
    if not len(rows):
        return
    bucket, low, high, own, node, size, root = (rows[i].to_numpy() for i in range(7))
    earlier = [rows[7 + i].to_numpy() for i in range(EARLIER)]
    parities = _folds(rows["parity"])
    new = np.concatenate(([True], _changes(bucket, low, high)))
    starts, number = np.flatnonzero(new), np.cumsum(new) - 1
    left = own == low
    ends = np.append(starts[1:], len(own))[number]
    second = (starts + np.add.reduceat(left.astype(np.int64), starts))[number]
    first = np.where(low == high, np.arange(len(own)) + 1, second)
    counts = np.where(left, ends - first, 0)
    upto = np.cumsum(counts)
    begun = 0
    while begun < len(counts):
        done = upto[begun] - counts[begun]
        stop = max(begun + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        some = slice(begun, stop)
        x = np.repeat(np.arange(begun, stop), counts[some])
        y = np.arange(len(x)) + np.repeat(first[some] - upto[some] + counts[some] + done, counts[some])
        begun = stop
        n, m = size[x], size[y]
        kept = np.flatnonzero((np.minimum(n, m) >= least * np.maximum(n, m)) & (root[x] != root[y]))
        x, y = x[kept], y[kept]
        kept = np.flatnonzero(_apart(parities, x, y) <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-6)
        x, y = x[kept], y[kept]
        again = np.zeros(len(x), bool)
        for p in earlier:
            for q in earlier:
                again |= (p[x] == q[y]) & (p[x] >= 0)
        if not again.all():
            yield node[x[~again]], node[y[~again]]


def _folds(parities: pa.ChunkedArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(longs, place, parities) from the longest down: those of all sets that have so many or more, folded, and where each set's are."""
    texts = parities.to_pylist()
    longs = np.array([len(t) // 8 for t in texts])
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    width, (least, _) = max(longs), PARITY_LONGS
    held, whose = np.zeros((0, width), np.uint64), np.zeros(0, np.int64)
    while width >= least:
        own = np.flatnonzero(longs == width)
        fresh = np.frombuffer(b"".join(texts[i] for i in own), np.uint64).reshape(-1, width)
        held, whose = np.concatenate([held, fresh]), np.concatenate([whose, own])
        place = np.full(len(texts), -1)
        place[whose] = np.arange(len(whose))
        found.append((width, place, held))
        width //= 2
        held = held[:, :width] ^ held[:, width:]
    return found


def _apart(parities: list[tuple[int, np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the parities of each pair differ, at the most bits that both have."""
    apart = np.full(len(x), -1)
    for width, place, held in parities:
        some = np.flatnonzero((apart < 0) & (place[x] >= 0) & (place[y] >= 0))
        step = max(1, (1 << 20) // width)
        for at in range(0, len(some), step):
            these = some[at : at + step]
            apart[these] = np.bitwise_count(held[place[x[these]]] ^ held[place[y[these]]]).sum(axis=1, dtype=np.int64)
    return apart


def _plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose marked bits and bins leave room for the similarity.

    Every bit that one set falls on and the other does not has a shingle that
    they do not share, and two sets share at most the lesser count of each bin,
    so that no similar pair is lost; most others need not be looked at whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            wanted = least / (1 + least) * (n + m) - 1e-6
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SPREAD_LONGS) for i in (4, 5))
            alone = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
            keep = np.minimum(n - alone[0], m - alone[1]) >= wanted
            x, y = (batch.column(i).to_pylist() for i in (6, 7))
            both = [i for i in np.flatnonzero(keep) if x[i] and y[i]]
            p, q = (np.frombuffer(b"".join(v[i] for i in both), np.uint8).reshape(-1, BINS) for v in (x, y))
            keep[both] = np.minimum(p, q).sum(axis=1, dtype=np.int64) >= wanted[both]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    told = ("size", "spread", "bins")
    x, y = (nodes.select(F.col("node").alias(c), *[F.col(t).alias(f"{c}_{t}") for t in told]) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").where(_sized(F.col("a_size"), F.col("b_size"), least))
    return both.select("a", "b", *[f"{c}_{t}" for t in told for c in "ab"]).mapInArrow(rows, "a bigint, b bigint")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # Sets of too different sizes are told apart by their counts alone.
    n, m = F.size("x"), F.size("y")
    both = pairs.join(x, "a").join(y, "b").where(_sized(n, m, least))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (n + m - common) - 1e-9).select("a", "b")


def link_similar(nodes: DataFrame, sets_of, radius: int, least: float) -> DataFrame:
    """(node, root): the classes that all pairs with a Jaccard similarity of ``least`` connect, but for lone nodes.

    ``nodes`` has (node, fp, size, prefix, bins, spread, parity), and ``sets_of`` gives (node,
    shingles) for a table of nodes. No pair is left out: every similar pair
    shares a bucket, and buckets of any size are compared whole, but for pairs
    whose classes links already connect. A large group of copies folds into one
    class first, so that its pairs grow in proportion to it.
    """
    met = pinned(_met(nodes, radius))
    tried = pinned(_folding(met, least))
    links = _verified(tried, nodes, sets_of, least)
    roots = components(links)
    rest = pinned(_across(met, roots, nodes, least).join(tried, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    return components(links.union(_verified(rest, nodes, sets_of, least)))


def _verified(pairs: DataFrame, nodes: DataFrame, sets_of, least: float) -> DataFrame:
    """The similar ones among pairs (a, b)."""
    pairs = pinned(_plausible(pairs, nodes, least))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return pinned(_similar(pairs, sets_of(wanted), least))  # both sides of a pair come out of one shuffle of the sets


def link(distinct: DataFrame, words: int, radius: int, max_bits: int) -> DataFrame:
    """(a, b): links between nodes of one word that connect exactly what all pairs within the radius connect.

    ``distinct`` has (node, fp), one row per fingerprint; the node is the word
    itself, and the radius and ``max_bits`` are two.
    """
    if not words == 1 or not radius == max_bits == 2:
        raise ValueError("bits alone link only single words within two bits")
    tables = _tables(distinct, words, radius)
    sizes = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pinned(tables.join(sizes, "bucket").select("bucket", "node", "n"))
    small = _pairs_in_small(shared.where(F.col("n") <= SMALL_BUCKET)).distinct()
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return small.where(close).union(_flips(shared.where(F.col("n") > SMALL_BUCKET)))


def _shingle_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the rows that ``wanted`` (node, key, text_hash) names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen:
                    seen.add(node)
                    own = pa.array([shingle_set(t.as_py(), width).view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), own], ["node", "shingles"])

    texts = docs.select(category(F.col(key)).alias("k"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    named = wanted.select("node", category(F.col("key")).alias("k"), "text_hash")
    found = texts.join(named, ["k", "text_hash"]).select("node", "text")
    return found.mapInArrow(rows, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _classes(found: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, text_hash, fp, root, component) for each row."""
    placed = distinct.select("node", "least").join(roots, "node", "left")
    placed = placed.select("node", "least", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(names, "root").select("node", "root", "component")
    return found.join(named, "node").select("key", "text_hash", "fp", "root", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, words: int = 1, radius: int = 2, max_bits: int = 2) -> DataFrame:
    """(key, text_hash, fp, root, component) for each row: the class of each document, named by its least key.

    ``root`` tells classes apart even where none of their rows has a key. Equal
    fingerprints are one node, and the bits alone link. Texts without words share
    the zero fingerprint and are linked like any other. A NULL text counts as
    empty. NULL keys take part and are passed over when a class is named, so only
    a class without any key is NULL. Repeated rows each give a row; an empty
    table gives none. Other columns are not read.
    """
    found = pinned(fingerprints(docs, key, text, width, words))
    distinct = pinned(found.groupBy("node").agg(F.min("key").alias("least"), F.min("fp").alias("fp")))
    links = link(distinct.select("node", "fp"), words, radius, max_bits)
    return _classes(found, distinct, components(links))


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, radius: int = 2, similarity: float = 0.8
) -> DataFrame:
    """The same columns, with classes that link every pair of this Jaccard similarity of distinct shingles.

    Equal sets of shingles are one node; the fingerprint is over distinct
    shingles. All that ``near_duplicates`` says of odd rows holds here too; texts
    without words have equal, empty sets.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, text, width))  # bounded by the sample
    found = pinned(_set_prints(docs, key, text, width, similarity, frequent))
    first = F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("text_hash"))).alias("first")
    distinct = pinned(found.groupBy("node").agg(F.min("key").alias("least"), first))
    nodes = pinned(found.select("node", "fp", "size", "prefix", "bins", "spread", "parity").dropDuplicates(["node"]))
    found = found.select("key", "text_hash", "fp", "node")

    def sets_of(wanted: DataFrame) -> DataFrame:
        named = distinct.join(wanted, "node", "left_semi").select("node", "first.key", "first.text_hash")
        return _shingle_sets(docs, key, text, width, named)

    return _classes(found, distinct, link_similar(nodes, sets_of, radius, similarity))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of ``docs`` unchanged.

    The row with the least key stays (NULL keys last, then by a hash of the
    text); of rows that share key and text, the one whose other columns come
    first as JSON text.
    """
    found = similar_documents(docs, key, text, **options)
    first = F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("text_hash"))).alias("first")
    kept = found.groupBy("root").agg(first).select(category(F.col("first.key")).alias("__k"), F.col("first.text_hash").alias("__h"))
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in (key, text)], F.lit(0).alias("__")))
    marked = docs.select(
        *docs.columns,
        category(F.col(key)).alias("__k"),
        _text_hash(text).alias("__h"),
        others.alias("__others"),
    )
    copies = Window.partitionBy("__k", "__h").orderBy("__others")
    single = marked.join(kept, ["__k", "__h"], "left_semi").withColumn("__copy", F.row_number().over(copies))
    return single.where(F.col("__copy") == 1).select(*docs.columns)
