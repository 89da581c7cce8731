"""Collocations mined from Rabin-Karp fingerprints of every n-gram.

A block of texts is one run of bytes. Prefix sums of byte codes times powers of
an odd base, modulo 2^64, give the fingerprint of any word as a difference of
two of them, and prefix sums over the fingerprints of words give that of any
n-gram, all in numpy. Tasks count fingerprints of their blocks, keeping for each
the places where it occurs; the shuffle adds the counts up.

An n-gram is counted only where all its parts can be frequent, so that lengths
are counted one after the other: words, pairs of frequent words, and longer ones
made of frequent parts. What is frequent travels as a bitmap of a fixed size in
which each has two bits: a false hit costs a row and no more.

Fingerprints only choose. A last pass goes back to the places of the frequent
ones, compares every word with the text of the first word of its fingerprint,
and writes the phrases out; counts are sums by text, so that two phrases that
share a fingerprint stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.skew import global_rank
from concord.session import pinned

LONGEST = 4
CHUNK = 1 << 20  # bytes of text hashed at once; a longer text is cut between pieces, and only a longer piece stays whole
BITMAP_BITS = 27  # the bitmap of frequent fingerprints has 2^27 bits, 16 MB, whatever the corpus
COUNTED_BITS = 40  # of a fingerprint that are shuffled; phrases that share them only count together until the last pass
PACE = 1 << 18  # tables of powers grow by so many at once
SLOT_BITS = 1 << 15  # bits in one of Spark's bitmaps
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd numbers, so that their powers have inverses
WRAP = 1 << 64
# What ends a piece, what separates words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
UNKNOWN = "und"  # fixed value: the language of a row that names none
SCORE_SCALE = 2_000_000  # fixed value


def _alphabet() -> bytes:
    """Bytes as counted: A-Z lower-cased, one byte for all that ends a piece and one for all that parts words."""
    own = list(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        own[upper] = upper + 32
    for end in PIECE_ENDS:
        own[end] = 10
    for blank in BLANKS:
        own[blank] = 32
    return bytes(own)


ALPHABET = _alphabet()
CODES = np.random.default_rng(42).integers(0, WRAP, 256, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32))) * np.uint64(WORD_BASE)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(WORD_BASE)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = (np.uint64(base), np.uint64(pow(base, -1, WRAP)))
        self.made = (np.zeros(0, np.uint64),) * 2

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.made[0]) < n:
            n = -(-n // PACE) * PACE  # blocks differ in length
            self.made = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64)))) for b in self.bases)
        return self.made


class Block:
    """The words of some texts: bytes, places, fingerprints, piece and text of each."""

    def __init__(self, texts: list[bytes], langs: list[int], powers: tuple[Powers, Powers], bits: int):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(raw == 10), self.starts)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.lang = np.array(langs, np.int64)[np.searchsorted(begins, self.starts, "right") - 1]
        self.powers, self.keep = powers, np.uint64((WRAP - 1) ^ ((1 << (64 - bits)) - 1))
        up, down = powers[0].first(len(raw))
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(CODES[raw] * up[: len(raw)], out=prefix[1:])
        self.word = _mix((prefix[self.ends] - prefix[self.starts]) * down[self.starts]) & self.keep

    def grams(self, size: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, whether it lies within one piece) of the n-gram at each word but the last ones."""
        n = max(0, len(self.word) - size + 1)
        up, down = self.powers[1].first(len(self.word))
        prefix = np.zeros(len(self.word) + 1, np.uint64)
        np.cumsum(self.word * up[: len(self.word)], out=prefix[1:])
        own = (prefix[size : size + n] - prefix[:n]) * down[:n]
        found = _mix(own + salts[self.lang[:n]] * np.uint64(2 * size + 1)) & self.keep
        return found, self.piece[:n] == self.piece[size - 1 : size - 1 + n]

    def identities(self) -> np.ndarray:
        """A number for each word, equal exactly where the texts are.

        Words of one fingerprint are compared with the first of them, byte by
        byte; those that differ from it are told apart by their text.
        """
        _, first, same = np.unique(self.word, return_index=True, return_inverse=True)
        lead = first[same]
        length = self.ends - self.starts
        odd = length != length[lead]
        rest = np.flatnonzero(~odd & (lead != np.arange(len(lead))))
        if len(rest):
            raw = np.frombuffer(self.data, np.uint8)
            size = length[rest]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            unlike = raw[np.repeat(self.starts[rest], size) + within] != raw[np.repeat(self.starts[lead[rest]], size) + within]
            odd[np.unique(np.repeat(rest, size)[unlike])] = True
        ids = same.astype(np.int64)
        apart: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            ids[i] = apart.setdefault(self.data[self.starts[i] : self.ends[i]], len(first) + len(apart))
        return ids

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts, as counted, with their languages, some megabytes at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, at = (text.as_py() or "").encode().translate(ALPHABET), 0
            while at < len(data):
                cut = len(data)
                if cut - at > CHUNK:
                    cut = data.rfind(b"\n", at, at + CHUNK)
                    cut = cut if cut > at else data.find(b"\n", at + CHUNK)
                    cut = cut if cut > at else len(data)
                texts.append(data[at:cut])
                langs.append(lang)
                size += cut - at
                at = cut + 1
                if size >= CHUNK:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Block, list[str], np.ndarray]]:
    import xxhash

    powers = (Powers(BASE), Powers(WORD_BASE))
    for texts, langs in _chunks(batches):
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        salts = np.array([xxhash.xxh64_intdigest(name.encode()) | 1 for name in names], np.uint64)
        yield Block(texts, [number[x] for x in langs], powers, bits), names, salts


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of a shuffled fingerprint: its upper and its lower part."""
    return found >> (COUNTED_BITS - BITMAP_BITS), found & ((1 << BITMAP_BITS) - 1)


def _holds(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    one, other = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _places(_counted(found)))
    return one & other == 1


def _counted(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


def _counts(told: DataFrame, size: int, known, bits: int) -> DataFrame:
    """(fp, copies) of the n-grams of this size whose two parts that are a word shorter are in the bitmap, by block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, salts in _blocks(batches, bits):
            found, ok = block.grams(size, salts)
            if known:
                parts = _holds(known.value, block.grams(size - 1, salts)[0])
                ok &= parts[: len(ok)] & parts[1 : len(ok) + 1]
            own, copies = np.unique(_counted(found[ok]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(copies.astype(np.int64))], ["fp", "copies"])

    return told.mapInArrow(rows, "fp bigint, copies bigint")


def _bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """Bits of the fingerprints with at least so many copies."""
    frequent = counts.groupBy("fp").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= least)
    upper = F.shiftright("fp", COUNTED_BITS - BITMAP_BITS)
    lower = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    place = F.col("place") + 1  # Spark counts bits from one
    places = frequent.select(F.explode(F.array(upper, lower)).alias("place"))
    slots = places.select(F.bitmap_bucket_number(place).alias("slot"), F.bitmap_bit_position(place).alias("bit"))
    found = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    width = SLOT_BITS // 8
    for slot, bits in slots.groupBy("slot").agg(F.bitmap_construct_agg("bit")).collect():  # 16 MB at most
        found[(slot - 1) * width : slot * width] = np.frombuffer(bytes(bits), np.uint8)
    return found


def _texts(told: DataFrame, known, bits: int) -> DataFrame:
    """(lang, size, phrase, copies) of the n-grams in the bitmap, by block; size 0 counts all words of a language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "size", "phrase", "copies"]
        for block, langs, salts in _blocks(batches, bits):
            words = np.bincount(block.lang, minlength=len(langs))
            out = [(langs, [0] * len(langs), [b""] * len(langs), words.tolist())]
            ids = block.identities()
            base = np.int64(ids.max(initial=0) + 1)
            own = block.lang * base + ids  # tells apart languages and words; grows by a word each round
            for size in range(1, LONGEST + 1):
                if size > 1:
                    own = np.unique(own[: len(own) - 1], return_inverse=True)[1] * base + ids[size - 1 :]
                found, ok = block.grams(size, salts)
                at = np.flatnonzero(ok & _holds(known.value, found))
                _, first, copies = np.unique(own[at], return_index=True, return_counts=True)
                places = at[first]
                texts = [block.phrase(p, size) for p in places.tolist()]
                out.append(([langs[x] for x in block.lang[places]], [size] * len(texts), texts, copies.tolist()))
            for lang, size, phrase, copies in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(copies, pa.int64())],
                    names,
                )

    return told.mapInArrow(rows, "lang string, size int, phrase string, copies bigint")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, bits: int = 64) -> DataFrame:
    """(lang, size, phrase, copies): every phrase of up to four words with at least ``least`` occurrences, exactly counted.

    Size 0 holds the number of all words of a language, its phrase is empty. A
    NULL text counts as empty, a NULL language as ``und``. Repeated rows count
    each time; other columns are not read; an empty table gives no rows. With
    fewer ``bits`` fingerprints collide more often and the result is the same.
    """
    spark = docs.sparkSession
    told = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    known, bitmap = None, np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for size in range(1, LONGEST + 1):
        bitmap |= _bitmap(_counts(told, size, known, bits), least)
        if known:
            known.unpersist()
        known = spark.sparkContext.broadcast(bitmap)
    found = _texts(told, known, bits).groupBy("lang", "size", "phrase").agg(F.sum("copies").alias("copies"))
    return found.where((F.col("copies") >= least) | (F.col("size") == 0))


def _part(words: Column, first: int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, top: int = 2000, bits: int = 64
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language by how firmly they hold together.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all
    words of the language; the score is floor(2,000,000 a / (l + r)). A phrase
    that a longer frequent one holds in at least ``share`` hundredths of its
    occurrences is left out. Ties go to more occurrences, then to the phrase that
    is less in UTF-8 order. Numbers are exact. Rows that ``frequent_phrases``
    describes count as there; a language without frequent phrases has no rows.
    """
    counted = pinned(frequent_phrases(docs, text, lang, least, bits))
    totals = counted.where("size = 0").select("lang", F.col("copies").alias("n"))
    parts = counted.where("size > 0").select("lang", "phrase", "copies")
    words = F.split("phrase", " ")
    phrases = counted.where("size > 1").select("lang", "size", "phrase", F.col("copies").alias("a"), words.alias("words"))

    inner = phrases.where("size > 2").select(F.col("lang").alias("in_lang"), F.explode(_inner()).alias("inner"), F.col("a").alias("outer"))
    held = inner.groupBy("in_lang", "inner").agg(F.max("outer").alias("outer"))
    within = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner"))
    exact = [F.col(c).cast("decimal(20,0)") * F.lit(x) for c, x in (("outer", 100), ("a", share))]
    alone = phrases.join(held, within, "left").where(F.col("outer").isNull() | (exact[0] < exact[1]))

    cut = alone.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = parts.select("lang", F.col("phrase").alias("head"), F.col("copies").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("tail"), F.col("copies").alias("r"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("head"), _tail().alias("tail"))
    both = cut.join(left, ["lang", "head"]).drop("head").join(right, ["lang", "tail"]).drop("tail")
    wide = F.col("a").cast("decimal(20,0)") * F.lit(SCORE_SCALE).cast("decimal(7,0)")
    score = F.call_function("div", wide, (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")))
    scored = both.withColumn("score", score.cast("bigint"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    own = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # One order over all languages, so that a language of any size is ranked by many tasks.
    order = ["lang", "by_score", "by_copies", "phrase"]
    ranked = global_rank(own.withColumn("by_score", -F.col("score")).withColumn("by_copies", -F.col("a")), order, "spot")
    first = ranked.groupBy("lang").agg(F.min("spot").alias("first"))
    placed = ranked.join(first.join(totals, "lang"), "lang").withColumn("rank", F.col("spot") - F.col("first") + 1)
    return placed.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _tail() -> Column:
    return F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")


def _inner() -> Column:
    """The phrases of two words or more within a longer one."""
    spans = [(at, n) for n in range(2, LONGEST) for at in range(1, LONGEST - n + 2)]
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(F.size("words") > max(n, at + n - 2), _part(F.col("words"), at, n)) for at, n in spans]))
    )
