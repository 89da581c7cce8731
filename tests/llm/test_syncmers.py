import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import syncmers
from tests.llm import cases


def inner_hash(text):
    values = np.array([ord(c) for c in text], np.uint64) + np.uint64(1)
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for v in values:
            total = total * syncmers._MULTIPLIER + v
        return int(syncmers._mix(np.array([total]))[0])


def plain_places(text, k, s):
    found = []
    for i in range(len(text) - k + 1):
        inner = [inner_hash(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


@pytest.mark.parametrize("k,s", [(14, 5), (11, 4), (9, 5), (7, 7)])
def test_places(k, s):
    rng = random.Random(k)
    for _ in range(5):
        text = "".join(rng.choice("abcdé 😀") for _ in range(rng.randint(3 * k, 120)))
        places, hashes = syncmers.anchors(text, k, s)
        assert places.tolist() == plain_places(text, k, s)
        assert {text[p : p + k] for p in places}.__len__() == len(set(hashes.tolist()))


def test_context_does_not_matter():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    alone, hashes = syncmers.anchors(passage)
    inside, others = syncmers.anchors("x" * 77 + passage + "y" * 50)
    placed = dict(zip(inside.tolist(), others.tolist(), strict=True))
    assert all(placed[p + 77] == h for p, h in zip(alone.tolist(), hashes.tolist(), strict=True))
    assert np.diff(alone).max() <= syncmers.K - syncmers.S + 1


def test_blocks(monkeypatch):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(3000))
    whole = syncmers.anchors(text)
    monkeypatch.setattr(syncmers, "BLOCK", 101)
    parts = syncmers.anchors(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def runs_of(text, short):
    """All anchors of a text as the characters they cover."""
    if short:
        marked = "\0\0" + text
        return Counter({marked[i : i + 3]: 1 for i in range(len(text))})
    return Counter(text[i : i + 14] for i in plain_places(text, 14, 5))


def plain_likeness(a, b):
    short = min(len(a), len(b)) < 42
    x, y = runs_of(a, short), runs_of(b, short)
    whole = (x | y).total()
    return (x & y).total() / whole if whole else 1.0


def plain_aligned(a, b):
    places = [{}, {}]
    for text, found in zip((a, b), places, strict=True):
        for i in plain_places(text, 14, 5):
            found.setdefault(text[i : i + 14], i)
    shifts = Counter(places[1][x] - i for x, i in places[0].items() if x in places[1])
    if not shifts:
        return 0, None
    best = min(shifts, key=lambda d: (-shifts[d], abs(d), d))
    return shifts[best], best


def random_text(rng, length):
    return "".join(rng.choice("abcdefgh é😀") for _ in range(length))


def test_likeness_is_the_share_of_common_anchors():
    rng = random.Random(11)
    for _ in range(60):
        a = random_text(rng, rng.choice([0, 1, 2, 5, 20, 41, 42, 43, 60, 100]))
        cut = rng.randint(0, len(a))
        b = rng.choice([a, a[:cut], a[cut:] + a[:cut], a + "x", a * 2, random_text(rng, 50)])[:110]
        x, y = syncmers.fingerprint(a), syncmers.fingerprint(b)
        assert syncmers.alike(x, y) == pytest.approx(plain_likeness(a, b)), (a, b)
        assert syncmers.aligned(x, y) == plain_aligned(a, b)


def test_sketches_estimate_the_share():
    rng = random.Random(12)
    a = random_text(rng, 3000)
    b = a[:2000] + random_text(rng, 1000)
    assert abs(syncmers.alike(syncmers.fingerprint(a), syncmers.fingerprint(b)) - plain_likeness(a, b)) < 0.15


def test_near_copies_of_any_length_are_alike():
    rng = random.Random(13)
    for length in [*range(1, 61), 100, 500]:
        for _ in range(5):
            text = random_text(rng, length)
            own = syncmers.fingerprint(text)
            assert syncmers.alike(own, syncmers.fingerprint(text + "q")) >= 0.5
            assert length < 8 or syncmers.alike(own, syncmers.fingerprint(text[: length - length // 8])) > 0.5
            assert syncmers.alike(own, syncmers.fingerprint("".join(rng.sample("jklmnopq" * 80, length)))) < 0.2


def test_known_anchors_are_taken_over():
    rng = random.Random(14)
    for _ in range(50):
        a, b = random_text(rng, rng.randint(0, 200)), random_text(rng, rng.randint(0, 80))
        kept = rng.randint(0, len(a))
        found = syncmers.fingerprint(a[:kept] + b, syncmers.fingerprint(a), kept)
        expected = syncmers.fingerprint(a[:kept] + b)
        assert str(found) == str(expected) and found.places.tolist() == expected.places.tolist()


@pytest.mark.parametrize("block", [7, 100])
def test_short_sketch_of_blocks(monkeypatch, block):
    text = random_text(random.Random(15), 2000) + "ab" * 300
    whole = syncmers.fingerprint(text).short
    monkeypatch.setattr(syncmers, "BLOCK", block)
    assert syncmers.fingerprint(text).short.tolist() == whole.tolist()


@pytest.mark.parametrize("text", ["", "a", "ab", "abcdefgh" * 3])
def test_short_texts(text):
    found = syncmers.fingerprint(text)
    assert (len(found.short) > 0) == bool(text) and syncmers.alike(found, syncmers.fingerprint(text)) == 1


def _expected(rows):
    texts = [t or "" for _, t in rows]
    for i, (key, _) in enumerate(rows):
        here, after = texts[i], texts[(i + 1) % len(rows)]
        n = len(here) // 4
        changed = here[: len(here) - n] + after[:n]
        found = [syncmers.fingerprint(t) for t in (here, changed, after)]
        near = [round(syncmers.alike(found[0], x), 9) for x in found[1:]]
        places = [syncmers.aligned(found[0], found[1])[0], *syncmers.aligned(found[0], found[2])]
        yield key, len(here), hashlib.sha256(changed.encode()).hexdigest(), *map(str, found[:2]), *near, *places


def _found(df):
    return [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9), *r[8:]) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 3, 50, None])
def test_next_documents(spark, parts):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = _found(syncmers.compare_with_next(docs, parts=parts))
    assert sorted(map(repr, found)) == sorted(map(repr, _expected(rows)))


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)", "binary", "double"])
def test_any_type_of_key(spark, kind):
    cast = F.date_add(F.lit("2020-01-01"), F.col("n").cast("int")) if kind == "date" else F.col("n").cast("string").cast(kind)
    docs = spark.range(300).withColumnRenamed("id", "n").select(cast.alias("doc_id"), F.concat(F.lit("text "), F.md5(F.col("n").cast("string"))).alias("text"))
    rows = sorted((bytes(r.doc_id) if kind == "binary" else r.doc_id, r.text) for r in docs.collect())
    found = _found(syncmers.compare_with_next(docs, parts=7))
    found = [(bytes(r[0]) if kind == "binary" else r[0], *r[1:]) for r in found]
    assert sorted(map(repr, found)) == sorted(map(repr, _expected(rows)))


def test_rows_of_one_key_spread(spark):
    docs = spark.range(10_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    found = syncmers.compare_with_next(docs, parts=8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 3_000


def test_odd_rows(spark):
    text_hash = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in cases.ROWS], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    ordered = sorted(((r[0], r[1] or "") for r in cases.ROWS), key=lambda r: (r[0] is not None, r[0] or 0, text_hash[r[1]]))
    for parts in (1, 2, 9):
        found = _found(syncmers.compare_with_next(cases.docs(spark, clashes=("key", "hash", "part", "ahead", "before", "first_key")), parts=parts))
        assert sorted(map(repr, found)) == sorted(map(repr, _expected(ordered)))
    assert syncmers.compare_with_next(cases.empty(spark)).isEmpty()
    single = syncmers.compare_with_next(spark.createDataFrame([(9, "only one text here", "", "", 1)], cases.DOCS)).collect()
    assert len(single) == 1 and single[0].near_next == 1


def test_positional_matches(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    left = spark.createDataFrame([(1, passage), (3, None), (4, "")], "doc_id bigint, text string")
    right = spark.createDataFrame([(2, "zz" * 10 + passage)], "doc_id bigint, text string")
    found = max(syncmers.positional_matches(left, right).collect(), key=lambda r: r.anchors)
    assert (found.left_key, found.right_key, found.shift) == (1, 2, 20) and found.anchors > 20
