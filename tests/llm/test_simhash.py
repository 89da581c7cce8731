import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from concord.llm import simhash
from concord.llm.graph import components
from tests.llm import cases


def plain(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    """{key: least key reachable} over links of at most ``bits`` differing bits, by brute force."""
    root = {k: k for k in prints}
    keys = sorted(prints)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= bits and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("text", [None, "", " \t", "one", "One two", "a b c d e", "Ünï çode 漢字 ab", "x " * 300 + "tail"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == [simhash.signed(plain(text, 3))]


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(map(str, range(500)))
    whole = simhash.fingerprint(text, 3, 2)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text, 3, 2) == whole


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_pair_within_the_radius_meets(radius):
    rng = random.Random(radius)
    for _ in range(2000):
        flips = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(flips & (m & (2**64 - 1)) == 0 for m in simhash.masks(radius))


@pytest.mark.parametrize("small", [simhash.SMALL_BUCKET, 1])
def test_links_of_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(4)
    prints = {}
    for base in range(6):
        at = rng.getrandbits(64)
        for i in range(12):
            prints[base * 100 + i] = at
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    df = spark.createDataFrame([(k, simhash.signed(v)) for k, v in prints.items()], "key bigint, node bigint")
    links = simhash.link(df.select("node", F.array("node").alias("fp")), 1, 2, 2)
    roots = {r.node: r.root for r in components(links).collect()}
    expected = classes(prints, 2)
    for a in prints:
        for b in prints:
            x, y = (roots.get(simhash.signed(prints[k]), simhash.signed(prints[k])) for k in (a, b))
            assert (x == y) == (expected[a] == expected[b])


def test_query_rows_against_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    found = {r.key: r for r in simhash.near_duplicates(docs, width=3, words=1, radius=2, max_bits=2).collect()}
    prints = {r.doc_id: plain(r.text, 3) for r in docs.collect()}
    assert {k: r.fp[0] for k, r in found.items()} == {k: simhash.signed(v) for k, v in prints.items()}
    assert {k: r.component for k, r in found.items()} == classes(prints, 2)


def test_odd_rows(spark):
    found = simhash.near_duplicates(cases.docs(spark), width=3, words=1, radius=2, max_bits=2).collect()
    named = [(repr(r.key), r.component) for r in found]
    assert len(found) == len(cases.ROWS)
    blank = [("3", 3), ("4", 3), ("6", 3), ("None", 3)]
    assert set(blank) <= set(named) and ("None", None) in named and named.count(("2", 1)) == 2
    assert simhash.near_duplicates(cases.empty(spark)).isEmpty()


def test_deduplicate(spark):
    docs = cases.docs(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "7", "None"]
    twice = cases.docs(spark, [(2, "a b c d e f", "en", "z", 1), (2, "a b c d e f", "en", "y", 1)], ())
    assert [r.source for r in simhash.deduplicate(twice).collect()] == ["y"]
    assert simhash.deduplicate(cases.empty(spark)).isEmpty()


def _classes_of(texts, least=0.8, width=5):
    """{key: least key reachable} over all pairs of this Jaccard similarity, by brute force."""
    sets = {k: frozenset(simhash.shingle_set(t, width).tolist()) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in keys}


def _found(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r.key: r.component for r in simhash.similar_documents(df, **options).collect()}


def _edited(rng, words, n):
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"e{rng.randrange(10**9)}"
    return own


def test_every_pair_at_the_similarity_is_linked(spark):
    """Pairs all around 0.8, of short and long texts, against all pairs."""
    rng = random.Random(7)
    texts = {}
    for base in range(120):
        n = rng.choice([1, 3, 5, 8, 20, 60, 300])
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts[base * 10] = " ".join(words)
        for copy in range(1, 4):
            texts[base * 10 + copy] = " ".join(_edited(rng, words, min(n, rng.randrange(1 + n // 30 + 2))))
    expected = _classes_of(texts)
    assert 0 < sum(k != v for k, v in expected.items()) < len(texts)
    assert _found(spark, texts) == expected


def test_all_pairs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.key: r.component for r in simhash.similar_documents(docs).collect()}
    assert found == _classes_of(texts)


@pytest.mark.parametrize("own", [9, 30])
def test_a_shared_passage_in_many_texts(spark, monkeypatch, own):
    """Texts that are mostly one passage meet in its buckets, and only similar ones are linked; rare shingles go first."""
    monkeypatch.setattr(simhash, "COMPARED_BLOCK", 16)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(100)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(own + i % 20)]) for i in range(150)}
    expected = _classes_of(texts)
    assert _found(spark, texts) == expected


def test_many_unrelated_members_of_one_bucket(spark):
    rng = random.Random(13)
    line = "one line that all of them share word for word"
    texts = {i: f"{line} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for i in range(5000)}
    found = _found(spark, texts)
    assert found == {i: i for i in range(5000)}


def test_a_large_group_around_one_text(spark):
    """Thousands of copies, each at 0.8 or more to one text and often less to each other."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(_edited(rng, words, 5) if i else words) for i in range(2000)}
    assert set(_found(spark, texts).values()) == {0}


def test_bins_bound_what_sets_share():
    rng = random.Random(19)
    for n in (0, 1, 50, 3000):
        x, y = ({rng.getrandbits(64) for _ in range(n)} for _ in range(2))
        x |= set(list(y)[: n // 2])
        a, b = (np.frombuffer(simhash.bins(np.array(sorted(v), np.uint64)), np.uint8) for v in (x, y))
        assert len(x & y) <= np.minimum(a, b).sum() and a.sum() == len(x)
        p, q = (int.from_bytes(simhash.spread(np.array(sorted(v), np.uint64)).tobytes(), "little") for v in (x, y))
        assert len(x & y) <= min(len(x) - (p & ~q).bit_count(), len(y) - (q & ~p).bit_count())
    assert simhash.bins(np.full(70_000, 5, np.uint64)) == b""


def test_first_shingles_suffice():
    for n in range(1, 300):
        kept = simhash.prefix_length(n, 0.8)
        # A similar set shares at least this many of the n; so many cannot all lie after the first ones.
        least = -(-4 * n // 5)
        assert kept >= 1 and n - kept < least


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {x: x for link in links for x in link}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    alone = {x for x in root if all(x not in link or link == (x, x) for link in links)}
    assert found == {k: v for k, v in root.items() if k not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def _jaccard(a, b):
    x, y = (set(simhash.shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_one_repeated_line_does_not_link(spark):
    rng = random.Random(5)
    line = " ".join(f"l{i}" for i in range(10))
    rows = [(i, " ".join([line] * 20 + [f"w{rng.randrange(10**9)}" for _ in range(200)])) for i in range(30)]
    assert _jaccard(rows[0][1], rows[1][1]) < 0.1
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.component == r.key for r in found)


def test_parities_bound_what_sets_do_not_share():
    rng = random.Random(23)
    for n in (0, 1, 50, 3000):
        shared = {rng.getrandbits(64) for _ in range(n)}
        for k in (0, 1, 40, 400):
            x, y = (shared | {rng.getrandbits(64) for _ in range(k)} for _ in range(2))
            p, q = (int.from_bytes(simhash.parity(np.array(sorted(v), np.uint64)).tobytes(), "little") for v in (x, y))
            assert 0.4 * len(x ^ y) <= (p ^ q).bit_count() <= len(x ^ y)


def test_pairs_of_unlike_copies_are_made_once(spark, monkeypatch):
    """Copies of one text that are too unlike to link share very many buckets; the join makes few of their pairs."""
    rng = random.Random(29)
    words = [f"w{i}" for i in range(3000)]  # so many that marked bits cannot tell them apart
    texts = [(i, " ".join(_edited(rng, words, 85))) for i in range(40)]
    texts.append((40, " ".join(words)))
    made = []
    across = simhash._across

    def watched(met, found, nodes, least):
        with monkeypatch.context() as patch:
            patch.setattr(type(met), "distinct", lambda self: self)  # the join's own rows
            pairs = across(met, found, nodes, least)
        made.append([tuple(r) for r in pairs.collect()])
        return pairs.distinct()

    monkeypatch.setattr(simhash, "_across", watched)
    found = _found(spark, dict(texts))
    assert found == _classes_of(dict(texts))
    assert made[0] and len(made[0]) <= 1.5 * len(set(made[0]))


def test_unlike_copies_of_a_long_text_make_no_pairs(spark, monkeypatch):
    """Parities grow with the set, so that pairs of long texts that share half of their shingles are not looked at whole."""
    rng = random.Random(31)
    texts = {}
    for base in range(4):
        words = [f"w{base}-{i}" for i in range(6000)]  # fewer copies than make a shingle frequent, so that they meet in very many buckets
        texts |= {10 * base + i: " ".join(_edited(rng, words, 420)) for i in range(simhash.FREQUENT - 1)}
    made = []
    across = simhash._across

    def watched(*args):
        pairs = across(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "_across", watched)
    assert _found(spark, texts) == {i: i for i in texts}
    assert made == [0]


@pytest.mark.parametrize("block", [4, 8, simhash.COMPARED_BLOCK])
def test_tiles_hold_every_pair_of_two_classes(spark, monkeypatch, block):
    """Members of two buckets, with a class of twenty, one of ten and lone ones; sets are of one size but for the last."""
    monkeypatch.setattr(simhash, "COMPARED_BLOCK", block)
    n = 45
    root = {i: 0 if i < 20 else 20 if i < 30 else i for i in range(n)}
    size = {i: 100 if i < n - 1 else 79 for i in range(n)}
    members = {5: range(n), 9: range(10, n)}
    met = spark.createDataFrame([(b, i, size[i], len(m)) for b, m in members.items() for i in m], "bucket bigint, node bigint, size bigint, members bigint")
    roots = spark.createDataFrame([(i, root[i]) for i in range(30)], "node bigint, root bigint")
    parities = [simhash.parity(np.arange(i % 3, dtype=np.uint64) << np.uint64(7)).tobytes() for i in range(n)]
    nodes = spark.createDataFrame(list(enumerate(map(bytearray, parities))), "node bigint, parity binary")
    found = simhash._across(met, roots, nodes, 0.8)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n - 1) if root[a] != root[b]]


def test_parities_of_other_lengths_fold():
    rng = random.Random(37)
    sets = [np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64) for n in (0, 900, 2100, 2500, 5000, 9000)]
    sets += [sets[4][:4000], sets[5][:7000], sets[5][:8500]]
    prints = [simhash.parity(v).tobytes() for v in sets]
    assert len(set(map(len, prints))) == 3
    folds = simhash._folds(pa.chunked_array([pa.array(prints, pa.binary())]))
    x, y = (v.ravel() for v in np.meshgrid(*[np.arange(len(sets))] * 2))
    for a, b, apart in zip(x, y, simhash._apart(folds, x, y), strict=True):
        bits = 8 * min(len(prints[a]), len(prints[b]))
        odd = np.bincount((np.setxor1d(sets[a], sets[b]) >> np.uint64(7)).astype(np.int64) % bits) & 1
        assert apart == odd.sum()
