"""Sharding, mixing and the fixity audit."""

import random
from collections import Counter, defaultdict
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import fixity, mixing, sharding
from tests.llm import cases

# --- sharding ---


def plain_shards(rows, shards, seed=sharding.SEED):
    """{row number: (shard, slot)} by sorting everything in one place; keys are different."""
    strata = defaultdict(list)
    for i, (key, text, _, source, _) in enumerate(rows):
        digest = md5(f"{seed}|{'' if key is None else key}".encode()).hexdigest()
        strata["null" if source is None else f"={source}"].append((digest, i))
    mixed = []
    for name, members in strata.items():
        for rank, (_, i) in enumerate(sorted(members)):
            mixed.append(((2 * rank + 1) / (2 * len(members)), name, i))
    slots, out = Counter(), {}
    for position, (*_, i) in enumerate(sorted(mixed)):
        shard = position * shards // len(rows)
        out[i] = (shard, slots[shard])
        slots[shard] += 1
    return out


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_against_brute_force(spark, shards):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    expected = {rows[i][0]: v for i, v in plain_shards(rows, shards).items()}
    found = sharding.interleave(docs, shards).collect()
    assert {r.key: (r.shard, r.slot) for r in found} == expected
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text_crc32 == crc32(texts[r.key].encode()) and r.size == len(texts[r.key].encode()) + 8 for r in found)


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source")
    )
    placed = docs.join(sharding.interleave(docs, 10).withColumnRenamed("key", "doc_id"), "doc_id")
    sizes = Counter(r.shard for r in placed.collect())
    assert set(sizes.values()) == {300}
    for r in placed.groupBy("shard", "source").count().collect():
        whole = docs.where(F.col("source") == r.source).count()
        assert abs(r["count"] - whole / 10) <= 2


def test_odd_rows_are_sharded(spark):
    found = sharding.interleave(cases.docs(spark), 3).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [3, 3, 4]
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sorted((r.size, r.text_crc32) for r in found if r.key in (3, 4)) == [(8, 0), (8, 0)]
    assert sharding.interleave(cases.empty(spark), 3).isEmpty()
    docs = cases.docs(spark)
    whole = sharding.shard_documents(docs, 3)
    assert whole.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert sorted((repr(r.doc_id), r.shard, r.slot) for r in whole.collect()) == sorted((repr(r.key), r.shard, r.slot) for r in found)
    assert sharding.shard_documents(cases.empty(spark), 3).isEmpty()


# --- mixing ---


def test_rake_meets_the_targets():
    rng = np.random.default_rng(1)
    mass = rng.integers(1, 100, 60).astype(float)
    codes = [np.arange(60) // 12, np.arange(60) // 4 % 3, np.arange(60) % 4]
    targets = [rng.dirichlet(np.ones(n)) for n in (5, 3, 4)]
    found = mixing.rake(mass, codes, targets)
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, found), target, atol=1e-9)
    kept = found / mass  # raking keeps the interactions of the cells
    a, b, c, d = (kept[i] for i in (0, 4, 12, 16))
    assert np.isclose(a * d, b * c)


def test_sampled_mixture_meets_the_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en" if i % 10 else "de", f"s{min(i % 8, 3)}", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    wanted = {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}
    mixed = mixing.mix(docs, mixing.Targets({"source": wanted, "lang": {"en": 0.8, "de": 0.2}}))
    kept = mixed.where("mix_kept")
    total = kept.agg(F.sum("mix_tokens")).head()[0]
    for column, shares in (("source", wanted), ("lang", {"en": 0.8, "de": 0.2})):
        for r in kept.groupBy(column).agg(F.sum("mix_tokens").alias("n")).collect():
            assert abs(r.n / total - shares[r[column]]) < 0.02
    assert mixed.agg(F.max("mix_probability")).head()[0] == 1


def test_odd_rows_are_mixed(spark):
    docs = cases.docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.count() == len(cases.ROWS)
    assert {r.mix_kept for r in mixed.where("doc_id = 2").collect()}.__len__() == 1
    tokens = {r.doc_id: r.mix_tokens for r in mixed.collect()}
    assert (tokens[1], tokens[3], tokens[4], tokens[6]) == (11, 0, 0, 0) and tokens[5] == 100_000
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert cases.rows_of(kept) == cases.rows_of(mixed.where("mix_kept").select(*[c for c in docs.columns if c != "mix_kept"], F.lit("x").alias("mix_kept")).select(docs.columns))
    assert mixing.mix(cases.empty(spark)).isEmpty() and mixing.sample(cases.empty(spark)).isEmpty()


def test_pooled_categories_and_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w", "en", f"s{i}", 1) for i in range(30)], cases.DOCS)
    monkeypatch.setattr(mixing, "MAX_CATEGORIES", 4)
    assert mixing.mix(docs).count() == 30
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_every_category_keeps_its_target(spark):
    """More sources than the driver takes are raked to their own targets, as they are by the driver."""
    n = mixing.MAX_CATEGORIES + 200
    rows = [(i, "w " * (1 + i % 7 + (i % n) // 50), "en" if i % 3 else "de", f"s{i % n}", 1) for i in range(2 * n)]
    docs = spark.createDataFrame([*rows, (-1, None, None, "none", 1)], cases.DOCS)
    mass = Counter()
    for _, text, lang, source, _ in rows:
        mass[(source, lang)] += text.count("w")
    cells = sorted(mass)
    share = np.array([mass[c] for c in cells], dtype=float)
    codes = [np.unique([c[i] for c in cells], return_inverse=True)[1] for i in (0, 1)]
    goals = []
    for code, temper in zip(codes, (0.7, 0.8), strict=True):
        goal = (np.bincount(code, share) / share.sum()) ** temper
        goals.append(goal / goal.sum())
    ratio = mixing.rake(share, codes, goals) / share
    expected = dict(zip(cells, ratio / ratio.max(), strict=True))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) + 1
    assert all(np.isclose(r.mix_probability, expected.get((r.source, r.lang), 1.0), rtol=1e-9) for r in found)


# --- fixity ---


def _leaves(spark, rows):
    return spark.createDataFrame([(i, len(t), sha256(t.encode()).hexdigest()) for i, t in rows], "ordinal bigint, length bigint, digest string")


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 16), (3, 17), (4, 300)])
def test_audit_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    left = {i: f"record {i}" for i in range(n)}
    right, expected = dict(left), {}
    for i in rng.sample(range(n + 5), min(n, 6)):
        kind = rng.choice(["changed", "length", "missing"]) if i < n else "extra"
        expected[i] = kind
        if kind == "missing":
            del right[i]
        else:
            right[i] = {"changed": f"Xecord {i}", "length": "cut", "extra": "more"}[kind]
    found = fixity.audit(_leaves(spark, left.items()), _leaves(spark, right.items()))
    assert {r.ordinal: r.problem for r in found.collect()} == expected


def test_equal_and_empty_replicas(spark):
    leaves, none = _leaves(spark, [(i, str(i)) for i in range(40)]), _leaves(spark, [])
    assert fixity.audit(leaves, leaves).isEmpty() and fixity.audit(none, none).isEmpty()
    assert {r.problem for r in fixity.audit(leaves, none).collect()} == {"missing"}
    assert fixity.audit(none, leaves).count() == 40


def test_layout(spark):
    rows = [(None, 5, "n"), (2, 7, "b"), (2, 7, "b"), (1, 3, "a"), (9, 4, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, length bigint, digest string")
    laid = fixity.lay_out(df, ["page_id", "digest"], "length", segment=2).orderBy("ordinal").collect()
    assert [(r.page_id, r.segment, r.offset) for r in laid] == [(None, 0, 0), (1, 0, 5), (2, 1, 0), (2, 1, 7), (9, 2, 0)]
    text = spark.createDataFrame([("u", "ü"), (None, None)], "url string, html string").select(fixity.warc_record("url", "html"))
    assert [r[0] for r in text.collect()] == [
        "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nContent-Length: 2\r\n\r\nü\r\n\r\n",
        "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: \r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
