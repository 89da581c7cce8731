from zlib import crc32

import numpy as np
import pytest

from concord.llm import quality, toxicity
from concord.llm.learning import labelled_rows, labelled_sample
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def _split(spark, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.join(labels, "doc_id").select("doc_id", label, "text", "lang").collect()]
    held = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    return docs, labels, held


@pytest.mark.parametrize("name,label,cut", [("quality", "quality", 0.7), ("toxicity", "toxic", 0.3)])
def test_held_out_accuracy(spark, name, label, cut):
    module = {"quality": quality, "toxicity": toxicity}[name]
    docs, labels, held = _split(spark, label)
    model = module.train(docs, labels)
    wanted = {r[0]: r[1] for r in held}
    found = {r.key: r.score for r in module.classify(docs.join(labels.select("doc_id"), "doc_id"), model).collect()}
    right = np.mean([(found[k] >= cut) == bool(v) for k, v in wanted.items()])
    common = max(np.mean(list(wanted.values())), 1 - np.mean(list(wanted.values())))
    assert right > 0.95 and right > common + 0.03
    assert all(0 <= s <= 1 for s in found.values())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    labels = cases.labels(spark, [(1, 1, 0), (3, 0, 1), (None, 0, 1), (4, None, None), (7, 0, 1), (7, 1, 0), (99, 0, 1)])
    docs = cases.docs(spark)
    model = module.train(docs, labels)
    found = module.classify(docs, model).collect()
    assert len(found) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in found)
    blank = {r.score for r in found if r.key in (3, 4)}
    assert len(blank) == 1
    assert len({r.score for r in found if r.key == 2}) == 1
    assert module.classify(cases.empty(spark), model).isEmpty()
    for none in (cases.labels(spark, []), cases.labels(spark, [(1, 1, 1), (2, 1, 1)])):
        assert module.classify(docs, module.train(docs, none)).count() == len(cases.ROWS)
    module.train(cases.empty(spark), labels)


def test_scores_cover_whole_texts_in_any_batch(spark):
    docs, labels, held = _split(spark, "toxic")
    model = toxicity.train(docs, labels)
    texts = [r[2] for r in held[:40]] + [None, ""]
    together = toxicity.score(model["params"], texts)
    assert np.allclose(together, [toxicity.score(model["params"], [t])[0] for t in texts], atol=1e-5)
    clean = next(r[2] for r, s in zip(held, together, strict=False) if r[1] == 0 and s < 0.1)
    toxic = next(r[2] for r, s in zip(held, together, strict=False) if r[1] == 1 and s > 0.5)
    buried = (clean + " ") * (20_000 // len(clean.split())) + toxic
    assert toxicity.score(model["params"], [buried])[0] > 0.5
    assert {r[0] for r in held[:3]} <= {r.key for r in toxicity.classify(docs, model).collect()}


def test_quality_batches():
    p = quality.fit([(i, i % 2, "abc def " * 90 if i % 2 else "!!## " * 90, "en") for i in range(64)], 0.5)
    texts = ["abc def " * 900, "!!## " * 400, "", None, "é" * 5000, "abc"]
    together = quality.score(p, texts)
    assert np.allclose(together, [quality.score(p, [t])[0] for t in texts], atol=1e-5)
    assert together[0] > 0.7 > 0.3 > together[1]


@pytest.mark.parametrize("size,n", [(0, 1), (1, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_chunks_cover_every_byte(size, n):
    data = bytes(1 + i % 120 for i in range(size))
    found = quality.chunks(data.decode())
    assert len(found) == n
    joined = b"".join(bytes(c[: quality.HOP]) for c in found[:-1]) + bytes(found[-1])
    assert joined.rstrip(b"\0") == data


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample, prior = labelled_sample(docs, labels, "toxic", 100)
    rows = sample.collect()
    assert len(rows) == 100 and sum(r.label for r in rows) == 50 and 0.05 < prior < 0.2
    assert all(crc32(str(r.key).encode()) % 4 != 2 for r in rows)


def test_thresholds_by_language(spark):
    rows = [(i, y, "", lang) for lang in ("en", "de") for i in range(40) for y in (0, 1)]
    scores = np.array([{("en", 1): 0.9, ("en", 0): 0.5, ("de", 1): 0.2, ("de", 0): 0.05}[r[3], r[1]] for r in rows])
    found = toxicity.calibrate(scores, rows)
    assert 0.5 < found["en"] <= 0.9 and 0.05 < found["de"] <= 0.2
    model = {"params": toxicity.fit([], 0.1)["params"], "thresholds": found}
    cuts = {r.lang: r.threshold for r in toxicity.classify(cases.docs(spark), model).collect()}
    assert cuts["en"] == found["en"] and cuts["de"] == found["de"] and cuts["fr"] == cuts[None] == found[None]


def test_a_sample_has_one_row_for_each_key(spark):
    rows = [(6, f"copy {i}", "en", "a", 6) for i in range(5000)] + [(i, f"text {i}", "de", "a", 6) for i in range(100, 140)]
    docs = cases.docs(spark, rows, clashes=("key", "label", "doc", "prior"))
    marks = cases.labels(spark, [(i, i % 2, i % 2) for i in [6, *range(100, 140)]] + [(6, 0, 0)])
    sample, prior = labelled_sample(docs, marks, "toxic", rows=1000)
    found = {r.key: tuple(r)[1:] for r in sample.collect()}
    kept = {i for i in [6, *range(100, 140)] if crc32(str(i).encode()) % 4 != 2}
    assert sample.count() == len(kept) == len(found) and set(found) == kept and 0 < prior < 1
    assert found[6] == (0, "copy 0", "en")
    assert labelled_sample(docs, marks, "toxic", rows=10)[0].count() <= 10


def test_toxicity_learns_from_every_labelled_document(spark):
    """Words that only occur in a text of over 200,000 characters, or beyond the first 20,000 labelled rows."""
    rows = [(i, f"plain text {i % 50}", "en", "a", 9) for i in range(28_000)]
    keys = spark.createDataFrame([(i,) for i in range(28_000)], "key bigint").selectExpr("key", "xxhash64(key) AS h")
    ones = [r.key for r in keys.orderBy("h").collect() if crc32(str(r.key).encode()) % 4 != 2 and r.key % 2]
    late, long = set(ones[-200:]), set(ones[:10])
    assert len(ones) > 10_200
    texts = {i: "zork here" for i in late} | {i: "long " * 50_000 + "quux" for i in long}
    docs = spark.createDataFrame([(i, texts.get(i, t), *rest) for i, t, *rest in rows], cases.DOCS)
    toxic = cases.labels(spark, [(i, 0, int(i in texts)) for i in range(28_000)])
    found, _ = labelled_rows(docs, toxic, "toxic")
    assert {r.key for r in found.select("key").collect()} == {i for i in range(28_000) if crc32(str(i).encode()) % 4 != 2}
    model = toxicity.train(docs, toxic)
    zork, quux, plain = toxicity.score(model["params"], ["zork here", "long quux", "plain text 7"])
    assert min(zork, quux) > 0.5 > 0.1 > plain


def test_toxicity_shares_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARE_CHARS", 1_000_000)
    monkeypatch.setattr(toxicity, "FAN_IN", 3)
    docs, labels, held = _split(spark, "toxic")
    model = toxicity.train(docs, labels)
    found = toxicity.score(model["params"], [r[2] for r in held])
    assert np.mean([(s >= 0.3) == bool(r[1]) for s, r in zip(found, held, strict=True)]) > 0.95
    again = toxicity.train(docs.repartition(5), labels.repartition(2))
    assert all(np.array_equal(v, again["params"][k]) for k, v in model["params"].items()) and model["thresholds"] == again["thresholds"]


def test_a_long_text_is_pooled_block_by_block(monkeypatch):
    p = toxicity.initial(0.1)["params"]
    parts = [np.arange(1, n + 1, dtype=np.int32) for n in (5, 0, 90, 33)]
    ids, starts = toxicity._stream(parts)
    spans = [(int(a), int(a) + len(x) + 1) for a, x in zip(starts, parts, strict=True)]
    best, top = toxicity._tops(p, ids, spans)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    again = toxicity._tops(p, ids, spans)
    assert np.array_equal(best, again[0]) and np.allclose(top, again[1])
