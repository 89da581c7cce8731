import random

import pytest

from concord.llm import decontam
from tests.llm import cases


def best(item, text):
    """Least edit distance between the item and any part of the text, and where it first ends."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before), before.index(min(before))


@pytest.mark.parametrize("seed", range(5))
def test_myers(seed):
    rng = random.Random(seed)
    for _ in range(80):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        limit, expected = rng.randint(0, 40), best(item, text)
        assert decontam.myers(item, text, limit) == (expected if expected[0] <= limit else None)


def test_pieces():
    assert decontam.pieces("abcdefg", 2) == [(0, "ab"), (2, "cd"), (4, "efg")]
    assert decontam.pieces("ab", 5) == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("seed", range(5))
def test_edited_items_are_found_exactly_within_the_budget(seed):
    rng = random.Random(seed)
    for _ in range(60):
        item = decontam.normalize("".join(rng.choice("abcdefghij ") for _ in range(rng.randint(20, 90))))
        body = list(item)
        for _ in range(rng.randint(0, decontam.budget(item, 0.1) + 2)):
            at, kind = rng.randrange(len(body)), rng.random()
            body[at : at + (kind < 0.7)] = [rng.choice("xyz")] if kind < 0.4 or kind >= 0.7 else []
        text = "".join(rng.choice("klmn") for _ in range(40)) + "".join(body) + "".join(rng.choice("klmn") for _ in range(40))
        text = decontam.normalize(text)
        expected, found = best(item, text)[0], decontam.Matcher([(1, item)], 0.1).find(text)
        assert (1 in found) == (expected <= decontam.budget(item, 0.1))
        if found:
            distance, start, end = found[1]
            assert distance == expected and best(item, text[start:end])[0] == expected


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_documents_against_brute_force(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six seven"), (3, None), (4, "  ")]
    texts = [
        (1, "see ALPHA beta\n gamma delta epsilon here", "en", "a", 1),
        (2, "alpha beta gamme delta epsilon and one two thre four five six seven", "en", "a", 1),
        (2, "alpha beta gamma", "en", "a", 1),
        (3, "unrelated", "en", "a", 1),
        *cases.ROWS,
    ]
    found = decontam.leaks(cases.docs(spark, texts), _items(spark, rows))
    expected = []
    for key, text, *_ in texts:
        for item, wanted in rows:
            if (wanted or "").strip():
                distance = best(decontam.normalize(wanted), decontam.normalize(text)[:500])[0]
                if distance <= decontam.budget(wanted, 0.1):
                    expected.append((key, item, distance))
    assert sorted((r.key, r.item, r.distance) for r in found.collect()) == sorted(expected)
    assert len(expected) == 3
    docs = cases.docs(spark, texts)
    clean = decontam.clean(docs, _items(spark, rows))
    assert clean.columns == docs.columns and clean.count() == len(texts) - 2


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rows = [(i, f"item number {i} with some words of its own {i * 7}") for i in range(9)]
    docs = cases.docs(spark, [(k, f"before {t} after", "en", "a", 1) for k, t in rows], ())
    whole = cases.rows_of(decontam.leaks(docs, _items(spark, rows)))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert cases.rows_of(decontam.leaks(docs, _items(spark, rows))) == whole
    assert decontam.clean(docs, _items(spark, rows)).isEmpty()


def test_empty_tables(spark):
    items, none = _items(spark, [(1, "some item text")]), _items(spark, [])
    assert decontam.leaks(cases.empty(spark), items).isEmpty() and decontam.clean(cases.empty(spark), items).isEmpty()
    assert decontam.leaks(cases.docs(spark), none).isEmpty()
    assert decontam.clean(cases.docs(spark), none).count() == len(cases.ROWS)


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{cases.SF}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = {r.item_id: decontam.normalize(r.text) for r in items.collect()}
    exact = {(d.doc_id, i) for d in docs.collect() for i, t in wanted.items() if t in decontam.normalize(d.text)}
    found = decontam.leaks(docs, items).collect()
    assert exact and {(r.key, r.item) for r in found if r.distance == 0} == exact


@pytest.mark.parametrize("size", [decontam.BLOCK_BYTES, 1])
@pytest.mark.parametrize("key", [None, 7])
def test_items_that_share_a_key_or_have_none(spark, monkeypatch, key, size):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
    texts = ["alpha beta gamma delta", "one two three four five", "zulu yankee xray whiskey"]
    items = _items(spark, [(key, t) for t in texts])
    docs = cases.docs(spark, [(i, f"see {t} here", "en", "a", 1) for i, t in enumerate(texts)] + [(9, "none", "en", "a", 1)], ())
    found = decontam.leaks(docs, items).collect()
    assert sorted((r.key, r.item, r.distance) for r in found) == [(0, key, 0), (1, key, 0), (2, key, 0)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [9]


def test_items_of_any_length(spark):
    rng = random.Random(3)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(15_000))
    body = list(long)
    for at in rng.sample(range(len(body)), 30):
        body[at] = "~"
    items = _items(spark, [(1, long), (2, "a short item of words")])
    docs = cases.docs(spark, [(1, "".join(body), "en", "a", 1), (2, long[:90_000], "en", "a", 1)], ())
    assert len(long) > 100_000
    assert [(r.key, r.item, r.distance) for r in decontam.leaks(docs, items).collect()] == [(1, 1, 30)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]


def test_blocks_are_read_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    blocks = decontam._blocks(_items(spark, [(i, "eight ch") for i in range(4)]), "item_id", "text")
    assert next(blocks) == [(0, "eight ch")] and len(list(blocks)) == 3
    assert list(decontam._blocks(_items(spark, []), "item_id", "text")) == [[]]
