"""Phrase collocations against a plain count of every phrase."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import SF, docs, empty

from concord.llm import phrases
from concord.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    found[lang, tuple(words[at : at + size])] += 1
    return found, totals


def expected(rows, least, share=80, top=2000):
    found, totals = counted(rows)
    frequent = {k: n for k, n in found.items() if n >= least}
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        longer = [n for (x, w), n in frequent.items() if x == lang and len(w) > len(words)
                  and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, words[:k]], found[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])
    )


def of(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 0) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["the", "New", "york", "city", "Ünï", "a b", "漢字", "x", "of", "hall"]
    rows = []
    for i in range(120):
        picked = rng.choice(words, rng.integers(0, 60), p=np.array([9, 5, 5, 3, 2, 2, 2, 1, 5, 2]) / 36)
        marks = rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " ? "], len(picked), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append((["en", "de", None, "und"][i % 4], "".join(w + m for w, m in zip(picked, marks))))
    return rows


@pytest.mark.parametrize("bits", [64, 6, 2])
def test_equals_a_plain_count_also_if_fingerprints_collide(spark, texts, bits):
    found = of(table(spark, texts), least=4, bits=bits)
    assert found == expected(texts, 4) and len(found) > 20


def test_top_and_ties(spark, texts):
    rows = [("en", "b a, a b, c d. d c")] * 5
    assert of(table(spark, rows), least=5, top=3) == expected(rows, 5, top=3)


def test_long_texts_are_cut_between_pieces_only(spark, texts, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    rows = [("en", "one two three four five. " * 40), ("en", "one two three four " * 30)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [t for _, t in rows]})
    found = []
    for texts_, langs in phrases._chunks(iter([batch])):
        found += [t for t in texts_]
    assert b"\n".join(found).split() == b"\n".join(t.encode().translate(phrases.ALPHABET) for _, t in rows).split()
    assert max(map(len, found)) == len(rows[1][1])  # a text of one piece stays whole


def test_odd_rows(spark):
    df = docs(spark)
    rows = [(r.lang, r.text) for r in df.collect()]
    assert of(df, least=2) == expected(rows, 2)
    assert of(empty(spark)) == []
    blank = table(spark, [(None, None), ("en", ""), ("en", " .,\n")])
    assert of(blank, least=1) == []


def test_skewed_language_and_repeats(spark):
    rows = [("en", "good morning to you")] * 400 + [("fr", "bon jour")] * 3
    assert of(table(spark, rows), least=3) == expected(rows, 3)


def test_query_equals_its_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(ORACLES["op11_phrases"])
    names = [d[0] for d in cursor.description]
    wanted = sorted(cursor.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op11_phrases"](spark, SF).collect()) == wanted
