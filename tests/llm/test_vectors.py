"""Hard negatives and nearest neighbours against plain searches."""

import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import SF
from pyspark.sql import functions as F

from concord.llm import grid, hamming, negatives
from concord.llm.queries import ORACLES, QUERIES

KINDS = "vec_id bigint, embedding array<double>, label int"


def hard(rows, anchor, positives=5, negatives_=10, low=30, high=90, scale=256):
    """The contract, read plainly; rows are (id, vector, label)."""
    told = [(i, [math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale for x in v], lab, n) for n, (i, v, lab) in enumerate(rows)
            if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a_id, a, a_lab, a_n in told:
        if not anchor(a_id):
            continue
        scores = [(-sum(x * y for x, y in zip(a, c)), i, lab) for i, c, lab, n in told if n != a_n and len(c) == len(a)]
        near = sorted((s, i) for s, i, lab in scores if lab == a_lab)[:positives]
        for s, p in near:
            band = sorted((t, i) for t, i, lab in scores if lab != a_lab and low * -s <= 100 * -t <= high * -s)
            out += [(a_id, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(band[:negatives_])]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, **options).collect()))


def made(seed, n, dim, labels=3, scale=1.0):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.normal(size=(n, dim)) * scale, 2) + 0.3
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("scale", [1.0, 1000.0, 1e6])
def test_packed_products_are_exact(scale):
    rng = np.random.default_rng(1)
    a, c = (rng.integers(-int(scale * 100), int(scale * 100) + 1, (n, 7)) for n in (5, 40))
    packed = negatives.Packed(c, int(np.abs(a).max()))
    for x in a:
        assert packed.products(x).tolist() == [sum(int(p) * int(q) for p, q in zip(x, y)) for y in c]


def test_products_beyond_64_bits_stop_at_the_bounds():
    big = negatives.whole(np.array([[1e200, -3.0], [-1e200, 2.5], [0.0, 0.004]]))
    packed = negatives.Packed(big, int(max(abs(x) for x in big.ravel())))
    assert packed.products(big[0]).tolist() == [negatives.MOST, -negatives.MOST, -768]
    assert big[2].tolist() == [0, 1] and big[0][1] == -768


def test_hard_negatives_equal_a_plain_search(spark, monkeypatch):
    rows = made(2, 150, 6)
    df = spark.createDataFrame(rows, KINDS)
    assert mined(df) == hard(rows, lambda i: i % 5 == 0)
    monkeypatch.setattr(grid, "STATED_BLOCK", 7)
    monkeypatch.setattr(grid, "ROWS_BLOCK", 40)
    assert mined(df) == hard(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_odd_rows(spark):
    base = made(3, 40, 4)
    same = [(i, [0.5, 0.5, 0.25, 1.0], i % 2) for i in range(100, 130)]  # ties
    odd = [(200, None, 1), (205, [1.0, None, 2.0, 3.0], 1), (210, [math.nan] * 4, 0), (215, [math.inf, 1.0, 1.0, 1.0], 0),
           (220, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 1.0, 1.0, 1.0], 0), (225, [], 1), (230, [0.0] * 4, 1), (235, [5.0, 6.0], 0), (236, [4.0, 7.0], 1)]
    rows = base + same + odd + base[:6] + [base[5]] * 3  # repeated rows, also anchors
    df = spark.createDataFrame(rows, KINDS)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("row", "dim", "id", "vector", "q_block", "rank", "place", "is_anchor")])
    assert mined(df) == hard(rows, lambda i: i % 5 == 0)
    assert mined(spark.createDataFrame([], KINDS)) == []


def test_hot_label(spark):
    rows = [(i, v, 0 if i % 10 else 1) for i, v, _ in made(4, 300, 5)]
    assert mined(spark.createDataFrame(rows, KINDS)) == hard(rows, lambda i: i % 5 == 0)


def test_hard_negatives_query_equals_its_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(ORACLES["op12_negatives"])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op12_negatives"](spark, SF).collect()) == sorted(cursor.fetchall())


def exact_neighbours(rows, query, near=20):
    told = [(i, np.array(v, float), n) for n, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q_id, q, q_n in told:
        if query(q_id):
            out[q_n] = (q_id, sorted((-float(sum((x * y for x, y in zip(q, c)), 0.0)), i) for i, c, n in told if n != q_n and len(c) == len(q))[:near])
    return out


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (60, 4), np.uint32)
    held = np.concatenate([base] + [base ^ np.uint32(1) << rng.integers(0, 32, (60, 4)).astype(np.uint32) for _ in range(10)])
    held = np.concatenate([held, held[:200]])  # equal codes
    index = hamming.Index(held)
    for radius in (0, 1, 2, 3, 4, 7, 8, 11, 30, 64, 128):
        for code in held[:20]:
            near = np.flatnonzero(hamming.distance(held, code) <= radius)
            assert index.within(code, radius).tolist() == near.tolist()


def test_small_radii_look_words_up():
    held = np.arange(4000, dtype=np.uint32).repeat(4).reshape(-1, 4)
    index = hamming.Index(held)
    for code in held[::997]:
        assert index.within(code, 9).tolist() == np.flatnonzero(hamming.distance(held, code) <= 9).tolist()


def test_neighbours_recall_order_and_scores(spark):
    found = QUERIES["op13_neighbours"](spark, SF).collect()
    given = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    wanted = {q: best for q, best in exact_neighbours([(r["vec_id"], r["embedding"]) for r in given], lambda i: i % 20 == 0).values()}
    own = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        own.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in given}
    hits = sum(len({i for _, i in best} & {i for *_, i in own[q]}) for q, best in wanted.items())
    assert own.keys() == wanted.keys() and hits / sum(map(len, wanted.values())) >= 0.9
    for q, told in own.items():
        assert [r for r, *_ in told] == list(range(1, 21)) and [x[1:] for x in told] == sorted(x[1:] for x in told)
        assert all(-s == float(sum((x * y for x, y in zip(vectors[q], vectors[i])), 0.0)) for _, s, i in told)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(15)]
    rows += [(20, None), (40, [0.0] * 3), (60, [math.nan, 1.0, 1.0]), (80, [1.0, None, 2.0]), (100, [math.inf, 0.0, 1.0]), (None, [1.0, 2.0, 3.0]),
             (120, [1.0, 2.0, 3.0]), (120, [1.0, 2.0, 3.0]), (140, [1.0, 2.0, 3.0]), (160, [3.0, 4.0]), (180, [4.0, 3.0]), (200, [7.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("row", "dim", "id", "vector", "length", "is_query", "score", "rank")])
    found = sorted(map(tuple, hamming.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    wanted = [(q, n + 1, i, -s) for q, best in exact_neighbours(rows, lambda i: i % 20 == 0).values() for n, (s, i) in enumerate(best)]
    assert found == sorted(wanted)  # fewer rows than neighbours asked for: all of them
    assert hamming.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_largest_products_with_unequal_lengths_and_copies(spark, monkeypatch):
    monkeypatch.setattr(grid, "ROWS_BLOCK", 150)
    monkeypatch.setattr(grid, "STATED_BLOCK", 10)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, ((centres[i % 12] + 0.3 * rng.normal(size=16)) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third of the rows are copies
    wanted = exact_neighbours(rows, lambda i: i % 20 == 0)
    found = hamming.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    own = {}
    for r in found:
        own.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len({i for _, i in best} & own[q]) for q, best in wanted.values())
    assert hits / sum(len(b) for _, b in wanted.values()) >= 0.9
