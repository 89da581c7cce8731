"""Known edits of a table must come back as exactly those findings."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators.hashing import compare_by_hash
from concord.operators.rows import category_counts, compare_rows


@pytest.mark.parametrize("seed", range(4))
def test_perturbed_table(spark, seed):
    rng = random.Random(seed)
    keys = [*range(400), None]
    rows = {k: (rng.choice([None, rng.randint(0, 9)]), rng.choice(["a", "b", None, ""])) for k in keys}
    edited, dropped, doubled = (set(rng.sample(keys, 30)) for _ in range(3))
    edited -= dropped | doubled
    doubled -= dropped
    source = [(k, *v) for k, v in rows.items()]
    target = [(k, (n or 0) + 1, t) if k in edited else (k, n, t) for k, n, t in source if k not in dropped]
    target += [(k, *rows[k]) for k in doubled]
    target += [(k, 1, "new") for k in range(1000, 1007)]
    rng.shuffle(target)
    s, t = (spark.createDataFrame(d, "k int, n int, t string") for d in (source, target))
    mapping = [("n", "n"), ("t", "t")]
    compared = compare_rows(s, t, ["k"], mapping)
    counts = {r.category: r.findings for r in category_counts(compared).collect()}
    assert counts == {
        "matching": len(keys) - len(edited) - len(dropped) - len(doubled),
        "matched-key-differing-values": len(edited),
        "missing-from-target": len(dropped),
        "missing-from-source": 7,
        "duplicate-in-target": 2 * len(doubled),
    }
    hashed = compare_by_hash(s, t, "row", ["n", "t"], ["k"]).mismatches
    found = {r.k for r in hashed.collect()}
    assert found == edited | dropped | doubled | set(range(1000, 1007))
    ranges = compare_by_hash(s, t, "key-range", ["n", "t"], ["k"], range_size=10).mismatches.collect()
    wrong = {k for k in found if k is not None}
    all_keys = sorted({k for k in [*keys, *range(1000, 1007)] if k is not None})
    buckets = [all_keys[i : i + 10] for i in range(0, len(all_keys), 10)]
    bounds = [(b[0], b[-1]) for b in buckets if wrong & set(b)] + [(None, None)] * (None in found)
    assert sorted(map(repr, ((r.range_start, r.range_end) for r in ranges))) == sorted(map(repr, bounds))
    columns = compare_by_hash(s.where(F.col("k") < 0), t, "column", ["n"], ["k"]).mismatches
    assert columns.isEmpty()
