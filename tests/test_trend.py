import math
import random
from statistics import median

import pytest

from concord.operators.trend import run_trends

RUNS = "comparison string, timestamp string, run_id string, failed bigint"


def plain(values):
    n = len(values)
    slope = median((values[j] - values[i]) / (j - i) for i in range(n) for j in range(i + 1, n))
    sign = lambda x: (x > 0) - (x < 0)
    sums = [abs(sum(sign(b - a) for a in values[:k] for b in values[k:])) for k in range(1, n)]
    most = max(sums)
    k = sums.index(most) + 1
    return slope, k if most else None, min(1.0, 2 * math.exp(-6 * most**2 / (n**3 + n**2)))


def history(spark, talks):
    rows = [(c, f"2026-{i:04}", f"{c}-{i}", v) for c, values in talks.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, RUNS).repartition(3)


def test_trends_equal_plain_ones(spark):
    rng = random.Random(5)
    talks = {f"c{i}": [rng.randint(0, 6) + (i % 3) * j for j in range(rng.randint(8, 40))] for i in range(12)}
    for r in run_trends(history(spark, talks)).collect():
        values = talks[r.comparison]
        slope, k, p = plain(values)
        assert r.runs == len(values) and r.slope == pytest.approx(slope) and r.p_value == pytest.approx(p)
        assert r.change_run_id == (None if k is None else f"{r.comparison}-{k}") and r.changed == (p <= 0.01)
        assert k is None or r["shift"] == pytest.approx(median(values[k:]) - median(values[:k]))


def test_planted_jump_and_short_history(spark):
    rng = random.Random(6)
    jump = [rng.randint(0, 5) + (50 if j >= 17 else 0) for j in range(30)]
    found = {r.comparison: r for r in run_trends(history(spark, {"jump": jump, "still": [4] * 20, "short": [1, 90, 3]})).collect()}
    assert found["jump"].change_run_id == "jump-17" and found["jump"].changed and found["jump"]["shift"] > 40
    assert (found["still"].slope, found["still"].change_at, found["still"].changed) == (0, None, False)
    assert found["short"].runs == 3 and found["short"][2:] == (None,) * 6


def test_odd_runs_do_not_bend_the_slope(spark):
    values = [2 * j for j in range(40)]
    values[5], values[20] = 10_000, -10_000
    assert run_trends(history(spark, {"c": values})).first().slope == 2


def test_last_runs_only(spark):
    values = [1000] * 50 + [3 * j for j in range(20)]
    found = run_trends(history(spark, {"c": values}), last=20).first()
    assert (found.runs, found.slope) == (20, 3)


def test_odd_rows(spark):
    rows = [(None, "t1", "a", 1), (None, "t1", "a", 1), (None, None, None, 2), ("gone", "t", "r", None), ("x", "t", "r", 5), ("x", "t2", "r", None)]
    found = {r.comparison: r for r in run_trends(spark.createDataFrame(rows, RUNS), least=2).collect()}
    assert set(found) == {None, "x"} and found[None].runs == 3 and found["x"].runs == 1 and found["x"].slope is None
    assert run_trends(spark.createDataFrame([], RUNS)).isEmpty()
    with pytest.raises(ValueError, match="history side"):
        run_trends(spark.range(1))
    with pytest.raises(ValueError, match="at least two"):
        run_trends(spark.createDataFrame([], RUNS), least=1)
