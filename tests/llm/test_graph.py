"""Connected components against a plain union of sets."""

import random

import pytest

from concord.llm import graph


def _roots(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    return {x: find(x) for x in up}


@pytest.mark.parametrize("links_per_task", [200_000, 0])
def test_components_in_one_task_and_in_many(spark, monkeypatch, links_per_task):
    monkeypatch.setattr(graph, "LINKS_PER_TASK", links_per_task)
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]  # some twice, some of a node to itself
    links += [(1000 + i, 1001 + i) for i in range(20)] + [(2000, 2001 + i) for i in range(50)]
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r.node: r.root for r in found.collect()}
    assert found.count() == len(got)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root for x, root in _roots(links).items() if x in linked}


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()
