"""Components of links: few in one task, many by steps."""

import random

import numpy as np
import pytest

from barline.llm import components


def brute(links):
    least = {n: n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def links_of(seed):
    rng = random.Random(seed)
    chain = [(1000 + i, 1001 + i) for i in range(80)]
    rng.shuffle(chain)
    star = [(5000, 5000 + i) for i in range(1, 30)] + [(-7, 6000 + i) for i in range(10)]
    return [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + chain + star + [(3, 3), (9999, 9999), (None, 4), (5, None), (1 << 62, -(1 << 62))]


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_few_and_many_links_agree_with_loops(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    links = links_of(2)
    made = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(made) == len({r.node for r in made}) and {r.node: r.component for r in made} == brute(links)
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).isEmpty()


def test_few_links_need_no_rounds(spark):
    """A long chain took a round of shuffles for each doubling, which made the pipeline miss its time over many partitions."""
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few links", "few links")
    try:
        made = components.components(links)
        jobs = len(context.statusTracker().getJobIdsForGroup("few links"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component for r in made.collect()} == {0} and made.count() == 3001
    assert jobs <= 6, jobs


def test_least_nodes_of_random_links():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (50, 30), (400, 380), (400, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m) + rng.integers(0, 2, m)
        keep = a != b
        nodes, least = components.least_nodes(a[keep], b[keep])
        assert dict(zip(nodes.tolist(), least.tolist())) == brute(list(zip(a[keep].tolist(), b[keep].tolist())))
