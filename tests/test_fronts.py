"""Fronts of all points against peeling."""

import random

import pytest

from auditloom.operators import search


def peel(rows):
    left, out, i = dict(rows), {}, 0
    while left:
        top = {k for k, p in left.items() if not any(search.dominates(q, p) for q in left.values())}
        out |= dict.fromkeys(top, i)
        left = {k: p for k, p in left.items() if k not in top}
        i += 1
    return out


@pytest.mark.parametrize(("block", "chain"), [(2048, False), (31, False), (40, True)])
def test_every_point_has_its_front(spark, block, chain):
    rng = random.Random(block)
    rows = {i: [i // 2, i // 2, 0] if chain else [rng.randrange(9), rng.random(), rng.randrange(4)] for i in range(90)}  # a chain has more fronts than blocks
    rows |= {200: [1.0, 0.5, 2.0], 201: [1.0, 0.5, 2.0]}
    d = spark.createDataFrame([(k, *map(float, p)) for k, p in rows.items()] + [(300, None, 0.0, 0.0), (301, float("nan"), 0.0, 0.0)], "k int, a double, b double, c double")
    want = peel(rows | {300: [float("inf"), 0, 0], 301: [float("inf"), 0, 0]})
    got = search.fronts(d, ["a", "b", "c"], "k", block=block)
    assert {r.k: r.front for r in got.collect()} == want and got.columns == ["k", "a", "b", "c", "front"]


def test_fronts_of_nothing(spark):
    assert search.fronts(spark.createDataFrame([], "k int, a double"), ["a"], "k").collect() == []
