"""Exact resampling: draws with replacement over buckets and cells, and runs aligned by one shuffle."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import statistics as st


@pytest.mark.parametrize("m", [[1] * 6, [100, 300, 50, 550], [7]])
def test_draws_have_the_multinomial_distribution(m):
    m = np.array(m)
    n = np.full(20_000, 30)
    x = st.draws_of(n, m, np.random.default_rng(1))
    p = m / m.sum()
    assert (x.sum(1) == 30).all()
    assert np.abs(x.mean(0) - 30 * p).max() < 0.1
    want = 30 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(x.T) - want).max() < 0.25


@pytest.mark.parametrize("a_bucket", [4096, 9])
def test_weights_sum_to_the_notes(spark, monkeypatch, a_bucket):
    """Over one bucket and over many: every replicate draws as many notes as there are, and moments are those of n draws."""
    monkeypatch.setattr(st, "CELLS_A_BUCKET", a_bucket)
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), rng.randrange(4)) for i in range(300)] + [(1000 + i, 50, 1) for i in range(200)]
    d = spark.createDataFrame(rows, "note long, x long, y long")
    got = st.resample(d, 4000, 3).toPandas()
    assert len(got) == 4000 and (got.drawn == 500).all()
    x, y = (np.array([r[k] for r in rows]) for k in (1, 2))
    assert abs(got.x.mean() / x.sum() - 1) < 0.01 and abs(got.x.var() / (500 * x.var()) - 1) < 0.1
    assert abs(np.cov(got.x, got.y)[0, 1] / (500 * np.cov(x, y)[0, 1]) - 1) < 0.15
    again = st.resample(st.cells_of(d.repartition(7)), 4000, 3).toPandas().sort_values("rep")
    assert (again.x.to_numpy() == got.sort_values("rep").x.to_numpy()).all()


def test_swaps_move_whole_notes(spark):
    rows = [(i, 3, 1) for i in range(40)] + [(100 + i, i, 2 * i) for i in range(20)]
    d = spark.createDataFrame(rows, "note long, a long, b long")
    got = st.resample(d, 3000, 3, [(["a"], ["b"])]).toPandas()
    both = sum(r[1] + r[2] for r in rows)
    assert (got.a + got.b == both).all() and (got.drawn == 60).all()
    assert abs(got.a.mean() - both / 2) < 0.7 and abs(got.a.var() / sum((r[1] - r[2]) ** 2 / 4 for r in rows) - 1) < 0.1


def test_swaps_draw_differences_not_notes(spark):
    """A randomised replicate's work follows the different differences of one swap, not the different notes: 4,000 notes, all different, have 3 and 2."""
    rows = [(i, i, i + i % 3 - 1, 2 * i, 2 * i + 5 * (i % 2)) for i in range(4000)]
    d = spark.createDataFrame(rows, "note long, a long, b long, c long, e long")
    swaps = [(["a"], ["b"]), (["c"], ["e"])]
    moves = {(r["_s"], r["_d0"]): r.m for r in st.differences(st.cells_of(d), swaps).collect()}
    assert moves == {(0, -1): 1334, (0, 1): 1333, (1, 5): 2000}
    got = st.resample(d, 3000, 3, swaps).toPandas()
    assert len(got) == 3000 and (got.drawn == 4000).all() and (got.a + got.b == sum(r[1] + r[2] for r in rows)).all() and (got.c + got.e == sum(r[3] + r[4] for r in rows)).all()
    assert abs(got.a.var() / (2667 / 4) - 1) < 0.1 and abs(got.c.var() / (25 * 2000 / 4) - 1) < 0.1 and abs(np.corrcoef(got.a, got.c)[0, 1]) < 0.07
    still = st.resample(d.select("note", "a", F.col("a").alias("b")), 50, 3, [(["a"], ["b"])]).toPandas()
    assert len(still) == 50 and (still.a == sum(range(4000))).all()


def test_resample_of_no_notes(spark):
    d = spark.createDataFrame([], "note long, x long")
    assert st.resample(d, 5, 1).where("drawn <> 0 or x <> 0").collect() == []


def test_aligned_runs(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice("ABCD"), rng.randrange(8)) for n in range(50) for _ in range(rng.randrange(5))] + [(n, None, 0) for n in range(50)]
    got = st.aligned(spark.createDataFrame(rows, "note int, code string, mask int"), ["x", "y"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(note") == 1
    pairs = collections.defaultdict(int)
    for n, c, m in rows:
        pairs[n, c] |= m
    for r in got.collect():
        own = [m for (n, _), m in pairs.items() if n == r.note]
        want = [r.note, np.bitwise_or.reduce(own)]
        for k in (1, 2):
            want += [sum(m & 1 and m >> k & 1 for m in own), sum(not m & 1 and m >> k & 1 for m in own), sum(m & 1 and not m >> k & 1 for m in own)]
        assert list(r) == want
    assert got.count() == 50
