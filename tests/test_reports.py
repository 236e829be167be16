"""Nested records and exact moments of pruning, by hand."""

import itertools
import json
import statistics as pystat

import pytest

from auditloom.operators import reports
from auditloom.operators import statistics as st


def greedy(obj, path):
    cur, parts, i = obj, path.split("."), 0
    while i < len(parts):
        if isinstance(cur, list):
            if not parts[i].isdigit() or int(parts[i]) >= len(cur):
                return None
            cur, i = cur[int(parts[i])], i + 1
            continue
        if not isinstance(cur, dict):
            return None
        for j in range(len(parts), i, -1):
            if ".".join(parts[i:j]) in cur:
                cur, i = cur[".".join(parts[i:j])], j
                break
        else:
            return None
    return cur


RECORDS = {
    1: {"a": {"b": 1, "b.c": {"d": 2}, "b": {"c": {"d": 3}}}, "a.b": {"x": None}, "l": [1, [True, {"k.k": "v"}], {}]},
    2: {"a.b.c": 5, "a": {"b": {"c": 6}}}, 3: {"a.b": 7, "a": {"b": {"c": 8}}}, 4: [], 5: {}, 6: {"x": [], "y": {"z": "é \" \n"}}, 7: 3,
}
PATHS = ["a.b", "a.b.c", "a.b.c.d", "a.b.x", "l.0", "l.1.0", "l.1.1.k.k", "l.3", "l", "x", "y.z", "a", "nothing"]


def test_greedy_paths(spark):
    d = spark.createDataFrame([(i, json.dumps(o)) for i, o in RECORDS.items()] + [(8, "not json"), (9, None)], "id int, json string")
    got = {(r.key, r.path): r.value for r in reports.get(d, "id", PATHS).collect()}
    assert len(got) == 9 * len(PATHS)
    for (i, p), v in got.items():
        want = greedy(RECORDS[i], p) if i < 8 else None
        found = None if v is None else json.loads(v)
        assert found == want, (i, p)


def test_flatten(spark):
    d = spark.createDataFrame([(1, json.dumps(RECORDS[1])), (6, json.dumps(RECORDS[6])), (9, None), (8, "{")], "id int, json string")
    got = sorted((r.key, r.metric, json.loads(r.value)) for r in reports.flatten(d, "id").where("metric <> 'a.b.x'").collect())
    assert got == [(1, "a.b.c.d", 2), (1, "a.b.c.d", 3), (6, "y.z", "é \" \n")]
    lists = {(r.key, r.metric): json.loads(r.value) for r in reports.flatten(d, "id", lists=True).collect()}
    assert lists[1, "l.0"] == 1 and lists[1, "l.1.0"] is True and lists[1, "l.1.1.k.k"] == "v" and lists[1, "a.b.x"] is None


@pytest.mark.parametrize("notes", [[(3, 2, 2, 4), (2, 0, 1, 1), (0, 0, 3, 2)], [(4, 4, 2, 4)], [(1, 1, 0, 1), (4, 1, 9, 3)]])
def test_pruning_moments_by_enumeration(spark, notes):
    """Every choice of every note, all equally likely."""
    each = []
    for s, h, k, _ in notes:
        codes = [1] * h + [0] * (s - h)
        each.append([sum(c) for c in itertools.combinations(codes, min(k, s))])
    emitted, gold = sum(min(k, s) for s, _, k, _ in notes), sum(n[3] for n in notes)
    f = [2 * sum(c) / (emitted + gold) for c in itertools.product(*each)]
    r = st.pruning_nulls(spark.createDataFrame(notes, "shortlist int, hits int, budget int, gold int")).first()
    assert (r.notes, r.emitted) == (len(notes), emitted)
    assert abs(r.random_f1 - pystat.fmean(f)) < 1e-12 and abs(r.random_std - pystat.pstdev(f)) < 1e-12 and abs(r.oracle_f1 - max(f)) < 1e-12


def test_paths_are_looked_up_in_place(spark):
    """Records aren't shuffled, and those with equal keys keep to themselves; keys that are empty or end with a dot are keys too."""
    d = spark.createDataFrame([(1, '{"a": 1}'), (1, '{"a": {"b": [5, {"c": null}]}}'), (2, '{"": {"a": 3}, "a.": {"b": 4}, "a": "x"}'), (3, "no json"), (4, None)], "id int, json string")
    found = reports.get(d, "id", ["a", "a.b.0", "a.b.1.c", ".a", "a..b"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.key, r.path, r.value) for r in found.collect() if r.value is not None)
    assert got == [(1, "a", "1"), (1, "a", '{"b":[5,{"c":null}]}'), (1, "a.b.0", "5"), (1, "a.b.1.c", "null"), (2, ".a", "3"), (2, "a", '"x"'), (2, "a..b", "4")]
    assert found.count() == 25
