from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from sedgework.operators import orphans

EDGE = "seq bigint, graph string, source string, target string, arrived_at timestamp_ntz, state string"
NODE = "graph string, id string, arrived_at timestamp_ntz, deleted_at timestamp_ntz, state string"
T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def brute(edges, nodes):
    first = {}
    for seq, g, s, t, a, *_ in edges:
        key = (seq, g, s, t)
        first[key] = min((x for x in (first.get(key, a), a)), key=lambda x: (x is not None, x)) if key in first else a
    out = []
    for (seq, g, s, t), a in first.items():
        for side, key in (("source", s), ("target", t)):
            if key is None:
                continue
            own = [n for n in nodes if n[0] == g and n[1] == key]
            come = [n for n in own if n[2] is not None and a is not None and n[2] <= a]
            if any(n[3] is None or n[3] > a for n in come):
                continue
            out.append((seq, side, "missing" if not own else "late" if not come else "deleted"))
    return sorted(out, key=str)


def run(spark, rows, edges, nodes, tasks=None):
    return rows(orphans.orphans(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), tasks), "edge_seq", "side", "reason")


def test_cases(spark, rows):
    nodes = [("g", "a", at(0), None, "x"), ("g", "b", at(5), None, None), ("g", "c", at(0), at(4), None), ("g", "d", at(0), at(2), None), ("g", "d", at(6), None, None), ("h", "z", at(0), None, None)]
    edges = [
        (1, "g", "a", "a", at(0), None), (2, "g", "a", "b", at(4), None), (3, "g", "a", "b", at(5), None), (4, "g", "c", "a", at(4), None), (5, "g", "c", "a", at(3), None),
        (6, "g", "d", "z", at(3), None), (7, "g", "d", None, at(6), None), (8, "g", None, "?", at(9), None), (2, "g", "a", "b", at(8), None), (9, "h", "z", "a", at(1), None),
    ]
    assert run(spark, rows, edges, nodes) == sorted([(2, "target", "late"), (4, "source", "deleted"), (6, "source", "deleted"), (6, "target", "missing"), (8, "target", "missing"), (9, "target", "missing")], key=str)


def test_empty_tables(spark, rows):
    edges = [(1, "g", "a", "b", at(0), None)]
    assert run(spark, rows, edges, []) == [(1, "source", "missing"), (1, "target", "missing")]
    assert run(spark, rows, [], [("g", "a", at(0), None, None)]) == []


def test_nulls(spark, rows):
    nodes = [("g", "a", None, None, None), (None, "n", at(0), None, None), ("g", None, at(0), None, None)]
    edges = [(None, "g", "a", "a", at(1), None), (1, None, "n", "n", at(1), None), (2, "g", "a", "b", None, None)]
    assert run(spark, rows, edges, nodes) == brute(edges, nodes)


@pytest.mark.parametrize("tasks", [2, 12, 600])
def test_against_brute_force(spark, rows, tasks):
    """Also with hot keys cut into slices."""
    r = random.Random(7)
    ids = [f"n{i}" for i in range(12)]
    nodes = [(r.choice("gh"), r.choice(ids), at(b := r.randrange(30)), at(r.choice([None, b - 1, b + r.randrange(12)])), "s") for _ in range(40)]
    edges = []
    for seq in range(250):
        e = (seq, r.choice("gh"), "n0" if r.random() < 0.4 else r.choice([*ids, None, "gone"]), r.choice(ids), at(r.randrange(30)), "s")
        edges.append(e)
        if r.random() < 0.2:
            edges.append((*e[:4], e[4] + timedelta(hours=r.randrange(9)), "t"))
    nodes += [("g", "n0", at(3), at(4), "s"), ("g", "n0", at(8), at(9), "s")]
    edges += [(1000, "g", "n0", "n0", None, "s"), (1001, "g", "n0", "gone", at(3) + timedelta(minutes=30), "s")]
    assert run(spark, rows, edges, nodes, tasks) == brute(edges, nodes)


def test_counts(spark, rows):
    edges = spark.createDataFrame([(1, "g", "a", "b", at(0), None), (2, "g", "a", "b", at(24 * 40), None)], EDGE)
    found = orphans.orphans(edges, spark.createDataFrame([("g", "a", at(0), None, None)], NODE))
    assert rows(orphans.orphan_counts(found)) == [("graph_edge", "2024-01", "target", "missing", 1), ("graph_edge", "2024-02", "target", "missing", 1)]
