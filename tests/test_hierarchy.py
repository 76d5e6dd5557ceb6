from __future__ import annotations

import random

import pytest

from sedgework.operators import hierarchy

LINK = "graph string, parent string, child string"


def brute(links):
    parent = {}
    for g, p, c in links:
        parent[g, c] = min(p, parent.get((g, c), p))
    nodes = {(g, p) for (g, _), p in parent.items()} | set(parent)
    paths = {}
    for g, v in nodes:
        path, x = [v], v
        while (g, x) in parent and len(path) <= len(nodes) + 1:
            x = parent[g, x]
            path.append(x)
        paths[g, v] = None if len(path) > len(nodes) + 1 else path[::-1]
    return paths


def check(spark, links):
    want = brute(links)
    found = hierarchy.hierarchy(spark.createDataFrame(links, LINK))
    nodes = {(r["graph"], r["node_id"]): r for r in found.nodes().collect()}
    assert set(nodes) == set(want)
    below = {k: 0 for k in want}
    for (g, _), path in want.items():
        for x in (path or [])[:-1]:
            below[g, x] += 1
    for key, path in want.items():
        r = nodes[key]
        if path is None:
            assert (r["root_id"], r["depth"], r["first"], r["n_descendants"]) == ("", -1, None, None)
        else:
            assert (r["root_id"], r["depth"], r["n_descendants"]) == (path[0], len(path) - 1, below[key])
    assert {(r["graph"], r["node_id"]): r["path"] for r in found.paths().collect()} == {k: p for k, p in want.items() if p}
    # intervals: a node's descendants are those whose numbers lie in its interval
    for (g, v), path in want.items():
        if path:
            inside = {k[1] for k, r in nodes.items() if k[0] == g and r["root_id"] == path[0] and r["first"] is not None and nodes[g, v]["first"] < r["first"] <= nodes[g, v]["last"]}
            assert inside == {k[1] for k, p in want.items() if k[0] == g and p and v in p[:-1]}


def test_shapes(spark):
    chain = [("g", f"c{i:02}", f"c{i + 1:02}") for i in range(21)]
    star = [("g", "hub", f"s{i}") for i in range(15)]
    cycle = [("g", "x", "y"), ("g", "y", "z"), ("g", "z", "x"), ("g", "z", "below"), ("g", "below", "deeper"), ("g", "self", "self")]
    check(spark, chain + star + cycle + [("g", "c05", "hub"), ("h", "c01", "c00"), ("g", "c00", "c01"), ("g", "c00", "c01")])


@pytest.mark.parametrize("block", [65_536, 2])
def test_random_forests(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    r = random.Random(block)
    links = [(r.choice("gh"), f"n{r.randrange(max(0, i - 4) if r.random() < 0.7 else 0, i)}", f"n{i}") for i in range(1, 70)]
    links += [("g", "n60", "m1"), ("g", "m1", "m2"), ("g", "m2", "m1")]
    check(spark, links)


def test_several_parents_null_graph_and_empty(spark, rows):
    check(spark, [(None, "b", "c"), (None, "a", "c"), ("g", "a", "c")])
    found = hierarchy.hierarchy(spark.createDataFrame([], LINK))
    assert rows(found.nodes()) == [] and rows(found.paths()) == []


def test_current_links(spark, rows):
    data = [
        (1, "g", "e1", "a", "child", "b"), (2, "g", "e1", "a", " :CHILD ", "c"), (2, "g", "e1", "a", " :CHILD ", "c"), (3, "g", "e2", "a", None, "d"), (4, "g", "e3", "a", "", "e"),
        (5, "g", "e4", "a", "child", "f"), (6, "g", "e4", "a", "knows", "f"), (7, "g", "e5", None, "child", "x"), (8, "g", "e6", "a", ":", "h"), (None, "g", "e7", "a", "child", "i"), (9, "h", "e1", "p", "child", "q"),
    ]
    links = hierarchy.current_links(spark.createDataFrame(data, "seq bigint, graph string, id string, source string, predicate string, target string"))
    assert rows(links) == [("g", "a", "c"), ("g", "a", "d"), ("g", "a", "e"), ("g", "a", "h"), ("g", "a", "i"), ("h", "p", "q")]


@pytest.mark.parametrize("tree, finish, segment", [(3, 0, 1024), (0, 4, 3), (200_000, 1_000_000, 2)])
def test_rounds_and_tasks_give_the_same(spark, monkeypatch, tree, finish, segment):
    """Large trees in rounds, the rest of the ways in one task, and short segments: always the same hierarchy."""
    for name, value in (("TREE", tree), ("FINISH", finish), ("SEGMENT", segment)):
        monkeypatch.setattr(hierarchy, name, value)
    chain = [("g", f"c{i:02}", f"c{i + 1:02}") for i in range(14)]
    side = [("g", "c03", "d1"), ("g", "d1", "d2"), ("g", "d2", "d3"), ("g", "c05", "e1"), ("g", "c05", "e2"), ("h", "a", "b"), ("h", "b", "c"), ("g", "x", "y"), ("g", "y", "x"), ("g", "y", "z"), ("g", "z", "w")]
    check(spark, chain + side)


@pytest.mark.parametrize("block", [65_536, 3])
def test_descendants(spark, rows, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    links = [("g", "a", "b"), ("g", "b", "c"), ("g", "b", "d"), ("g", "a", "e"), ("g", "d", "f"), (None, "a", "b"), ("g", "x", "x")]
    found = hierarchy.hierarchy(spark.createDataFrame(links, LINK))
    want = [("g", a, d, n) for a, below in {"a": {"b": 1, "c": 2, "d": 2, "e": 1, "f": 3}, "b": {"c": 1, "d": 1, "f": 2}, "d": {"f": 1}}.items() for d, n in below.items()] + [(None, "a", "b", 1)]
    assert rows(found.descendants()) == sorted(want, key=str)
    of = spark.createDataFrame([("g", "b"), ("g", "b"), ("g", "c"), ("g", "x"), (None, "a"), ("h", "a")], "graph string, node_id string")
    assert rows(found.descendants(of)) == sorted([x for x in want if x[:2] in (("g", "b"), (None, "a"))], key=str)
