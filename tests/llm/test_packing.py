from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedgework.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_patterns_use_the_histogram(histogram):
    found = packing.patterns(histogram, 64)
    used: Counter = Counter()
    for p in found:
        assert p.count > 0 and sum(k * n for k, n in p.content) <= 64
        for length, each in p.content:
            used[length] += each * p.count
    assert used == Counter({k: n for k, n in histogram.items() if n})
    # never two packs that would fit into one, as each item goes where room is
    rooms = sorted(64 - sum(k * n for k, n in p.content) for p in found for _ in range(min(2, p.count)))
    assert sum(r >= 32 for r in rooms) <= 1


def test_too_long_an_item():
    with pytest.raises(ValueError):
        packing.patterns({65: 1}, 64)


@pytest.fixture(scope="module")
def sizes(spark):
    data = [(i, (i * 7919) % 150) for i in range(800)] + [(9000 + i, 33) for i in range(400)] + [(5, 33), (5, 33), (None, 10), (7000, None), (7001, 0), (7002, 1000), (7003, 128), (7004, 129)]
    return spark.createDataFrame([(d, n, "x") for d, n in data], "doc_id bigint, n_tokens bigint, container_id string")


@pytest.mark.parametrize("block", [100_000, 7])
def test_packed(sizes, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    found = packing.packed(sizes, 128).collect()
    fill = Counter()
    for r in found:
        fill[r["container_id"]] += r["n_tokens"]
    assert max(fill.values()) <= 128 and set(fill) == set(range(len(fill)))
    want = [(r["doc_id"], r["n_tokens"]) for r in sizes.collect() if r["n_tokens"]]
    whole = [(r["doc_id"], r["n_tokens"]) for r in found if r["part"] == 0 and r["n_tokens"] < 128]
    assert Counter(x for x in want if x[1] < 128) == Counter(whole)
    for doc, n in want:
        if n >= 128:
            parts = sorted((r["part"], r["first_token"], r["n_tokens"]) for r in found if r["doc_id"] == doc)
            if sum(d == doc for d, _ in want) == 1:
                assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [128 * i for i in range(len(parts))]
    assert len(fill) <= first_fit([n for _, n in want], 128)


def first_fit(lengths, capacity):
    """Packs that first fit decreasing needs, item by item."""
    rooms: list[int] = []
    for n in lengths:
        rooms += [0] * (n // capacity)
    for n in sorted((n % capacity for n in lengths), reverse=True):
        if n:
            for i, room in enumerate(rooms):
                if room >= n:
                    rooms[i] -= n
                    break
            else:
                rooms.append(capacity - n)
    return len(rooms)


def test_capacity_and_empty(sizes, spark):
    with pytest.raises(ValueError):
        packing.packed(sizes, 0)
    assert packing.packed(sizes.limit(0), 16).collect() == []
    one = packing.packed(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), 2)
    assert sorted((r["part"], r["first_token"], r["n_tokens"]) for r in one.collect()) == [(0, 0, 2), (1, 2, 2), (2, 4, 1)]
