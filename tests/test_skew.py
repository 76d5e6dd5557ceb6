from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedgework.operators import skew


@pytest.fixture(scope="module")
def hot(spark):
    """A key with half of all rows, one with a fifth, many with few; null keys and repeated rows."""
    data = [("a", "hot", i % 40) for i in range(500)] + [("a", "warm", i) for i in range(200)] + [("b", f"k{i % 90}", i) for i in range(290)] + [("b", None, 1)] * 10
    return spark.createDataFrame(data, "graph string, key string, item int")


def test_pack_is_even():
    where, load = skew.pack([("x", 10), ("y", 7), ("z", 6), ("w", 5)], 2)
    assert sorted(load) == [13, 15]
    assert set(where) == {"x", "y", "z", "w"}


def test_plan_spreads_heavy_keys(spark, hot):
    plan = skew.plan_loads(hot, ["graph", "key"], 4)
    assert plan.total == 1000
    assert len(plan.heavy) == 2 and max(map(len, plan.heavy.values())) == 4
    assert max(plan.load) <= 1.4 * plan.total / plan.tasks
    placed = skew.placed(hot, plan, F.xxhash64("item"))
    per_task = Counter(r[0] for r in placed.select(F.spark_partition_id()).collect())
    assert sum(per_task.values()) == 1000
    assert max(per_task.values()) < 500
    assert all(r[0] == r[1] for r in placed.select(F.spark_partition_id(), "__task").distinct().collect())


def test_counts_come_from_shards(spark, hot, rows):
    plan = skew.plan_loads(hot, ["graph", "key"], 4)
    counts = skew.shard_counts(hot.repartition(8), plan)
    assert counts.where("key = 'hot'").count() > 1 and counts.where("key = 'k1'").count() == 1
    assert rows(skew.from_shards(counts, plan)) == rows(skew.key_loads(hot, ["graph", "key"]))


def test_planning_is_linear():
    tasks = 4096
    begin = time.perf_counter()
    plan = skew.plan_of(10**9, [(k, 3 * 10**9 // tasks // 2) for k in range(tasks)], ["k"], tasks)
    assert time.perf_counter() - begin < 2
    assert sum(map(len, plan.heavy.values())) <= 4 * tasks and max(plan.load) < 2 * 10**9 / tasks


def test_heavy_keys_by_scope(spark, hot, rows):
    loads = skew.key_loads(hot, ["graph", "key"])
    assert rows(skew.heavy_keys(loads, ["graph"], 0.5), "key", "n_rows") == [("hot", 500)]
    assert rows(skew.heavy_keys(loads, [], 0.15), "key") == [("hot",), ("warm",)]
    assert rows(skew.heavy_keys(loads.limit(0), [], 0.1)) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, hot, rows, how):
    right = spark.createDataFrame([("a", "hot", 1), ("a", "warm", 2), ("b", "k1", 3), ("b", "none", 4), ("a", None, 5)], "graph string, key string, size int")
    plan = skew.plan_loads(hot, ["graph", "key"], 4)
    assert plan.heavy
    got = skew.spread_join(hot, right, plan, F.xxhash64("item"), how).select("graph", "key", "item", "size")
    want = hot.join(right, ["graph", "key"], how).select("graph", "key", "item", "size")
    assert rows(got) == rows(want)


def test_spread_join_rejects_full(spark, hot):
    plan = skew.plan_loads(hot, ["graph", "key"], 2)
    with pytest.raises(ValueError):
        skew.spread_join(hot, hot, plan, F.lit(0), "full")


def test_partial_lists(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "LIST", 15)
    items = skew.distinct_items(hot, ["graph", "key"], "item")
    plan = skew.plan_loads(items, ["graph", "key"], 4)
    lists = skew.partial_lists(items, plan, "item", F.xxhash64("item")).collect()
    found: dict = {}
    for r in lists:
        assert r["items"] == sorted(set(r["items"])) and r["n_items"] == len(r["items"]) <= 15
        assert not found.setdefault(r["key"], set()) & set(r["items"])
        found[r["key"]] |= set(r["items"])
    assert found["hot"] == set(range(40)) and found["warm"] == set(range(200)) and None not in found


def test_empty_input(spark, hot, rows):
    plan = skew.plan_loads(hot.limit(0), ["graph", "key"], 4)
    assert plan.total == 0 and not plan.heavy
    assert rows(skew.placed(hot.limit(0), plan, F.xxhash64("item"))) == []
    assert rows(skew.from_shards(skew.shard_counts(hot.limit(0), plan), plan)) == []
