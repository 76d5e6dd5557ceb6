"""A few keys hold most records: results per key with the work spread evenly.

Fragment and replicate by estimated load. One pass without a shuffle estimates the loads: a sketch of the most frequent
keys. A plan then bin-packs the load into tasks: a key that outweighs half a fair part of a task is cut into
proportionate shards, all lighter keys stay whole in hash bins, and shards and bins go, heaviest first, to the task
that has least. Only keys that were cut have their matching rows replicated, once per shard. Estimates decide where rows go
and nothing else; results are counted.

Keys are known to a plan by a 64-bit hash; two keys of one hash share their shards, which changes no result. What the driver holds,
and what is broadcast, is bounded by the plan and not by the data: of n rows fewer than 2 * tasks keys can have more than n / (2 * tasks)
rows, they have at most 4 * tasks shards, and there are ``BINS_PER_TASK * tasks`` bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS_PER_TASK = 8
#: Counters of the sketch: so many for each task, within these bounds. An estimate is off by at most 4/3 of rows / counters.
COUNTERS_PER_TASK, COUNTERS = 16, (10_000, 1_000_000)
#: Items in one row of a posting list.
LIST = 100_000


def key_loads(df: DataFrame, keys: Sequence[str], count: str = "n_rows") -> DataFrame:
    """Rows of each combination of keys; a null key is a key of its own here, named by null."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def heavy_keys(loads: DataFrame, scope: Sequence[str], share: float, count: str = "n_rows") -> DataFrame:
    """The keys of loads that hold more than a share of the rows of their scope.

    loads: one row per key, as of key_loads. scope: columns within which shares are taken; without
    any, all rows are one scope. Null keys weigh in the total; whether they may come out is the
    caller's to say. At most 1 / share rows come out of each scope. An empty input gives no row.
    """
    scope = list(scope)
    by = scope or ["__all"]
    if not scope:
        loads = loads.withColumn("__all", F.lit(1))
    totals = loads.groupBy(*by).agg(F.sum(count).alias("__total")).select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(by)], "__total")
    same = [loads[c].eqNullSafe(totals[f"__s{i}"]) for i, c in enumerate(by)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    kept = loads.join(totals, on).where(F.col(count) > share * F.col("__total"))
    return kept.drop("__total", "__all", *[f"__s{i}" for i in range(len(by))])


@dataclass
class LoadPlan:
    """Where each key's rows go. heavy: hash of a key -> the tasks of its shards; bins: the task of each hash bin; load: what each task is expected to get."""

    keys: list[str]
    tasks: int
    total: int
    heavy: dict[int, list[int]] = field(default_factory=dict)
    bins: list[int] = field(default_factory=list)
    load: list[int] = field(default_factory=list)

    def cut_frame(self, spark: SparkSession) -> DataFrame:
        """The cut keys, fewer than 2 * tasks rows: ``__key`` (their hash), ``__shards`` and ``__slot``, the number of the first shard's slot."""
        rows, slot = [], len(self.bins)
        for key, at in self.heavy.items():
            rows.append((key, len(at), slot))
            slot += len(at)
        return spark.createDataFrame(rows, "__key bigint, __shards int, __slot int")

    def slot_frame(self, spark: SparkSession) -> DataFrame:
        """``__slot`` and ``__task`` of bins and shards, at most (BINS_PER_TASK + 4) * tasks rows."""
        tasks = [*self.bins, *[t for at in self.heavy.values() for t in at]]
        return spark.createDataFrame(list(enumerate(tasks)), "__slot int, __task int")


def pack(loads: Sequence[tuple[object, int]], tasks: int) -> tuple[dict[object, int], list[int]]:
    """Longest processing time first: each (item, load) to the task that has least so far; the task of each item, the load of each task."""
    heap = [(0, t) for t in range(tasks)]
    where: dict[object, int] = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        now, t = heapq.heappop(heap)
        where[item] = t
        heapq.heappush(heap, (now + load, t))
    return where, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def plan_of(total: int, frequent: Sequence[tuple[int, int]], keys: Sequence[str], tasks: int) -> LoadPlan:
    """A plan from the number of rows and the estimated loads (hash, rows) of the most frequent keys. The rest of the rows is taken to lie evenly in the bins."""
    n_bins = BINS_PER_TASK * tasks
    fair = max(1, total // tasks)
    items: list[tuple[object, int]] = []
    shards: dict[int, int] = {}
    for key, n in frequent:
        n = min(n, total)
        if 2 * n > fair and len(shards) < 2 * tasks:
            shards[key] = min(tasks, -(-2 * n // fair))
            items += [((key, s), -(-n // shards[key])) for s in range(shards[key])]
    rest = max(0, total - sum(n for _, n in items)) // n_bins
    where, load = pack([*items, *[(("bin", b), rest) for b in range(n_bins)]], tasks)
    return LoadPlan(list(keys), tasks, total, {k: [where[k, s] for s in range(n)] for k, n in shards.items()}, [where["bin", b] for b in range(n_bins)], load)


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int) -> LoadPlan:
    """A plan for the rows of df. One pass; one row with fewer than 2 * tasks numbers reaches the driver. Nulls are keys like any others."""
    counters = min(max(COUNTERS[0], COUNTERS_PER_TASK * tasks), COUNTERS[1])
    most = min(2 * tasks, counters)
    found = df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {counters})").alias("top")).first()
    return plan_of(found["n"], [(r["item"], r["count"]) for r in found["top"] or []], keys, tasks)


def with_shards(df: DataFrame, plan: LoadPlan, spread_by: Column) -> DataFrame:
    """Add ``__shard`` (0 for keys that weren't cut), ``__cut`` and ``__task``. spread_by: a hash that tells a heavy key's rows apart."""
    spark, key = df.sparkSession, F.xxhash64(*plan.keys)
    marked = df.withColumn("__key", key).join(F.broadcast(plan.cut_frame(spark)), "__key", "left")
    marked = marked.withColumns({"__cut": F.col("__shards").isNotNull(), "__shard": F.coalesce(F.pmod(spread_by, F.col("__shards")).cast("int"), F.lit(0))})
    return _to_task(marked, plan)


def replicated(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: rows of cut keys once per shard, all others once, with ``__shard`` and ``__task``."""
    marked = df.withColumn("__key", F.xxhash64(*plan.keys)).join(F.broadcast(plan.cut_frame(df.sparkSession)), "__key", "left")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("__shards"), F.lit(1)) - 1)
    return _to_task(marked.withColumn("__shard", F.explode(copies)), plan)


def _to_task(marked: DataFrame, plan: LoadPlan) -> DataFrame:
    slot = F.coalesce(F.col("__slot") + F.col("__shard"), F.pmod(F.col("__key"), F.lit(len(plan.bins))).cast("int"))
    return marked.withColumn("__slot", slot).join(F.broadcast(plan.slot_frame(marked.sparkSession)), "__slot").drop("__slot", "__key", "__shards")


def placed(df: DataFrame, plan: LoadPlan, spread_by: Column) -> DataFrame:
    """df with every row in the task that the plan gives it; columns ``__shard``, ``__cut`` and ``__task`` added."""
    return with_shards(df, plan, spread_by).repartitionById(plan.tasks, F.col("__task"))


def shard_counts(df: DataFrame, plan: LoadPlan, count: str = "n_rows") -> DataFrame:
    """Rows of each key and shard: keys, ``__shard``, ``__cut`` and count. The rows that a map task has of a heavy key are summed there and are one shard's."""
    own = F.xxhash64(F.spark_partition_id())
    return with_shards(df, plan, own).groupBy(*plan.keys, "__shard", "__cut").agg(F.count(F.lit(1)).alias(count)).select(*plan.keys, "__shard", "__cut", count)


def from_shards(counts: DataFrame, plan: LoadPlan, count: str = "n_rows") -> DataFrame:
    """Rows of each key out of those of its shards. Only keys that were cut are summed; counts is read twice, so give a kept table."""
    cut = counts.where("__cut").groupBy(*plan.keys).agg(F.sum(count).alias(count))
    return counts.where("not __cut").select(*plan.keys, count).unionByName(cut)


def spread_join(left: DataFrame, right: DataFrame, plan: LoadPlan, spread_by: Column, how: str = "inner") -> DataFrame:
    """left joined to right on the plan's keys, with left's heavy keys cut into shards and right's rows copied to them.

    The join is on (task, keys, shard), each side being in the plan's tasks already, so no task holds more of a heavy key than its shard. right's other
    columns must not clash with left's. Null keys join nothing; with how="left" their rows stay.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join can't do a {how} join")
    own = replicated(right, plan).repartitionById(plan.tasks, F.col("__task"))
    joined = placed(left, plan, spread_by).drop("__cut").join(own, ["__task", *plan.keys, "__shard"], how)
    return joined.drop("__shard", "__task")


def distinct_items(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Each item of each key once, by partial aggregates; rows with a null item or any null key are left out."""
    return df.where(F.col(item).isNotNull()).dropna(subset=list(keys)).select(*keys, item).distinct()


def partial_lists(items: DataFrame, plan: LoadPlan, item: str, spread_by: Column, name: str = "items") -> DataFrame:
    """Postings: for each key its items, sorted, in rows of at most ``LIST`` of them, so that neither a row nor a task holds a whole heavy key.

    items: as of distinct_items. A key's rows are numbered by ``shard`` and ``part``; parts of a shard follow each other in order of item.
    Columns: keys, ``shard``, ``part``, ``n_items``, name.
    """
    by = ["__task", *plan.keys, "__shard"]
    rows = placed(items, plan, spread_by)
    ranked = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(item)) - 1) / LIST).cast("int"))
    lists = ranked.groupBy(*by, "part").agg(F.sort_array(F.collect_list(item)).alias(name))
    return lists.select(*plan.keys, F.col("__shard").alias("shard"), "part", F.size(name).cast("bigint").alias("n_items"), name)
