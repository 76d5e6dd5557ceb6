"""Filling containers of fixed capacity with items, by shortest pack first over the histogram of lengths.

Only the histogram reaches the driver; it has at most as many entries as the capacity. Lengths are placed longest
first. All packs with one content are one pattern with a count, and the items of a length go to the patterns with most room
left, so that a step moves many packs at once. What comes out are patterns and how often each is used.

An item then finds its container by its rank among the items of its length: each pattern takes an interval of
ranks of each of its lengths. Ranks are counted in blocks, so that a length that a third of all items have
is no task's whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.sources.scratch import Scratch

#: Items of one length that are ranked together.
BLOCK = 100_000
#: Patterns are sent to every task. Each length adds at most a few, so their number follows the capacity and not the items.
MOST_BYTES = 512 << 20


@dataclass(frozen=True)
class Pattern:
    """count packs of one content: (length, how many of it) in each."""

    count: int
    content: tuple[tuple[int, int], ...]


def patterns(histogram: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram (length -> items, lengths from 1 to capacity): of the two orders below those of fewer packs.

    Shortest pack first suits corpora of many short items. Where items are long against the capacity, the fullest
    pack that an item fits into can be better, so that is tried as well; both take no longer than the histogram is.
    """
    for length, n in histogram.items():
        if n and not 1 <= length <= capacity:
            raise ValueError(f"an item of {length} can't be placed whole into {capacity}")
    return min((_place(histogram, capacity, shortest) for shortest in (True, False)), key=lambda found: sum(p.count for p in found))


def _place(histogram: Mapping[int, int], capacity: int, shortest: bool) -> list[Pattern]:
    """Lengths from the longest, each into the packs with most room (shortest) or with least that is enough."""
    open_packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    rooms: list[int] = []  # of open_packs, ascending
    done: list[Pattern] = []

    def put(room: int, count: int, content: tuple[tuple[int, int], ...]) -> None:
        if room == 0:
            done.append(Pattern(count, content))
        elif room in open_packs:
            open_packs[room].append((count, content))
        else:
            open_packs[room] = [(count, content)]
            insort(rooms, room)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            at = len(rooms) - 1 if shortest else bisect_left(rooms, length)
            if not 0 <= at < len(rooms) or rooms[at] < length:
                each = capacity // length  # whole packs of this length alone, and one that is not full
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, ((length, each),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            room = rooms[at]
            count, content = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop(at)
            used = min(count, left)
            if used < count:
                put(room, count - used, content)
            grown = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
            put(room - length, used, grown)
            left -= used
    return done + [Pattern(n, c) for packs in open_packs.values() for n, c in packs]


def _intervals(found: list[Pattern]) -> dict[str, np.ndarray]:
    """Sorted by (length, first rank): which ranks of each length lie in which containers."""
    rows, taken, container = [], {}, 0
    for p in found:
        for length, each in p.content:
            first = taken.get(length, 0)
            rows.append((length, first, each, container))
            taken[length] = first + each * p.count
        container += p.count
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": columns[:, 0], "first": columns[:, 1], "each": columns[:, 2], "container": columns[:, 3]}


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, part, first_token, n_tokens: an item for each document that fits, and capacity-sized pieces with a rest of one that doesn't."""
    last = F.ceil(F.col("n_tokens") / capacity) - 1
    cut = sizes.where(F.col("n_tokens") > 0).select("doc_id", F.col("n_tokens").alias("__n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("part"))
    first = F.col("part") * capacity
    return cut.select("doc_id", F.col("part").cast("int").alias("part"), first.alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - first).alias("n_tokens"))


def packed(sizes: DataFrame, capacity: int, scratch: Scratch | None = None, label: str = "items") -> DataFrame:
    """Put the documents of sizes (doc_id, n_tokens) into containers: container_id, doc_id, part, first_token, n_tokens.

    Every document with tokens comes out once and whole (part 0), but one larger than the capacity, which comes out in parts.
    Documents without tokens, or with a null number, don't come out. Repeated rows are items of their own. container_id counts from 0
    without gaps. sizes is read twice, so give a kept table. Empty sizes give no rows.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    items = pieces(sizes, capacity)
    histogram = {r[0]: r[1] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}
    found = _intervals(patterns(histogram, capacity))
    # a row for each length of more than BLOCK items, so at most ``capacity`` rows, whatever the number of items
    blocks_of = spark.createDataFrame([(k, -(-n // BLOCK)) for k, n in histogram.items() if n > BLOCK], "n_tokens bigint, n_blocks bigint")
    blocked = items.join(F.broadcast(blocks_of), "n_tokens", "left")
    placed = scratch.keep(blocked.select(*items.columns, F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("n_blocks", F.lit(1).cast("bigint"))).alias("block")), label)
    totals = placed.groupBy("n_tokens", "block").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("n_tokens", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("n_tokens", "block").orderBy("doc_id", "part")
    ranked = placed.withColumn("own", F.row_number().over(within) - 1).join(bases, ["n_tokens", "block"]).select("doc_id", "part", "first_token", "n_tokens", (F.col("base") + F.col("own")).alias("rank"))
    held = sum(x.nbytes for x in found.values())
    if held > MOST_BYTES:
        raise ValueError(f"the patterns of capacity {capacity} take {held} bytes, more than is sent to every task")
    shared = spark.sparkContext.broadcast(found)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        starts = (table["length"] << 44) | table["first"]
        for batch in batches:
            at = np.searchsorted(starts, (batch["n_tokens"].to_numpy() << 44) | batch["rank"].to_numpy(), side="right") - 1
            container = table["container"][at] + (batch["rank"].to_numpy() - table["first"][at]) // table["each"][at]
            yield batch.drop(columns="rank").assign(container_id=container)[["container_id", "doc_id", "part", "first_token", "n_tokens"]]

    kind = dict(sizes.dtypes)["doc_id"]
    return ranked.mapInPandas(locate, f"container_id bigint, doc_id {kind}, part int, first_token bigint, n_tokens bigint")
