"""Ordered groups cut into chunks of bounded size, without any task seeing a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.sources.scratch import Scratch


def _same(a: DataFrame, columns: Sequence[str], b: DataFrame, prefix: str) -> Column:
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & a[c].eqNullSafe(b[f"{prefix}{i}"])
    return on


def chunked(rows: DataFrame, group: Sequence[str], at: str, item: str, size: int, margin: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most size rows, and those of longer groups (None if there are none), with ``__chunk``, ``__core`` and ``__n``.

    Longer groups are cut, in order of (at, item), into chunks of size rows, numbered from 0. A chunk also gets margin rows of
    each neighbour, with ``__core`` false. ``__n``: the rows of a long group. They are sorted into ranges of the whole order first,
    so that neither a group nor an hour nor one time that very many rows have is any task's whole; ranks are the rows of the ranges before
    and the place within. Nulls are values; a null time comes first. rows is read three times, so give a kept table.
    """
    group = list(group)
    spark = rows.sparkSession
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size)
    plain = {"__chunk": F.lit(0).cast("bigint"), "__core": F.lit(True), "__n": F.lit(None).cast("bigint")}
    if counts.isEmpty():
        return rows.withColumns(plain), None
    long = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(group)], "__n")
    short = rows.join(long, _same(rows, group, long, "__k"), "left_anti").withColumns(plain)
    tie = F.xxhash64(*[c for c in rows.columns if c not in (*group, at, item)])
    many = rows.join(long, _same(rows, group, long, "__k")).drop(*[f"__k{i}" for i in range(len(group))]).withColumn("__tie", tie)
    order = [at, item, "__tie"]
    ranges = many.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id())
    ranges = Scratch(spark, "chunks").keep(ranges, "ranges")
    per_range = ranges.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(group)], F.col("__range").alias("__kr"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*group, "__range").orderBy(*order)
    ranked = ranges.join(bases, _same(ranges, group, bases, "__k") & (ranges["__range"] == bases["__kr"])).withColumn("__r", F.col("__base") + F.row_number().over(within) - 1)
    own, place = F.floor(F.col("__r") / size), F.col("__r") % size
    to = [F.struct(own.alias("c"), F.lit(True).alias("core"))]
    if margin:
        to += [F.struct(F.when(place < margin, own - 1).alias("c"), F.lit(False).alias("core")), F.struct(F.when(place >= size - margin, own + 1).alias("c"), F.lit(False).alias("core"))]
    cut = ranked.withColumn("__to", F.explode(F.array(*to))).where(F.col("__to.c") >= 0).withColumns({"__chunk": F.col("__to.c"), "__core": F.col("__to.core")})
    return short, cut.select(*short.columns)
