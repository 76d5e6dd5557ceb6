"""References to records that do not exist, are deleted, or arrive later.

Parent and child keys are put into one long form, tagged, and grouped by (table, key): that
one aggregation, whose partial sums leave one row per key and map task, tells the keys that no
parent answers and those whose parents cover every child. References to keys without parent are cases as they are. Only
those of the keys in between need times compared; they are swept in order of time against their parents' lifetimes, a
hot key hour by hour, each hour beginning with what was alive before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.operators.changes import offset_of
from sedgework.sources.scratch import Scratch

#: Slices that a hot key is swept in, in microseconds.
HOUR = 3_600_000_000


def references(edges: DataFrame) -> DataFrame:
    """The non-null endpoints of edges in long form: seq, graph, key, side, at (arrival of the delivery)."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("key")) for s in ("source", "target")])
    long = edges.select("seq", "graph", F.col("arrived_at").alias("at"), F.explode(sides).alias("r"))
    return long.select("seq", "graph", F.col("r.key").alias("key"), F.col("r.side").alias("side"), "at").where(F.col("key").isNotNull())


def lifetimes(nodes: DataFrame) -> DataFrame:
    """When each (graph, key) can be referred to: from ``born`` up to, not including, ``died`` (null: still).

    Rows of one key with one deletion time differ only in arrival, so the earliest stands for all.
    """
    named = nodes.select("graph", F.col("id").alias("key"), F.col("arrived_at").alias("born"), F.col("deleted_at").alias("died"))
    return named.groupBy("graph", "key", "died").agg(F.min("born").alias("born"))


def key_states(edges: DataFrame, nodes: DataFrame, hot_from: int) -> DataFrame:
    """One row per referenced (graph, key) that some reference may miss, ``state`` being ``missing`` (no parent at all) or ``check``, with ``first_born`` and ``hot``.

    hot: the key has more than hot_from references. Other keys whose earliest parent arrived before all children and was
    never deleted are good for every reference and are left out; hot ones of them have a null state.
    """
    none = F.lit(None)
    child = references(edges).select("graph", "key", F.lit(1).alias("c"), F.col("at").alias("c_at"), none.cast("timestamp_ntz").alias("p_at"), F.lit(0).alias("p"), F.lit(0).alias("d"))
    parent = nodes.select("graph", F.col("id").alias("key"), F.lit(0).alias("c"), none.cast("timestamp_ntz").alias("c_at"), F.col("arrived_at").alias("p_at"), F.lit(1).alias("p"), F.col("deleted_at").isNotNull().cast("int").alias("d"))
    keys = child.unionByName(parent).groupBy("graph", "key").agg(
        F.sum("c").alias("children"), F.min("c_at").alias("first_ref"), F.min("p_at").alias("first_born"), F.max("p").alias("p"), F.max("d").alias("d"),
        F.sum(F.when((F.col("c") == 1) & F.col("c_at").isNull(), 1).otherwise(0)).alias("undated"),
    )
    state = F.when(F.col("p") == 0, "missing").when((F.col("d") == 1) | F.col("first_born").isNull() | (F.col("first_born") > F.col("first_ref")) | (F.col("undated") > 0), "check")
    kept = keys.where(F.col("children") > 0).select("graph", "key", state.alias("state"), "first_born", (F.col("children") > hot_from).alias("hot"))
    return kept.where(F.col("state").isNotNull() | F.col("hot"))


def orphans(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every reference of edges that has no living node when the edge first arrives.

    edges: seq, graph, source, target, arrived_at. nodes: graph, id, arrived_at, deleted_at. Other
    columns are ignored. Columns out: edge_seq, side, reason, arrived_at (the seq's first arrival).

    ``missing``: no node row of that (graph, id); ``late``: rows, but none arrived by then; ``deleted``:
    all that had arrived were deleted by then. A reference is good at the very moment its node arrives,
    and no more at the moment of deletion. Null endpoints are no references. Re-deliveries of a seq
    count once, at the first; edges without seq are told apart by their key and side only. An edge without
    arrival time is judged as arriving before everything, a null graph is a graph of its own, a
    node without arrival time never arrives. Empty tables are allowed: without nodes all are missing.
    tasks: those that the work is spread over, by default as many as the session shuffles into; a key with more than a task's part is hot.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "orphans")
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot_from = 2 * edges.count() // tasks
    states = scratch.keep(key_states(edges, nodes, hot_from), "states")
    # of 2n references fewer than ``tasks`` keys can have more than 2n / tasks
    hot = states.where("hot").select(F.col("graph").alias("hg"), F.col("key").alias("hk"), F.col("state").alias("h_state"), F.col("first_born").alias("h_born"), F.lit(True).alias("is_hot"))
    refs = references(edges)
    marked = refs.join(F.broadcast(hot), refs["graph"].eqNullSafe(hot["hg"]) & (refs["key"] == hot["hk"]), "left")
    of_hot = marked.where(F.col("is_hot") & F.col("h_state").isNotNull()).select("graph", "key", "seq", "side", "at", F.col("h_state").alias("state"), F.col("h_born").alias("first_born"))
    others = marked.where(F.col("is_hot").isNull()).select("graph", "key", "seq", "side", "at")
    cold = states.where("not hot").select(F.col("graph").alias("sg"), F.col("key").alias("sk"), "state", "first_born")
    of_cold = others.join(cold, others["graph"].eqNullSafe(cold["sg"]) & (others["key"] == cold["sk"])).select(*of_hot.columns)
    once = [r.groupBy("graph", "key", "seq", "side", "state", "first_born").agg(F.min("at").alias("at")).withColumn("hot", F.lit(h)) for r, h in ((of_cold, False), (of_hot, True))]  # state and first_born are the key's
    once = scratch.keep(once[0].unionByName(once[1]), "once")

    missing = once.where("state = 'missing'").select(F.col("seq").alias("edge_seq"), "side", F.col("state").alias("reason"), F.col("at").alias("arrived_at"))
    late = F.coalesce(F.col("first_born") > F.col("at"), F.lit(True))
    swept = _swept(once.where("state = 'check'"), lifetimes(nodes), states.where("state = 'check'").select("graph", "key", "hot"))
    return missing.unionByName(swept.select(F.col("seq").alias("edge_seq"), "side", F.when(late, "late").otherwise("deleted").alias("reason"), F.col("at").alias("arrived_at")))


def _swept(refs: DataFrame, lives: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of refs at whose time nothing of lives is alive. Each key is swept in order of time, a hot one in slices of an hour."""
    named = keys.select(F.col("graph").alias("kg"), F.col("key").alias("kk"), "hot")
    own = lives.where(F.col("died").isNull() | (F.col("died") > F.col("born"))).join(named, F.col("graph").eqNullSafe(F.col("kg")) & (F.col("key") == F.col("kk")))
    turns = F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("step")), F.struct(F.col("died").alias("at"), F.lit(-1).alias("step")))
    hour = F.when(F.col("hot"), F.floor(offset_of("at", dict(refs.dtypes)["at"]) / F.lit(HOUR)))
    turns = own.select("graph", "key", "hot", F.inline(turns)).where(F.col("at").isNotNull()).withColumn("slice", hour)
    refs = refs.withColumn("slice", hour)

    hours = turns.where("hot").select("graph", "key", "slice", "step").unionByName(refs.where("hot and slice is not null").select("graph", "key", "slice", F.lit(0).alias("step")))
    before = Window.partitionBy("graph", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = hours.groupBy("graph", "key", "slice").agg(F.sum("step").alias("step")).withColumn("step", F.coalesce(F.sum("step").over(before), F.lit(0)))

    turn = lambda rows, at, place: rows.select("graph", "key", "slice", at.alias("at"), F.lit(place).alias("place"), F.col("step").cast("bigint").alias("step"))
    events = refs.select("graph", "key", "slice", "at", F.lit(2).alias("place"), F.lit(0).cast("bigint").alias("step"), "seq", "side", "first_born")
    events = events.unionByName(turn(turns, F.col("at"), 1), allowMissingColumns=True).unionByName(turn(begun, F.lit(None).cast(dict(refs.dtypes)["at"]), 0), allowMissingColumns=True)
    so_far = Window.partitionBy("graph", "key", "slice").orderBy(F.col("place") > 0, F.col("at").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("alive", F.sum("step").over(so_far)).where((F.col("place") == 2) & (F.col("alive") <= 0))


def orphan_counts(found: DataFrame, table_name: str = "graph_edge") -> DataFrame:
    """Cases of orphans() summed per table, month of arrival, side and reason; cases without arrival have a null period."""
    period = F.date_format("arrived_at", "yyyy-MM")
    return found.groupBy(F.lit(table_name).alias("table_name"), period.alias("period"), "side", "reason").agg(F.count(F.lit(1)).alias("n_references"))
