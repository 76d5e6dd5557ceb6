"""Queries of the general data-preparation operators, p1 to p6, over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions.text import one_spelling
from sedgework.operators import changes, drift, hierarchy, indexes, orphans, skew, spikes
from sedgework.sources.scratch import Scratch
from sedgework.sources.tables import table

HEAVY_SHARE = 0.03


def p1_cases(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphans(table(spark, root, "graph_edge"), table(spark, root, "graph_node"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_cases(spark, root).select("edge_seq", "side", "reason")


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_counts(p1_cases(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return changes.changed_per_run(table(spark, root, "stored_document"), table(spark, root, "run_log"))


def p2_capture(spark: SparkSession, root: str) -> DataFrame:
    """The same rows from the running job, batch after batch, with every failed run broken off at some step."""
    return changes.capture_runs(table(spark, root, "stored_document"), table(spark, root, "run_log"), f"{Scratch(spark, 'p2').root}/capture")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.changes(table(spark, root, "bench_file")).select("file_id", "field_name", "change_kind")


def p3_table(spark: SparkSession, root: str) -> DataFrame:
    """All result files in one table."""
    return drift.unified(table(spark, root, "bench_file"))


def p3_complete(spark: SparkSession, root: str) -> DataFrame:
    """How many values the one table has of each file: none may be lost, none may be there twice."""
    found = p3_table(spark, root)
    own = [F.col(f"`{c}`").isNotNull().cast("bigint") for c in found.columns if c not in ("file_id", "suite", "committed_at")]
    return found.select("file_id", sum(own, F.lit(0).cast("bigint")).alias("n_values"))


def _index_keys(spark: SparkSession, root: str) -> DataFrame:
    return indexes.keys_of_definitions(table(spark, root, "stored_document"), table(spark, root, "secondary_index"))


def _all_keys(spark: SparkSession, root: str) -> DataFrame:
    """Every key of every row in long form: pool (the rows that a share is of), field_name, scope, key_value."""
    spelled = one_spelling(F.col("predicate"))
    of_edge = F.array(
        F.struct(F.lit("source").alias("pool"), F.lit("source").alias("field_name"), F.col("graph").alias("scope"), F.col("source").alias("key_value")),
        F.struct(F.lit("predicate").alias("pool"), F.lit("predicate").alias("field_name"), F.lit("*").alias("scope"), spelled.alias("key_value")),
    )
    edges = table(spark, root, "graph_edge").select(F.inline(of_edge))
    keys = _index_keys(spark, root)
    return edges.unionByName(keys.select(F.col("name").alias("pool"), F.lit("key_fn").alias("field_name"), F.col("name").alias("scope"), F.col("key").alias("key_value")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The keys with more than HEAVY_SHARE of the rows of their pool, counted shard by shard as a load plan over all keys cuts them."""
    keys = ["pool", "field_name", "scope", "key_value"]
    rows = _all_keys(spark, root)
    plan = skew.plan_loads(rows, keys, tasks_of(spark))
    counts = Scratch(spark, "p4").keep(skew.shard_counts(rows, plan), "counts")
    heavy = skew.heavy_keys(skew.from_shards(counts, plan), ["field_name", "pool"], HEAVY_SHARE)
    return heavy.where(F.col("key_value").isNotNull()).select("field_name", "scope", "key_value")


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """For each source the targets it points to, how often, and the first row_id of the source's node; a heavy source's rows lie in shards."""
    edges = table(spark, root, "graph_edge").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    nodes = table(spark, root, "graph_node").groupBy("graph", F.col("id").alias("source")).agg(F.min("row_id").alias("source_row"))
    pairs = Scratch(spark, "p4").keep(edges.groupBy("graph", "source", "target").agg(F.count(F.lit(1)).alias("n_edges")), "pairs")
    plan = skew.plan_loads(pairs, ["graph", "source"], tasks_of(spark))
    return skew.spread_join(pairs, nodes, plan, F.xxhash64("target"), "left").select("graph", "source", "target", "n_edges", "source_row")


def p4_postings(spark: SparkSession, root: str) -> DataFrame:
    """The postings of every index: for each key the number of documents and the first and last of their ids, lists being kept by shard and part."""
    items = Scratch(spark, "p4").keep(skew.distinct_items(_index_keys(spark, root), ["name", "key"], "doc_id"), "items")
    plan = skew.plan_loads(items, ["name", "key"], tasks_of(spark))
    lists = skew.partial_lists(items, plan, "doc_id", F.xxhash64("doc_id"))
    return lists.groupBy("name", "key").agg(
        F.sum("n_items").alias("n_documents"), F.min(F.element_at("items", 1)).alias("first_id"), F.max(F.element_at("items", -1)).alias("last_id")
    )


METRIC_FIELDS = ("reference_seconds", "fast_seconds", "speedup")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return spikes.cases(table(spark, root, "bench_metric"), METRIC_FIELDS)


def p5_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score, deviation, run length and reason of every reading."""
    return spikes.judged(table(spark, root, "bench_metric"), METRIC_FIELDS)


def p5_rules(spark: SparkSession, root: str) -> DataFrame:
    """The readings that the two rules of physics decide, without any score."""
    found = spikes.judged(table(spark, root, "bench_metric"), METRIC_FIELDS, cases_only=True)
    return found.where(F.col("reason") != "spike").select("measurement_id", "field_name", "reason")


def _hierarchy(spark: SparkSession, root: str) -> hierarchy.Hierarchy:
    return hierarchy.hierarchy(hierarchy.current_links(table(spark, root, "graph_edge")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root).nodes().select("graph", "node_id", "root_id", "depth")


def p6_paths(spark: SparkSession, root: str) -> DataFrame:
    """Path of each node that has a root, ids from the root on, and the number of its descendants, from its interval."""
    found = _hierarchy(spark, root)
    paths = found.paths().select("graph", "node_id", F.concat_ws(" / ", "path").alias("path"))
    return paths.join(found.nodes().select("graph", "node_id", "n_descendants"), ["graph", "node_id"])


def p6_descendants(spark: SparkSession, root: str) -> DataFrame:
    """Every node below every node, and how far."""
    return _hierarchy(spark, root).descendants()


def tasks_of(spark: SparkSession) -> int:
    """Tasks to spread over: as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_capture": p2_capture, "p3_found": p3_found, "p3_table": p3_table, "p3_complete": p3_complete, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_postings": p4_postings, "p5_found": p5_found, "p5_scores": p5_scores, "p5_rules": p5_rules, "p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}
