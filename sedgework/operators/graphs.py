"""A property graph: nodes (graph, id, ...) and edges (graph, id, source, predicate, target, ...). graph is a namespace; the same id can be in several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.errors import UnknownEndpoint
from sedgework.functions.ids import generated_id
from sedgework.functions.text import DEFAULT_PREDICATE
from sedgework.operators.documents import last_writes

DEFAULT_GRAPH = "default"
KEY = ["graph", "id"]


def upsert(rows: DataFrame, batch: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Nodes or edges after batch was written; as documents.upsert, by (graph, id). An edge's adjacency is that of its row, so it moves with it."""
    new = last_writes(batch, KEY, ordinal) if ordinal else batch
    return rows.join(new.select(*KEY), KEY, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def with_row_ids(rows: DataFrame | None, batch: DataFrame, ordinal: str | None, start: int) -> DataFrame:
    """batch with ``row_id``: that of the row of rows (None: there are none) that it replaces, else a new one from start on, increasing with ordinal, if there is one. Gaps are left."""
    ordered = batch if ordinal is None else batch.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal)
    if rows is None:
        return ordered.withColumn("row_id", F.monotonically_increasing_id() + start)
    kept = rows.select(*KEY, "row_id")
    return ordered.withColumn("__new", F.monotonically_increasing_id() + start).join(kept, KEY, "left").withColumn("row_id", F.coalesce("row_id", "__new")).drop("__new")


def unknown_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which an endpoint is null or no node of their graph. Of the nodes, only those that the edges name are looked at further."""
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("id")).where(F.col("id").isNotNull()).distinct()
    known = nodes.select(*KEY).join(ends, KEY, "left_semi").distinct()
    sources = known.select("graph", F.col("id").alias("source"), F.lit(True).alias("__s"))
    targets = known.select("graph", F.col("id").alias("target"), F.lit(True).alias("__t"))
    checked = edges.join(sources, ["graph", "source"], "left").join(targets, ["graph", "target"], "left")
    return checked.where(F.col("__s").isNull() | F.col("__t").isNull()).select(*edges.columns)


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> None:
    """Raise UnknownEndpoint if an edge has one. Endpoints are looked up once each; edges are joined only to name one that is wrong."""
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("id")).distinct()
    if ends.join(nodes.select(*KEY), KEY, "left_anti").isEmpty():
        return
    if bad := unknown_endpoints(edges, nodes).take(1):
        raise UnknownEndpoint(f"edge {bad[0]['id']!r} of graph {bad[0]['graph']!r} names a node that isn't there")


def edges_from_triples(triples: DataFrame, graph: str = DEFAULT_GRAPH) -> DataFrame:
    """Edges of (source, target, predicate) rows, with generated ids; a null predicate is the default."""
    return triples.select(F.lit(graph).alias("graph"), generated_id().alias("id"), "source", F.coalesce("predicate", F.lit(DEFAULT_PREDICATE)).alias("predicate"), "target")


def fetch(rows: DataFrame, graph: str, id: str) -> DataFrame:
    """The node or edge of that name, or no row."""
    return rows.where((F.col("graph") == graph) & (F.col("id") == id))


def fetch_bulk_nodes(nodes: DataFrame, graph: str, ids: DataFrame) -> DataFrame:
    """One row per row of ids (ord, id): ord and the node's columns, all null for a miss."""
    own = nodes.where(F.col("graph") == graph)
    asked = ids.select("ord", F.col("id").alias("__id"))
    return asked.join(own, asked["__id"] == own["id"], "left").drop("__id")


def enumerate_graph(rows: DataFrame, graph: str) -> DataFrame:
    """All nodes or edges of a graph; sort by id for the order of enumeration."""
    return rows.where(F.col("graph") == graph)


def node_edges(edges: DataFrame, graph: str, node: str, incoming: bool = False, predicate: str | None = None) -> DataFrame:
    """Edges that leave a node, or enter it, of one predicate or of all. Parallel edges are all there; unknown nodes have none."""
    at = (F.col("graph") == graph) & (F.col("target" if incoming else "source") == node)
    return edges.where(at if predicate is None else at & (F.col("predicate") == predicate))


def node_edge_ids(edges: DataFrame, graph: str, node: str, incoming: bool = False, predicate: str | None = None) -> DataFrame:
    return node_edges(edges, graph, node, incoming, predicate).select("id")


def node_neighbors(edges: DataFrame, nodes: DataFrame, graph: str, node: str, incoming: bool = False, predicate: str | None = None) -> DataFrame:
    """The nodes at the other ends, once per edge. Of the edges only the columns needed are read."""
    far = node_edges(edges, graph, node, incoming, predicate).select("graph", F.col("source" if incoming else "target").alias("id"))
    return far.join(nodes, KEY)


def all_neighbors(edges: DataFrame, nodes: DataFrame, incoming: bool = False, where: Column | None = None) -> DataFrame:
    """For every node its neighbors, once per edge: graph, node, predicate, edge_id and the neighbor's columns."""
    near, far = ("target", "source") if incoming else ("source", "target")
    own = edges if where is None else edges.where(where)
    ends = own.select("graph", F.col(near).alias("node"), "predicate", F.col("id").alias("edge_id"), F.col(far).alias("id"))
    return ends.join(nodes, KEY)


def adjacency(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """graph, node, predicate, neighbor, edge_id: what adjacency by predicate holds, as a table."""
    near, far = ("target", "source") if incoming else ("source", "target")
    return edges.select("graph", F.col(near).alias("node"), "predicate", F.col(far).alias("neighbor"), F.col("id").alias("edge_id"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """graph, source, predicate, target, n of those that more than one edge joins."""
    return edges.groupBy("graph", "source", "predicate", "target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of gone (graph, id)."""
    return edges.join(gone.select(*KEY), KEY, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of gone (graph, id) and without all edges at them."""
    names = gone.select(*KEY).distinct()
    kept = edges.join(names.withColumnRenamed("id", "source"), ["graph", "source"], "left_anti").join(names.withColumnRenamed("id", "target"), ["graph", "target"], "left_anti")
    return nodes.join(names, KEY, "left_anti"), kept.select(*edges.columns)


def clear_graph(rows: DataFrame, graph: str) -> DataFrame:
    """Nodes or edges of all other graphs."""
    return rows.where((F.col("graph") != graph) | F.col("graph").isNull())


def sorted_for_storage(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """Range-partitioned by (graph, near end, predicate, id), so that a lookup reads few files and a node with very many edges spreads over several."""
    near = "target" if incoming else "source"
    return edges.repartitionByRange("graph", near, "predicate", "id").sortWithinPartitions("graph", near, "predicate", "id")
