"""Queries of the store's own operators: documents, indexes, graphs and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions.keys import UINT64
from sedgework.operators import documents as D
from sedgework.operators import graphs as G
from sedgework.operators import indexes as I
from sedgework.operators import views as V
from sedgework.plans import collections as C
from sedgework.sources.tables import table

EVENT, MEASURE = "value.event_type", "value.value"
BY_TYPE = I.IndexDefinition("by-type", EVENT)
BY_USER = I.IndexDefinition("by-user", "value.user_id", key_type=UINT64)
BY_NAME = I.IndexDefinition("by-name", "value.c_name", collection="customer", unique=True)
BY_NATION = I.IndexDefinition("by-nation", "value.c_nationkey", collection="customer", key_type=UINT64, unique=True)
BY_WORD = I.IndexDefinition("by-word", "split(value.p_name, ' ')", collection="part", multi_valued=True)
BY_HIGH = I.IndexDefinition("by-high", "CASE WHEN value.value > 100 THEN value.event_type END")

PURCHASES = V.View("purchases", "CASE WHEN value.event_type = 'purchase' THEN array(struct(id AS key, value.value AS value)) END", reduce="count(1)")
LATEST = V.View("latest", "array(struct(value.event_type AS key, value.value AS value))")
LATEST_OF_BOTH = V.View("latest-of-both", "array(struct(value.event_type AS key, value.value AS value), struct(concat('u', CAST(value.user_id AS STRING)) AS key, value.value AS value))")
SUMS = V.View("sums", PURCHASES.map, reduce="round(sum(value), 2)")
WORDS = V.View("words", "transform(split(value.label, ' '), w -> struct(concat_ws('|', w, id) AS key, w AS value))")


def flat(found: DataFrame, *fields: str) -> DataFrame:
    """id and fields of the value."""
    return found.select("id", *[F.col(f"value.{f}").alias(f) for f in fields])


def replaced(docs: DataFrame) -> DataFrame:
    """The documents of even users, written again with another type."""
    return docs.where("value.user_id % 2 = 0").select("id", F.col("value").withField("event_type", F.lit("replaced")).alias("value"))


def _docs(name: str) -> Callable:
    def wrap(build: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, root: build(C.documents(spark, root))
        return build

    return wrap


def _graph(name: str) -> Callable:
    def wrap(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, root: build(C.nodes(spark, root), C.edges(spark, root))
        return build

    return wrap


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


@_docs("doc_scan")
def doc_scan(docs: DataFrame) -> DataFrame:
    return flat(D.scan(docs), "event_type", "value")


@_docs("doc_select_where")
def doc_select_where(docs: DataFrame) -> DataFrame:
    return flat(D.select(docs, (F.col(EVENT) == "purchase") & (F.col(MEASURE) > 100)), "value")


@_docs("doc_select_offset_limit")
def doc_select_offset_limit(docs: DataFrame) -> DataFrame:
    return flat(D.select(docs, F.col(EVENT) == "click", limit=25, offset=10), "value")


@_docs("doc_fetch")
def doc_fetch(docs: DataFrame) -> DataFrame:
    return flat(D.fetch(docs, "000000000042"), "event_type", "value")


@_docs("doc_fetch_bulk")
def doc_fetch_bulk(docs: DataFrame) -> DataFrame:
    ids = D.requested(docs.sparkSession, ["000000000007", "missing", "000000000003", "000000000007"])
    return D.fetch_bulk(docs, ids).select("ord", "id", F.col(EVENT).alias("event_type"), F.col(MEASURE).alias("value"))


@_docs("doc_primary_range")
def doc_primary_range(docs: DataFrame) -> DataFrame:
    return flat(D.select_primary_range(docs, "000000000100", "000000000199"), "value")


@_docs("doc_primary_range_limit")
def doc_primary_range_limit(docs: DataFrame) -> DataFrame:
    return flat(D.select_primary_range(docs, "000000000100", limit=10), "value")


@_docs("doc_upsert")
def doc_upsert(docs: DataFrame) -> DataFrame:
    one = docs.sparkSession.range(1).select(F.lit("new-1").alias("id"), F.struct(*[F.lit("inserted" if f.name == "event_type" else None).cast(f.dataType).alias(f.name) for f in docs.schema["value"].dataType.fields]).alias("value"))
    return flat(D.upsert(docs, replaced(docs).unionByName(one)), "event_type")


@_docs("doc_upsert_dup_in_batch")
def doc_upsert_dup_in_batch(docs: DataFrame) -> DataFrame:
    batch = docs.select(F.lpad(F.col("value.user_id").cast("string"), 12, "0").alias("id"), "value", F.col("value.event_id").alias("ord"))
    return flat(D.upsert(docs.limit(0), batch, "ord"), "event_id")


@_docs("doc_delete")
def doc_delete(docs: DataFrame) -> DataFrame:
    return flat(D.delete(docs, docs.where(F.col(EVENT) == "error")), "event_type")


def doc_put_json_id(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "events").select(F.concat(F.lit('{"_id": "j'), F.col("event_id").cast("string"), F.lit('", "id": "other", "props": '), "props", F.lit("}")).alias("json"))
    return D.from_json(texts).select("id", F.variant_get("value", "$.props.k", "bigint").alias("k"))


@_docs("doc_stats")
def doc_stats(docs: DataFrame) -> DataFrame:
    return D.stats(docs).select("entries")


@_docs("idx_equality_ids")
def idx_equality_ids(docs: DataFrame) -> DataFrame:
    return I.index_document_ids(I.build_postings(docs, BY_TYPE), BY_TYPE, "signup")


@_docs("idx_select")
def idx_select(docs: DataFrame) -> DataFrame:
    return I.select_index(I.build_postings(docs, BY_TYPE), docs, BY_TYPE, "signup", project=[F.col(MEASURE).alias("value")])


@_docs("idx_range_string")
def idx_range_string(docs: DataFrame) -> DataFrame:
    return I.select_index_range(I.build_postings(docs, BY_TYPE), docs, BY_TYPE, "error", "signup", project=[]).select("key", "id")


def _as_number(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").cast("bigint").alias("key"), "id")


@_docs("idx_range_uint64")
def idx_range_uint64(docs: DataFrame) -> DataFrame:
    return _as_number(I.select_index_range(I.build_postings(docs, BY_USER), docs, BY_USER, 3, 5))


@_docs("idx_range_limit")
def idx_range_limit(docs: DataFrame) -> DataFrame:
    return _as_number(I.select_index_range(I.build_postings(docs, BY_USER), docs, BY_USER, 3, limit=20))


def idx_unique_lookup(spark: SparkSession, root: str) -> DataFrame:
    docs = C.customers(spark, root)
    postings = I.build_postings(docs, BY_NAME)
    return I.select_index(postings, docs, BY_NAME, "Customer#000000007", project=[F.col("value.c_acctbal").alias("c_acctbal")])


def idx_unique_violations(spark: SparkSession, root: str) -> DataFrame:
    found = I.unique_violations(I.build_postings(C.customers(spark, root), BY_NATION))
    return found.select(F.col("key").cast("int").alias("key"), "holders")


def idx_multivalued_postings(spark: SparkSession, root: str) -> DataFrame:
    return I.build_postings(C.parts(spark, root), BY_WORD).select("key", F.col("doc_id").alias("id"))


def idx_multivalued_range(spark: SparkSession, root: str) -> DataFrame:
    docs = C.parts(spark, root)
    return I.select_index_range(I.build_postings(docs, BY_WORD), docs, BY_WORD, "c", "x").select("key", "id")


@_docs("idx_null_key_skipped")
def idx_null_key_skipped(docs: DataFrame) -> DataFrame:
    return I.build_postings(docs, BY_HIGH).select("key", F.col("doc_id").alias("id"))


@_docs("idx_rebuild_postings")
def idx_rebuild_postings(docs: DataFrame) -> DataFrame:
    return I.rebuild_index_fast(docs, BY_TYPE).select("key", F.col("doc_id").alias("id"))


@_docs("idx_after_replace")
def idx_after_replace(docs: DataFrame) -> DataFrame:
    after = I.update_postings(I.build_postings(docs, BY_TYPE), replaced(docs), BY_TYPE)
    return after.groupBy("key").agg(F.count(F.lit(1)).alias("postings"))


@_docs("idx_dangling_skipped")
def idx_dangling_skipped(docs: DataFrame) -> DataFrame:
    live = D.delete(docs, docs.where(F.col("value.event_id") % 3 == 0))
    return flat(I.index_fetch(I.build_postings(docs, BY_TYPE), live, BY_TYPE, "click"), "value")


@_graph("graph_nodes")
def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.enumerate_graph(nodes, "geo").select("id", "label")


@_graph("graph_edges")
def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.enumerate_graph(edges, "geo").select("id", "source", "predicate", "target")


@_graph("graph_fetch_node")
def graph_fetch_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.fetch(nodes, "sales", "c:7").select("id", "label")


@_graph("graph_fetch_edge")
def graph_fetch_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.fetch(edges, "sales", "e:o:7").select("id", "source", "predicate", "target")


@_graph("graph_fetch_bulk_nodes")
def graph_fetch_bulk_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.fetch_bulk_nodes(nodes, "sales", D.requested(nodes.sparkSession, ["c:7", "zz", "c:1"])).select("ord", "id", "label")


@_graph("graph_edge_ids_out")
def graph_edge_ids_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.node_edge_ids(edges, "sales", "o:7")


@_graph("graph_edges_in")
def graph_edges_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.node_edges(edges, "sales", "p:7", incoming=True).select("id", "source", "predicate", "target")


@_graph("graph_neighbors_out")
def graph_neighbors_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.node_neighbors(edges, nodes, "sales", "o:7").select("id", "label")


@_graph("graph_neighbors_in_predicate")
def graph_neighbors_in_predicate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.node_neighbors(edges, nodes, "sales", "p:7", incoming=True, predicate="contains").select("id", "label")


@_graph("graph_parallel_edges")
def graph_parallel_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.parallel_edges(G.enumerate_graph(edges, "sales")).select("source", "predicate", "target", "n")


@_graph("graph_namespace_isolation")
def graph_namespace_isolation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.fetch(nodes, "sales", "c:7").unionByName(G.fetch(nodes, "geo", "c:7"))


@_graph("graph_edge_replace")
def graph_edge_replace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    batch = edges.where((F.col("predicate") == "placed") & F.col("source").endswith("7")).withColumn("predicate", F.lit("cancelled"))
    return G.upsert(edges, batch).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@_graph("graph_delete_node")
def graph_delete_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kept = G.delete_nodes(nodes, edges, G.fetch(nodes, "sales", "o:7"))[1]
    return kept.where(F.col("graph") == "sales").select("id")


@_graph("graph_clear")
def graph_clear(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.clear_graph(nodes, "sales").select("graph", "id")


@_graph("graph_unknown_endpoints")
def graph_unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = nodes.sparkSession.createDataFrame([("geo", "bad", "c:7", "lives-in", "n:none")], "graph string, id string, source string, predicate string, target string")
    return G.unknown_endpoints(edges.unionByName(bad), nodes).select("id")


@_graph("graph_adjacency_out_all")
def graph_adjacency_out_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.adjacency(edges).withColumnRenamed("node", "source").select("graph", "source", "predicate", "neighbor", "edge_id")


@_graph("graph_adjacency_in_all")
def graph_adjacency_in_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.adjacency(edges, incoming=True).withColumnRenamed("node", "target").select("graph", "target", "predicate", "neighbor", "edge_id")


@_graph("graph_all_neighbors")
def graph_all_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbors of all nodes at once, counted by node, predicate and label's first letter."""
    found = G.all_neighbors(edges, nodes)
    return found.groupBy("graph", "node", "predicate", F.substring("label", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"))


@_graph("graph_put_triples")
def graph_put_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    triples = edges.select("source", "target", F.when(F.col("source").endswith("7"), F.col("predicate")).alias("predicate"))
    return G.edges_from_triples(triples, "all").groupBy("graph", "predicate").agg(F.count_distinct("id").alias("n"))


@_docs("view_rebuild")
def view_rebuild(docs: DataFrame) -> DataFrame:
    return V.rebuild(docs, PURCHASES)


@_docs("view_last_writer")
def view_last_writer(docs: DataFrame) -> DataFrame:
    return V.rebuild(docs, LATEST)


@_docs("view_multi_emit")
def view_multi_emit(docs: DataFrame) -> DataFrame:
    return V.rebuild(docs, LATEST_OF_BOTH)


@_docs("view_get")
def view_get(docs: DataFrame) -> DataFrame:
    rows = V.rebuild(docs, PURCHASES)
    return V.get(rows, docs.where(F.col(EVENT) == "purchase").agg(F.min("id")).first()[0])


@_docs("view_rows_range")
def view_rows_range(docs: DataFrame) -> DataFrame:
    return V.select_rows(V.rebuild(docs, PURCHASES), "000000000100", "000000000200")


@_docs("view_rows_limit")
def view_rows_limit(docs: DataFrame) -> DataFrame:
    return V.select_rows(V.rebuild(docs, PURCHASES), "000000000100", limit=5)


@_docs("view_reduce_count")
def view_reduce_count(docs: DataFrame) -> DataFrame:
    return V.reduce(V.rebuild(docs, PURCHASES), PURCHASES).select(F.col("result").alias("n"))


@_docs("view_reduce_range_sum")
def view_reduce_range_sum(docs: DataFrame) -> DataFrame:
    return V.reduce(V.select_rows(V.rebuild(docs, SUMS), "000000000100", "000000000900"), SUMS).select(F.col("result").alias("total"))


def _after_update(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    written = replaced(docs)
    changed = written.select(F.col("value.event_id").alias("seq"), F.col("id").alias("doc_id"))
    return D.upsert(docs, written), changed


@_docs("view_incremental_keeps_stale")
def view_incremental_keeps_stale(docs: DataFrame) -> DataFrame:
    now, changed = _after_update(docs)
    return V.apply(V.rebuild(docs, PURCHASES), now, changed, PURCHASES)


@_docs("view_rebuild_drops_stale")
def view_rebuild_drops_stale(docs: DataFrame) -> DataFrame:
    return V.rebuild(_after_update(docs)[0], PURCHASES)


@_docs("view_incremental_moves_keys")
def view_incremental_moves_keys(docs: DataFrame) -> DataFrame:
    """A view by type, brought up to date from the change log alone."""
    now, changed = _after_update(docs)
    return V.apply(V.rebuild(docs, LATEST), now, changed, LATEST)


def store_flagship(spark: SparkSession, root: str) -> DataFrame:
    """Documents, postings, graph and view in one plan: customers picked by an index of orders' states, their neighbors, reduced by a view."""
    nodes, edges = C.nodes(spark, root), C.edges(spark, root)
    orders = G.enumerate_graph(nodes, "sales").where(F.col("id").startswith("o:")).select("id", F.struct("label").alias("value"))
    by_state = I.IndexDefinition("by-state", "value.label")
    picked = I.index_document_ids(I.build_postings(orders, by_state), by_state, "O").withColumnRenamed("id", "node")
    reached = G.all_neighbors(edges, nodes, where=F.col("predicate") == "contains").join(picked, "node")
    found = reached.select(F.concat_ws("|", "node", "edge_id").alias("id"), F.struct("label").alias("value"))
    rows = V.rebuild(found, WORDS)
    return rows.groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {
    f.__name__: f for f in (doc_put_json_id, idx_unique_lookup, idx_unique_violations, idx_multivalued_postings, idx_multivalued_range, store_flagship)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
