"""Queries that go through a database in the shared folder: snapshots, transactions, indexes, graph and views together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.database import Database
from sedgework.operators.indexes import IndexDefinition
from sedgework.operators.views import View
from sedgework.plans import collections as C
from sedgework.plans.store_oracles import DOCS, EDGES, NODES
from sedgework.plans.store_queries import replaced
from sedgework.sources.scratch import Scratch

BY_TYPE = IndexDefinition("by-type", "variant_get(value, '$.event_type', 'string')")
BY_USER = IndexDefinition("by-user", "variant_get(value, '$.user_id', 'bigint')", key_type="uint64")
LATEST = View("latest", "array(struct(variant_get(value, '$.event_type', 'string') AS key, id AS value))")


class _Abort(Exception):
    pass


def _loaded(spark: SparkSession, root: str) -> Database:
    """The events, loaded; those of even users written again; then a transaction that writes and deletes, and fails."""
    db = Database(spark, f"{Scratch(spark, 'database').root}/db", index_definitions=[BY_TYPE, BY_USER]).open()
    docs = C.documents(spark, root)
    db.bulk_load(docs)
    db.apply_view_to_database(LATEST)
    with db.with_views([LATEST]), db.write_transaction():
        db.put_bulk(replaced(docs).withColumn("ord", F.col("value.event_id")), track_changes=True)
    try:
        with db.write_transaction():
            db.put_bulk(docs.withColumn("value", F.col("value").withField("event_type", F.lit("never"))))
            db.delete_document("000000000001")
            raise _Abort
    except _Abort:
        return db


def db_documents(spark: SparkSession, root: str) -> DataFrame:
    return _loaded(spark, root).documents().select("id", F.variant_get("value", "$.event_type", "string").alias("event_type"), F.variant_get("value", "$.value", "double").alias("value"))


def db_index_range(spark: SparkSession, root: str) -> DataFrame:
    db = _loaded(spark, root)
    found = db.select_index_range("by-user", 3, 6, project=[F.variant_get("value", "$.event_type", "string").alias("event_type")])
    return found.select(F.col("key").cast("bigint").alias("key"), "id", "event_type")


def db_postings(spark: SparkSession, root: str) -> DataFrame:
    return _loaded(spark, root).postings("by-type").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def db_view(spark: SparkSession, root: str) -> DataFrame:
    return _loaded(spark, root).view(LATEST)


def db_graph(spark: SparkSession, root: str) -> DataFrame:
    """Both graphs written in one transaction, a node with its edges deleted, another graph's clearing rolled back; neighbors counted."""
    db = Database(spark, f"{Scratch(spark, 'database').root}/db", index_definitions=[]).open()
    nodes, edges = C.nodes(spark, root), C.edges(spark, root)
    with db.write_transaction():
        for graph in ("sales", "geo"):
            db.put_nodes(nodes.where(F.col("graph") == graph).select("id", F.struct("label").alias("props")), graph)
            db.put_edges(edges.where(F.col("graph") == graph), graph)
    db.delete_node("c:7", "sales")
    try:
        with db.write_transaction():
            db.clear_graph("geo")
            raise _Abort
    except _Abort:
        pass
    return db.edges().groupBy("graph", "source", "predicate").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (db_documents, db_index_range, db_postings, db_view, db_graph)}
AFTER = "SELECT id, event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'replaced' ELSE event_type END AS event_type, value FROM docs"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    start = f"WITH docs AS ({DOCS}), now AS ({AFTER})"
    return {
        "db_documents": f"{start} SELECT id, event_type, value FROM now",
        "db_index_range": f"{start} SELECT user_id AS key, id, event_type FROM now WHERE user_id BETWEEN 3 AND 6",
        "db_postings": f"{start} SELECT event_type AS key, count(*) AS n FROM now GROUP BY 1",
        "db_view": f"{start} SELECT event_type AS key, max(id) AS value FROM docs GROUP BY 1 UNION ALL SELECT 'replaced', max(id) FROM now WHERE event_type = 'replaced'",
        "db_graph": f"WITH nodes AS ({NODES}), edges AS ({EDGES}) SELECT graph, source, predicate, count(*) AS n FROM edges WHERE NOT (graph = 'sales' AND (source = 'c:7' OR target = 'c:7')) GROUP BY 1, 2, 3",
    }
