"""SQL that states the results of store_queries, for DuckDB."""

from __future__ import annotations

DOCS = "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_id, user_id, event_type, value FROM events"
NODES = """
SELECT 'sales' AS graph, 'c:' || CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer
UNION ALL SELECT 'sales', 'o:' || CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders
UNION ALL SELECT 'sales', 'p:' || CAST(p_partkey AS VARCHAR), p_name FROM part
UNION ALL SELECT 'geo', 'c:' || CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
UNION ALL SELECT 'geo', 'n:' || CAST(n_nationkey AS VARCHAR), n_name FROM nation"""
EDGES = """
SELECT 'sales' AS graph, 'e:o:' || CAST(o_orderkey AS VARCHAR) AS id, 'c:' || CAST(o_custkey AS VARCHAR) AS source, 'placed' AS predicate, 'o:' || CAST(o_orderkey AS VARCHAR) AS target FROM orders
UNION ALL SELECT 'sales', 'e:l:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS VARCHAR), 'o:' || CAST(l_orderkey AS VARCHAR), 'contains', 'p:' || CAST(l_partkey AS VARCHAR) FROM lineitem
UNION ALL SELECT 'geo', 'e:c:' || CAST(c_custkey AS VARCHAR), 'c:' || CAST(c_custkey AS VARCHAR), 'lives-in', 'n:' || CAST(c_nationkey AS VARCHAR) FROM customer"""

WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS id FROM part"
BOTH = "SELECT id, 0 AS ord, event_type AS key, value FROM docs UNION ALL SELECT id, 1, 'u' || CAST(user_id AS VARCHAR), value FROM docs"
LAST = "SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM ({rows})) WHERE rn = 1"

_OVER_DOCS = {
    "doc_scan": "SELECT id, event_type, value FROM docs",
    "doc_select_where": "SELECT id, value FROM docs WHERE event_type = 'purchase' AND value > 100",
    "doc_select_offset_limit": "SELECT id, value FROM docs WHERE event_type = 'click' ORDER BY id LIMIT 25 OFFSET 10",
    "doc_fetch": "SELECT id, event_type, value FROM docs WHERE id = '000000000042'",
    "doc_fetch_bulk": "SELECT CAST(r.ord AS BIGINT) AS ord, r.id, d.event_type, d.value FROM (VALUES (0, '000000000007'), (1, 'missing'), (2, '000000000003'), (3, '000000000007')) r(ord, id) LEFT JOIN docs d ON d.id = r.id",
    "doc_primary_range": "SELECT id, value FROM docs WHERE id >= '000000000100' AND id <= '000000000199'",
    "doc_primary_range_limit": "SELECT id, value FROM docs WHERE id >= '000000000100' ORDER BY id LIMIT 10",
    "doc_upsert": "SELECT id, CASE WHEN user_id % 2 = 0 THEN 'replaced' ELSE event_type END AS event_type FROM docs UNION ALL SELECT 'new-1', 'inserted'",
    "doc_upsert_dup_in_batch": "SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS id, max(event_id) AS event_id FROM docs GROUP BY 1",
    "doc_delete": "SELECT id, event_type FROM docs WHERE event_type <> 'error'",
    "doc_put_json_id": "SELECT 'j' || CAST(event_id AS VARCHAR) AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "doc_stats": "SELECT count(*) AS entries FROM docs",
    "idx_equality_ids": "SELECT id FROM docs WHERE event_type = 'signup'",
    "idx_select": "SELECT id, value FROM docs WHERE event_type = 'signup'",
    "idx_range_string": "SELECT event_type AS key, id FROM docs WHERE event_type BETWEEN 'error' AND 'signup'",
    "idx_range_uint64": "SELECT user_id AS key, id FROM docs WHERE user_id BETWEEN 3 AND 5",
    "idx_range_limit": "SELECT user_id AS key, id FROM docs WHERE user_id >= 3 ORDER BY user_id, id LIMIT 20",
    "idx_unique_lookup": "SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'",
    "idx_unique_violations": "SELECT c_nationkey AS key, count(DISTINCT c_custkey) AS holders FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) > 1",
    "idx_multivalued_postings": WORDS,
    "idx_multivalued_range": f"SELECT key, id FROM ({WORDS}) WHERE key >= 'c' AND key <= 'x'",
    "idx_null_key_skipped": "SELECT event_type AS key, id FROM docs WHERE value > 100 AND event_type IS NOT NULL",
    "idx_rebuild_postings": "SELECT event_type AS key, id FROM docs",
    "idx_after_replace": "SELECT CASE WHEN user_id % 2 = 0 THEN 'replaced' ELSE event_type END AS key, count(*) AS postings FROM docs GROUP BY 1",
    "idx_dangling_skipped": "SELECT id, value FROM docs WHERE event_type = 'click' AND event_id % 3 <> 0",
    "view_rebuild": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase'",
    "view_last_writer": LAST.format(order="id DESC", rows="SELECT event_type AS key, value, id FROM docs"),
    "view_multi_emit": LAST.format(order="id DESC, ord DESC", rows=BOTH),
    "view_get": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase' AND id = (SELECT min(id) FROM docs WHERE event_type = 'purchase')",
    "view_rows_range": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase' AND id >= '000000000100' AND id < '000000000200'",
    "view_rows_limit": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase' AND id >= '000000000100' ORDER BY id LIMIT 5",
    "view_reduce_count": "SELECT count(*) AS n FROM docs WHERE event_type = 'purchase'",
    "view_reduce_range_sum": "SELECT round(sum(value), 2) AS total FROM docs WHERE event_type = 'purchase' AND id >= '000000000100' AND id < '000000000900'",
    "view_incremental_keeps_stale": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase'",
    "view_rebuild_drops_stale": "SELECT id AS key, value FROM docs WHERE event_type = 'purchase' AND user_id % 2 <> 0",
    "view_incremental_moves_keys": f"""
SELECT * FROM ({LAST.format(order="id DESC", rows="SELECT event_type AS key, value, id FROM docs")})
UNION ALL SELECT * FROM (SELECT 'replaced' AS key, value FROM docs WHERE user_id % 2 = 0 ORDER BY event_id DESC LIMIT 1)""",
}
_OVER_GRAPH = {
    "graph_nodes": "SELECT id, label FROM nodes WHERE graph = 'geo'",
    "graph_edges": "SELECT id, source, predicate, target FROM edges WHERE graph = 'geo'",
    "graph_fetch_node": "SELECT id, label FROM nodes WHERE graph = 'sales' AND id = 'c:7'",
    "graph_fetch_edge": "SELECT id, source, predicate, target FROM edges WHERE graph = 'sales' AND id = 'e:o:7'",
    "graph_fetch_bulk_nodes": "SELECT CAST(r.ord AS BIGINT) AS ord, n.id, n.label FROM (VALUES (0, 'c:7'), (1, 'zz'), (2, 'c:1')) r(ord, id) LEFT JOIN nodes n ON n.graph = 'sales' AND n.id = r.id",
    "graph_edge_ids_out": "SELECT id FROM edges WHERE graph = 'sales' AND source = 'o:7'",
    "graph_edges_in": "SELECT id, source, predicate, target FROM edges WHERE graph = 'sales' AND target = 'p:7'",
    "graph_neighbors_out": "SELECT n.id, n.label FROM edges e JOIN nodes n ON n.graph = e.graph AND n.id = e.target WHERE e.graph = 'sales' AND e.source = 'o:7'",
    "graph_neighbors_in_predicate": "SELECT n.id, n.label FROM edges e JOIN nodes n ON n.graph = e.graph AND n.id = e.source WHERE e.graph = 'sales' AND e.target = 'p:7' AND e.predicate = 'contains'",
    "graph_parallel_edges": "SELECT source, predicate, target, count(*) AS n FROM edges WHERE graph = 'sales' GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "graph_namespace_isolation": "SELECT graph, id, label FROM nodes WHERE id = 'c:7'",
    "graph_edge_replace": "SELECT CASE WHEN predicate = 'placed' AND right(source, 1) = '7' THEN 'cancelled' ELSE predicate END AS predicate, count(*) AS n FROM edges GROUP BY 1",
    "graph_delete_node": "SELECT id FROM edges WHERE graph = 'sales' AND source <> 'o:7' AND target <> 'o:7'",
    "graph_clear": "SELECT graph, id FROM nodes WHERE graph <> 'sales'",
    "graph_unknown_endpoints": "SELECT e.id FROM (SELECT * FROM edges UNION ALL SELECT 'geo', 'bad', 'c:7', 'lives-in', 'n:none') e LEFT JOIN nodes s ON s.graph = e.graph AND s.id = e.source LEFT JOIN nodes t ON t.graph = e.graph AND t.id = e.target WHERE s.id IS NULL OR t.id IS NULL",
    "graph_adjacency_out_all": "SELECT graph, source, predicate, target AS neighbor, id AS edge_id FROM edges",
    "graph_adjacency_in_all": "SELECT graph, target, predicate, source AS neighbor, id AS edge_id FROM edges",
    "graph_all_neighbors": "SELECT e.graph, e.source AS node, e.predicate, substr(n.label, 1, 1) AS initial, count(*) AS n FROM edges e JOIN nodes n ON n.graph = e.graph AND n.id = e.target GROUP BY 1, 2, 3, 4",
    "graph_put_triples": "SELECT 'all' AS graph, CASE WHEN right(source, 1) = '7' THEN predicate ELSE 'child' END AS predicate, count(*) AS n FROM edges GROUP BY 1, 2",
    "store_flagship": "SELECT unnest(string_split(p.label, ' ')) AS word, count(*) AS n FROM edges e JOIN nodes o ON o.graph = e.graph AND o.id = e.source JOIN nodes p ON p.graph = e.graph AND p.id = e.target WHERE e.graph = 'sales' AND e.predicate = 'contains' AND o.label = 'O' GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    over_docs = {name: f"WITH docs AS ({DOCS}) {sql.strip()}" for name, sql in _OVER_DOCS.items()}
    return over_docs | {name: f"WITH nodes AS ({NODES}), edges AS ({EDGES}) {sql}" for name, sql in _OVER_GRAPH.items()}
