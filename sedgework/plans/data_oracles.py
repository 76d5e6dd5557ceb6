"""SQL that states the results of data_queries, for DuckDB."""

from __future__ import annotations

FIRST_EDGES = "SELECT seq, graph, source, target, min(arrived_at) AS a FROM graph_edge GROUP BY seq, graph, source, target"
REFERENCES = f"SELECT seq, graph, source AS key, 'source' AS side, a FROM ({FIRST_EDGES}) WHERE source IS NOT NULL UNION ALL SELECT seq, graph, target, 'target', a FROM ({FIRST_EDGES}) WHERE target IS NOT NULL"
ORPHANS = f"""
SELECT r.seq AS edge_seq, r.side, r.a, CASE WHEN count(n.id) = 0 THEN 'missing' WHEN count(n.id) FILTER (WHERE n.arrived_at <= r.a) = 0 THEN 'late' ELSE 'deleted' END AS reason
FROM ({REFERENCES}) r LEFT JOIN graph_node n ON n.graph = r.graph AND n.id = r.key
GROUP BY r.seq, r.side, r.a HAVING count(n.id) FILTER (WHERE n.arrived_at <= r.a AND (n.deleted_at IS NULL OR n.deleted_at > r.a)) = 0"""

SPELLING = r"coalesce(nullif(regexp_replace(lower(predicate), '^\s*:?\s*|\s+$', '', 'g'), ''), 'child')"
DEFINITIONS = "SELECT name, key_fn, collection FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY registered_at DESC) AS rn FROM secondary_index) WHERE rn = 1"
INDEX_KEYS = " UNION ALL ".join(
    f"SELECT d.name, s.id AS doc_id, {expr} AS key FROM ({DEFINITIONS}) d JOIN stored_document s ON s.collection = d.collection WHERE d.key_fn = 'value.{field}'"
    for field, expr in [("dtype", "s.value.dtype"), ("name", "s.value.name"), ("email", "s.value.email"), ("bucket", "s.value.bucket"), ("operation", "s.value.operation"), ("n", "CAST(s.value.n AS VARCHAR)"), ("tags", "unnest(s.value.tags)")]
)

LINKS = f"""
SELECT DISTINCT graph, source AS parent, target AS child FROM (
  SELECT *, row_number() OVER (PARTITION BY graph, id ORDER BY seq DESC) AS rn FROM graph_edge
) WHERE rn = 1 AND {SPELLING} = 'child' AND source IS NOT NULL AND target IS NOT NULL"""
WALK = f"""
WITH RECURSIVE links AS MATERIALIZED ({LINKS}), nodes AS (SELECT graph, parent AS id FROM links UNION SELECT graph, child FROM links),
walk AS (
  SELECT n.graph, n.id, n.id AS root, CAST(0 AS BIGINT) AS depth, n.id AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.graph = n.graph AND l.child = n.id)
  UNION ALL SELECT l.graph, l.child, w.root, w.depth + 1, w.path || ' / ' || l.child FROM walk w JOIN links l ON l.graph = w.graph AND l.parent = w.id)"""

DRIFT = """
WITH files AS (
  SELECT file_id, suite, body, row_number() OVER (PARTITION BY suite ORDER BY committed_at NULLS FIRST, file_id) AS rn
  FROM (SELECT * FROM bench_file WHERE json_valid(body)) WHERE json_type(body) = 'OBJECT'),
listed AS (SELECT file_id, suite, body, rn, unnest(json_keys(body)) AS field FROM files),
fields AS (
  SELECT DISTINCT file_id, suite, rn, field, CASE json_type(json_extract(body, '$."' || field || '"'))
    WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'whole' WHEN 'UBIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'point' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind
  FROM listed),
stretches AS (SELECT *, rn - row_number() OVER (PARTITION BY suite, field ORDER BY rn) AS stretch FROM fields),
known AS (
  SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY suite, field, stretch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS former,
    row_number() OVER (PARTITION BY suite, field, stretch ORDER BY rn) AS place,
    last_value(kind IGNORE NULLS) OVER (PARTITION BY suite, field, stretch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest,
    lead(rn) OVER (PARTITION BY suite, field ORDER BY rn) AS again
  FROM stretches),
come AS (SELECT file_id, suite, rn, field, kind, row_number() OVER (PARTITION BY suite, rn, kind ORDER BY field) AS i FROM known WHERE place = 1 AND rn > 1),
gone AS (
  SELECT f.file_id, k.suite, f.rn, k.field, k.latest AS kind, row_number() OVER (PARTITION BY k.suite, f.rn, k.latest ORDER BY k.field) AS i
  FROM known k JOIN files f ON f.suite = k.suite AND f.rn = k.rn + 1 WHERE k.again IS NULL OR k.again > k.rn + 1)
SELECT file_id, field AS field_name, 'retyped' AS change_kind FROM known WHERE kind IS NOT NULL AND former IS NOT NULL AND kind <> former
UNION ALL SELECT c.file_id, c.field, CASE WHEN g.field IS NULL THEN 'added' ELSE 'renamed' END FROM come c LEFT JOIN gone g ON g.suite = c.suite AND g.rn = c.rn AND g.kind = c.kind AND g.i = c.i
UNION ALL SELECT g.file_id, g.field, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM come c WHERE c.suite = g.suite AND c.rn = g.rn AND c.kind = g.kind AND c.i = g.i)"""

RUNS = "SELECT run_id, max(read_to) AS hi FROM run_log WHERE status = 'succeeded' AND read_to IS NOT NULL GROUP BY run_id UNION ALL SELECT max(run_id) + 1, TIMESTAMP '9999-01-01' FROM run_log"

CHANGED = f"""
WITH runs AS (SELECT run_id, hi, lag(hi) OVER (ORDER BY run_id) AS lo FROM ({RUNS}))
SELECT run_id, collection, id AS doc_key FROM runs r JOIN stored_document d ON d.arrived_at <= r.hi
GROUP BY run_id, collection, id HAVING max(revision) > coalesce(max(revision) FILTER (WHERE d.arrived_at <= r.lo), -1)"""

READINGS = " UNION ALL ".join(f"SELECT measurement_id, runner, metric, measured_at, '{f}' AS field_name, {f} AS v FROM (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY arrived_at) AS rn FROM bench_metric) WHERE rn = 1 AND {f} IS NOT NULL" for f in ("reference_seconds", "fast_seconds", "speedup"))
RULES = f"""
WITH readings AS ({READINGS}),
marked AS (SELECT *, lag(v) OVER (PARTITION BY runner, metric, field_name ORDER BY measured_at NULLS FIRST, measurement_id) AS before FROM readings),
runs AS (SELECT *, sum(CASE WHEN before = v THEN 0 ELSE 1 END) OVER (PARTITION BY runner, metric, field_name ORDER BY measured_at NULLS FIRST, measurement_id) AS run FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY runner, metric, field_name, run) AS n FROM runs)
SELECT measurement_id, field_name, CASE WHEN isfinite(v) AND v > 0 THEN 'stuck' ELSE 'not_positive' END AS reason FROM sized WHERE n >= 5 OR NOT (isfinite(v) AND v > 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT edge_seq, side, reason FROM ({ORPHANS})",
        "p1_counts": f"SELECT 'graph_edge' AS table_name, strftime(a, '%Y-%m') AS period, side, reason, count(*) AS n_references FROM ({ORPHANS}) GROUP BY 2, 3, 4",
        "p2_found": CHANGED,
        "p2_capture": CHANGED,
        "p3_found": DRIFT,
        "p3_complete": """
WITH files AS (SELECT file_id, body FROM (SELECT * FROM bench_file WHERE json_valid(body)) WHERE json_type(body) = 'OBJECT'),
listed AS (SELECT DISTINCT file_id, body, unnest(json_keys(body)) AS field FROM files)
SELECT f.file_id, count(l.field) FILTER (WHERE json_type(json_extract(l.body, '$."' || l.field || '"')) <> 'NULL') AS n_values FROM files f LEFT JOIN listed l USING (file_id) GROUP BY f.file_id""",
        "p4_found": f"""
WITH total AS (SELECT count(*) AS n FROM graph_edge), keys AS ({INDEX_KEYS})
SELECT 'source' AS field_name, graph AS scope, source AS key_value FROM graph_edge WHERE source IS NOT NULL GROUP BY graph, source HAVING count(*) > 0.03 * (SELECT n FROM total)
UNION ALL SELECT 'predicate', '*', {SPELLING} FROM graph_edge GROUP BY 3 HAVING count(*) > 0.03 * (SELECT n FROM total)
UNION ALL SELECT 'key_fn', name, key FROM (SELECT name, key, count(*) AS c, sum(count(*)) OVER (PARTITION BY name) AS n FROM keys WHERE key IS NOT NULL GROUP BY name, key) WHERE c > 0.03 * n""",
        "p4_neighbours": """
SELECT e.graph, e.source, e.target, count(*) AS n_edges, min(n.source_row) AS source_row FROM graph_edge e
LEFT JOIN (SELECT graph, id, min(row_id) AS source_row FROM graph_node GROUP BY graph, id) n ON n.graph = e.graph AND n.id = e.source
WHERE e.source IS NOT NULL AND e.target IS NOT NULL GROUP BY e.graph, e.source, e.target""",
        "p4_postings": f"WITH keys AS ({INDEX_KEYS}) SELECT name, key, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_id, max(doc_id) AS last_id FROM keys WHERE key IS NOT NULL AND doc_id IS NOT NULL GROUP BY name, key",
        "p6_found": f"{WALK} SELECT n.graph, n.id AS node_id, coalesce(w.root, '') AS root_id, coalesce(w.depth, -1) AS depth FROM nodes n LEFT JOIN walk w USING (graph, id)",
        "p5_rules": RULES,
        "p6_descendants": f"{WALK}, steps AS (SELECT graph, id, depth, unnest(string_split(path, ' / ')) AS above, unnest(range(depth + 1)) AS level FROM walk) SELECT graph, above AS node_id, id AS descendant_id, depth - level AS distance FROM steps WHERE level < depth",
        "p6_paths": f"""
{WALK}, above AS (SELECT graph, id, unnest(string_split(path, ' / ')) AS a FROM walk), sizes AS (SELECT graph, a AS id, count(*) - 1 AS n FROM above GROUP BY graph, a)
SELECT w.graph, w.id AS node_id, w.path, s.n AS n_descendants FROM walk w JOIN sizes s USING (graph, id)""",
    }
