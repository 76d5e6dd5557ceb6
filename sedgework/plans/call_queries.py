"""Queries that call the database as a user does, one call after another, and give what each call answers: step and result, texts.

Lists are given in the order in which the call gives them, so that order is checked too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework import database as db_module
from sedgework.database import Database, Document, Edge, Node, add_node_edge, decode, edge_key, encode
from sedgework.errors import StoreError, ViewError
from sedgework.functions.ids import make_key_id
from sedgework.operators.indexes import IndexDefinition
from sedgework.operators.views import View
from sedgework.plans.collections import padded
from sedgework.sources.scratch import Scratch
from sedgework.sources.tables import table


class _Abort(Exception):
    pass


def _open(spark: SparkSession, **how: object) -> Database:
    return Database(spark, f"{Scratch(spark, 'calls').root}/db", **how).open()


def _joined(found: DataFrame, *columns: str) -> str:
    return ",".join("|".join(str(x) for x in r) for r in found.select(*columns).collect())


def _error(call: Callable[[], object]) -> str:
    try:
        call()
    except (StoreError, ValueError) as found:
        return type(found).__name__
    return "none"


def _result(spark: SparkSession, steps: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(s, str(r)) for s, r in steps], "step string, result string")


def _nations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nation").select(padded("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"), F.split("n_name", " ").alias("words")).alias("value"))


def calls_documents(spark: SparkSession, root: str) -> DataFrame:
    db = _open(spark, index_definitions=[])
    regions = [(f"{r[0]:04d}", r[1]) for r in table(spark, root, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    name = F.variant_get("value", "$.name", "string").alias("name")
    with db.write_transaction():
        for id, text in regions[:2]:
            db.put(Document({"name": text}, id))
        steps: list[tuple[str, object]] = [("read your writes", db.fetch("0001").value["name"])]
        db.put_bulk([(id, {"name": text}) for id, text in regions[2:]], track_changes=True)
    steps.append(("changes of a bulk", _joined(db.changes().orderBy("seq"), "collection", "doc_id")))
    steps.append(("put value", db.put_value({"name": "NEW"}, "0009").id))
    steps.append(("put json", db.put_json('{"_id": "j1", "id": "x", "name": "JSON"}')))
    fresh = db.put_value(None)
    steps.append(("generated id", len(fresh.id) == 36 and fresh.id < make_key_id()))
    db.delete_document(fresh.id)
    db.put_bulk([("0003", {"name": "first"}), ("0003", {"name": "last"})])
    steps.append(("fetch", db.fetch("0001").value["name"]))
    steps.append(("changed", db.fetch("0001").changed))
    steps.append(("fetch a miss", db.fetch("zz")))
    steps.append(("fetch value", db.fetch_value("0003")["name"]))
    steps.append(("fetch bulk values", _joined(db.fetch_bulk_values(["0002", "zz", "0001"]).withColumn("name", name).orderBy("ord"), "ord", "id", "name")))
    steps.append(("delete", db.delete_document("0004")))
    steps.append(("delete a miss", db.delete_document("0004")))
    steps.append(("select by callable", _joined(db.select(lambda id, value: value["name"].startswith("A")).orderBy("id"), "id")))
    steps.append(("select with offset and limit", _joined(db.select(limit=2, offset=1).orderBy("id"), "id")))
    steps.append(("primary range", _joined(db.select_primary_range("0001", "0003").orderBy("id").select(name), "name")))
    seen: list[str] = []
    db.map_database(lambda id, value: seen.append(id))
    steps.append(("map in order", ",".join(seen)))
    steps.append(("entries", db.database_stats()["entries"]))
    touched = db.touch_document(Document(None, "0002"))
    steps.append(("touched", touched.changed))
    steps.append(("untouched", db.untouch_document(touched).changed))
    steps.append(("last change", _joined(db.changes().orderBy(F.desc("seq")).limit(1), "doc_id")))
    db.clear_changes()
    steps.append(("changes cleared", db.changes().count()))
    steps.append(("encode and decode", decode(encode({"a": [1, None, "é"]})) == {"a": [1, None, "é"]}))
    return _result(spark, steps)


def calls_indexes(spark: SparkSession, root: str) -> DataFrame:
    by_name, by_region, by_word = IndexDefinition("by-name", "variant_get(value, '$.name', 'string')", unique=True), IndexDefinition("by-region", lambda v: v["region"], key_type="uint64"), IndexDefinition("by-word", lambda v: v["words"], multi_valued=True)
    before = list(db_module.INDEX_DEFINITIONS)
    db_module.INDEX_DEFINITIONS[:] = [by_name]
    try:
        db = _open(spark)
    finally:
        db_module.INDEX_DEFINITIONS[:] = before
    steps: list[tuple[str, object]] = [("configured set", ",".join(d.name for d in db.secondary_indexes_for("std")))]
    db.register_index(by_region)
    db.register_index(by_word)
    db.bulk_load(_nations(spark, root))
    keys = lambda index: _joined(db.postings(index).select("key").distinct().orderBy("key"), "key")
    steps.append(("keys in order", keys("by-region")))
    steps.append(("posting list", ",".join(db.index_document_ids("by-region", 2))))
    steps.append(("multi-valued", ",".join(db.index_document_ids("by-word", "UNITED"))))
    steps.append(("select", _joined(db.select_index("by-name", "NATION_7", [F.variant_get("value", "$.region", "bigint").alias("region")]), "id", "region")))
    steps.append(("range", _joined(db.select_index_range("by-region", 3, limit=4, project=[]).withColumn("key", F.col("key").cast("bigint")), "key", "id")))
    db.put_value({"name": "MOVED", "region": 99, "words": []}, "000000000003")
    steps.append(("moved", ",".join(db.index_document_ids("by-region", 99)) + " " + ",".join(db.index_document_ids("by-name", "NATION_3"))))
    steps.append(("unique", _error(lambda: db.put_value({"name": "MOVED", "region": 1, "words": []}, "other"))))
    steps.append(("key of another type", _error(lambda: db.index_document_ids("by-region", "x"))))
    steps.append(("rebuild", f"{db.rebuild_index('by-region')} {db.rebuild_index_fast('by-word')}"))
    db.register_index("by-name", "variant_get(value, '$.none', 'string')", rebuild=True)
    steps.append(("registered again", db.postings("by-name").count()))
    db.clear_index("by-region")
    steps.append(("cleared", db.postings("by-region").count()))
    db.unregister_index("by-region")
    steps.append(("unregistered", _error(lambda: db.postings("by-region"))))
    steps.append(("load into documents", _error(lambda: db.bulk_load([("a", 1)]))))
    return _result(spark, steps)


def calls_graphs(spark: SparkSession, root: str) -> DataFrame:
    db = _open(spark, index_definitions=[])
    nation, region = table(spark, root, "nation"), table(spark, root, "region")
    named = lambda prefix, key: F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 2, "0"))
    links = nation.select(named("e", "n_nationkey").alias("id"), named("n", "n_nationkey").alias("source"), F.lit("in").alias("predicate"), named("r", "n_regionkey").alias("target"), F.col("n_nationkey").cast("bigint").alias("ord"))
    with db.write_transaction():
        db.put_nodes(nation.select(named("n", "n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("props"), F.col("n_nationkey").alias("ord")))
        db.put_nodes([Node({"name": r[0]}, f"r{r[1]:02d}") for r in region.select("r_name", "r_regionkey").orderBy("r_regionkey").collect()])
        db.put_edges(links)
    incoming = lambda node, **how: _joined(db.fetch_node_neighbors(node, incoming=True, **how).orderBy("id"), "id")
    steps: list[tuple[str, object]] = [("node", db.fetch_node("n07").props["name"]), ("no node", db.fetch_node("zz"))]
    steps.append(("nodes in bulk", _joined(db.fetch_bulk_nodes(["r01", "zz", "n02"]).orderBy("ord"), "ord", "id")))
    steps.append(("nodes in order", _joined(db.fetch_graph_nodes().limit(3), "id")))
    steps.append(("edges in order", _joined(db.fetch_graph_edges().limit(3), "id", "source", "target")))
    steps.append(("edge", (lambda e: f"{e.source} {e.predicate} {e.target} {edge_key(e)}")(db.fetch_edge("e05"))))
    steps.append(("incoming", incoming("r02")))
    steps.append(("edge ids by insertion", ",".join(db.fetch_node_edge_ids("r02", incoming=True, predicate="in"))))
    db.put_edge(Edge("n05", "r02", "moved", "e05"))
    steps.append(("replaced edge moves", incoming("r02", predicate="moved")))
    steps.append(("delete edge", db.delete_edge("e05")))
    steps.append(("after it", incoming("r02")))
    steps.append(("delete no edge", db.delete_edge("e99")))
    db.put_edges_triples(links.select("source", "target"))
    steps.append(("triples", db.fetch_node_edges("n05").where("predicate = 'child' and length(id) = 36").count()))
    steps.append(("unknown endpoint", _error(lambda: db.put_edge(Edge("n05", "zz")))))
    steps.append(("delete node", db.delete_node("r02")))
    steps.append(("edges at it", db.edges().where("target = 'r02'").count()))
    steps.append(("delete no node", db.delete_node("r02")))
    db.put_node(Node(None, "n05"), "other")
    steps.append(("other graph", db.fetch_graph_nodes("other").count()))
    steps.append(("clear", db.clear_graph()))
    steps.append(("left", _joined(db.nodes(), "graph", "id")))
    steps.append(("edge in the object only", len(add_node_edge(Node(None, "x"), Edge("x", "y")).edges)))
    return _result(spark, steps)


def calls_views(spark: SparkSession, root: str) -> DataFrame:
    db = _open(spark, index_definitions=[])
    db.bulk_load(_nations(spark, root))
    strict = View("strict", lambda id, value: [(value["name"], id)] if value["region"] != 4 else 1 / 0, reduce=lambda rows: f"{len(rows)} {rows[0][0]}")
    db.add_view(strict)
    steps: list[tuple[str, object]] = [("a mapper fails", "ViewError" if isinstance(_caught(lambda: db.apply_view_to_database(strict)), ViewError) else "none")]
    db.apply_view_to_database(strict, skip_errors=True)
    steps.append(("get", db.view_get(strict, "NATION_7")))
    steps.append(("get a miss", db.view_get(strict, "zz", "nothing")))
    seen: list[str] = []
    steps.append(("map", db.map_view(strict, lambda key, value: seen.append(key), limit=3)))
    steps.append(("in order", ",".join(seen)))
    steps.append(("range", _joined(db.view_rows(strict, "NATION_1", "NATION_2"), "key")))
    steps.append(("reduce by callable", db.reduce_view(strict)))
    db.insert_results(strict, [("a", "1"), ("a", "2")])
    steps.append(("insert", db.view_get(strict, "a")[0]))
    with db.with_views([strict]):
        db.put_value({"name": "NEW", "region": 1}, "new")
    steps.append(("with views", db.view_get(strict, "NEW")[0]))
    steps.append(("no reducer", _error(lambda: db.reduce_view(View("none", lambda id, value: [])))))
    db.clear_view(strict)
    steps.append(("clear", db.view(strict).count()))
    steps.append(("delete", db.delete_view(strict)))
    return _result(spark, steps)


def _caught(call: Callable[[], object]) -> BaseException | None:
    try:
        call()
    except Exception as found:
        return found
    return None


def calls_boundaries(spark: SparkSession, root: str) -> DataFrame:
    db, other = _open(spark, index_definitions=[], durability="metadata-lazy"), _open(spark, index_definitions=[], durability="nosync")
    db.put_bulk(_nations(spark, root), sorted=True)
    steps: list[tuple[str, object]] = [("bulk into an empty collection", db.count)]

    def write_while_reading() -> None:
        with db.read_transaction():
            db.put_value(1, "x")

    def other_database() -> None:
        with db.read_transaction():
            other.fetch("x")

    def aborted() -> None:
        with db.write_transaction():
            db.delete_document("000000000001")
            db.put_value(2, "y")
            raise _Abort

    steps.append(("write while reading", _error(write_while_reading)))
    steps.append(("another database", _error(other_database)))
    _caught(aborted)
    steps.append(("rolled back", f"{db.count} {db.fetch('y')} {db.changes().count()}"))
    with db.read_transaction():
        snapshot = db.documents()
        steps.append(("inside", db.call_with_transaction("read", lambda: snapshot.count())))
    db.put_value(None, "z")
    steps.append(("a snapshot stays", snapshot.count()))
    steps.append(("and the database goes on", db.count))
    steps.append(("mode", _error(lambda: db.call_with_transaction("both", lambda: None))))
    old = db.store.latest()
    db.put_value(1, "w")
    steps.append(("two writers", _error(lambda: db.store.commit(old, {}))))
    db.close()
    steps.append(("closed", f"{db.is_open} {_error(lambda: db.fetch('w'))}"))
    db.open()
    steps.append(("opened again", db.fetch_value("w")))
    steps.append(("durability", _error(lambda: Database(spark, "x", durability="none"))))
    return _result(spark, steps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (calls_documents, calls_indexes, calls_graphs, calls_views, calls_boundaries)}


def _sql(steps: dict[str, str]) -> str:
    """SQL of (step, result); a value is an SQL expression."""
    return " UNION ALL ".join(f"SELECT '{step}' AS step, CAST(({value}) AS VARCHAR) AS result" for step, value in steps.items())


def oracle_sql() -> dict[str, str]:
    region = lambda i: f"SELECT r_name FROM region WHERE r_regionkey = {i}"
    nations = "SELECT lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS id, n_name, n_regionkey FROM nation"
    n, r, e = ("lpad(CAST(n_nationkey AS VARCHAR), 2, '0')", "lpad(CAST(n_regionkey AS VARCHAR), 2, '0')", "lpad(CAST(n_nationkey AS VARCHAR), 2, '0')")
    every = "SELECT count(*) FROM nation"
    listed = lambda column, where, order="id": f"SELECT coalesce(string_agg({column}, ',' ORDER BY {order}), '') FROM ({nations}) WHERE {where}"
    to = lambda where: f"SELECT coalesce(string_agg('n' || {n}, ',' ORDER BY n_nationkey), '') FROM nation WHERE {where}"
    documents = {
        "read your writes": region(1), "changes of a bulk": "'std|0000,std|0001,std|0002,std|0003,std|0004'", "put value": "'0009'", "put json": "'j1'", "generated id": "'True'", "fetch": region(1), "changed": "'True'", "fetch a miss": "'None'", "fetch value": "'last'",
        "fetch bulk values": f"SELECT '0|0002|' || ({region(2)}) || ',1|zz|None,2|0001|' || ({region(1)})", "delete": "'True'", "delete a miss": "'None'",
        "select by callable": "SELECT string_agg(lpad(CAST(r_regionkey AS VARCHAR), 4, '0'), ',' ORDER BY r_regionkey) FROM region WHERE r_name LIKE 'A%' AND r_regionkey NOT IN (3, 4)", "select with offset and limit": "'0001,0002'",
        "primary range": f"SELECT ({region(1)}) || ',' || ({region(2)}) || ',last'", "map in order": "'0000,0001,0002,0003,0009,j1'", "entries": "SELECT count(*) + 1 FROM region", "touched": "'True'", "untouched": "'False'", "last change": "'0002'", "changes cleared": "'0'", "encode and decode": "'True'",
    }
    indexes = {
        "configured set": "'by-name'", "keys in order": "SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT DISTINCT n_regionkey AS k FROM nation)", "posting list": listed("id", "n_regionkey = 2"), "multi-valued": listed("id", "n_name = 'UNITED' OR n_name LIKE 'UNITED %' OR n_name LIKE '% UNITED' OR n_name LIKE '% UNITED %'"),
        "select": listed("id || '|' || CAST(n_regionkey AS VARCHAR)", "n_name = 'NATION_7'"), "range": f"SELECT string_agg(CAST(n_regionkey AS VARCHAR) || '|' || id, ',' ORDER BY n_regionkey, id) FROM (SELECT * FROM ({nations}) WHERE n_regionkey >= 3 ORDER BY n_regionkey, id LIMIT 4)",
        "moved": "SELECT '000000000003 ' || (" + listed("id", "n_name = 'NATION_3' AND id <> '000000000003'") + ")", "unique": "'UniqueViolation'", "key of another type": "'KeyTypeError'",
        "rebuild": f"SELECT ({every}) || ' ' || (SELECT count(*) FROM (SELECT DISTINCT n_nationkey, unnest(string_split(n_name, ' ')) FROM nation WHERE n_nationkey <> 3))", "registered again": "'0'", "cleared": "'0'", "unregistered": "'UnknownIndex'", "load into documents": "'NotEmpty'",
    }
    graphs = {
        "node": "SELECT n_name FROM nation WHERE n_nationkey = 7", "no node": "'None'", "nodes in bulk": "'0|r01,1|None,2|n02'", "nodes in order": "'n00,n01,n02'",
        "edges in order": f"SELECT string_agg('e' || {e} || '|n' || {n} || '|r' || {r}, ',' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3", "edge": f"SELECT 'n05 in r' || {r} || ' e05' FROM nation WHERE n_nationkey = 5",
        "incoming": to("n_regionkey = 2"), "edge ids by insertion": f"SELECT string_agg('e' || {e}, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = 2", "replaced edge moves": "'n05'", "delete edge": "'True'", "after it": to("n_regionkey = 2 AND n_nationkey <> 5"), "delete no edge": "'True'",
        "triples": "'1'", "unknown endpoint": "'UnknownEndpoint'", "delete node": "'True'", "edges at it": "'0'", "delete no node": "'None'", "other graph": "'1'", "clear": "'True'", "left": "'other|n05'", "edge in the object only": "'1'",
    }
    kept = "n_regionkey <> 4"
    views = {
        "a mapper fails": "'ViewError'", "get": f"SELECT coalesce((SELECT '(''' || id || ''', True)' FROM ({nations}) WHERE n_name = 'NATION_7' AND {kept}), '(None, False)')", "get a miss": "'(''nothing'', False)'", "map": "'3'",
        "in order": f"SELECT string_agg(n_name, ',' ORDER BY n_name) FROM (SELECT n_name FROM nation WHERE {kept} ORDER BY n_name LIMIT 3)", "range": f"SELECT coalesce(string_agg(n_name, ',' ORDER BY n_name), '') FROM nation WHERE {kept} AND n_name >= 'NATION_1' AND n_name < 'NATION_2'",
        "reduce by callable": f"SELECT count(*) || ' ' || min(n_name) FROM nation WHERE {kept}", "insert": "'2'", "with views": "'new'", "no reducer": "'ViewReducerMissing'", "clear": "'0'", "delete": "'True'",
    }
    boundaries = {
        "bulk into an empty collection": every, "write while reading": "'TransactionModeError'", "another database": "'TransactionDatabaseError'", "rolled back": f"SELECT ({every}) || ' None 0'", "inside": every, "a snapshot stays": every, "and the database goes on": f"SELECT ({every}) + 1",
        "mode": "'ValueError'", "two writers": "'CommitConflict'", "closed": "'False StoreError'", "opened again": "'1'", "durability": "'ValueError'",
    }
    return {"calls_documents": _sql(documents), "calls_indexes": _sql(indexes), "calls_graphs": _sql(graphs), "calls_views": _sql(views), "calls_boundaries": _sql(boundaries)}
