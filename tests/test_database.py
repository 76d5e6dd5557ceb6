from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgework import database as dbm
from sedgework.database import Database, Document, Edge, Node
from sedgework.errors import NotEmpty, StoreError, TransactionDatabaseError, TransactionModeError, UniqueViolation, UnknownEndpoint, UnknownIndex, ViewError, ViewReducerMissing
from sedgework.operators.indexes import IndexDefinition
from sedgework.operators.views import View

DTYPE = IndexDefinition("dtype", lambda v: v.get("dtype") if isinstance(v, dict) else None)


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as found:
        yield found


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_documents(db):
    db.put(Document("test", "test-er"))
    made = db.put_value("test")
    assert made.changed and len(made.id) == 36
    db.put_value("test-insert1", "test02")
    assert db.fetch("test-er").value == "test" and db.fetch("test-er").changed
    assert (db.fetch_value(made.id), db.fetch_value("test02"), db.fetch("none"), db.fetch_value("none")) == ("test", "test-insert1", None, None)
    db.put_bulk([*((str(i), "bulk-insert") for i in range(1001)), *((str(i), 0) for i in range(1001, 2001)), ("1500", 7)])
    assert (db.fetch_value("1"), db.fetch_value("1500")) == ("bulk-insert", 7)
    found = db.fetch_bulk(["7", "missing", "3", "7"]).orderBy("ord").collect()
    assert [(r["id"], r["found"]) for r in found] == [("7", True), ("missing", False), ("3", True), ("7", True)]
    assert db.database_stats()["entries"] == 2004
    assert db.delete_document("7") is True and db.delete_document("7") is None and db.fetch("7") is None
    assert [r[0] for r in db.changes().orderBy("seq").select("doc_id").collect()] == ["test-er", made.id, "test02"]
    db.clear_changes()
    assert db.changes().count() == 0


def test_select_ranges_json_and_scan(db):
    db.put_bulk([(k, v) for k, v in zip("abcdef", [1, 2, 3, None, 5, 6], strict=True)])
    assert ids(db.select()) == list("abcef")
    number = F.variant_get("value", "$", "int")
    assert [r["id"] for r in db.select(number > 1, limit=2, offset=1).collect()] == ["c", "e"]
    assert ids(db.select(lambda id, v: v is not None and v % 2 == 1)) == ["a", "c", "e"]
    assert ids(db.select(number > 1, limit=0)) == list("bcef")
    assert ids(db.select_primary_range("b", "c")) == ["b", "c"] and ids(db.select_primary_range("b", limit=2)) == ["b", "c"]
    assert db.put_json('{"_id": "x", "id": "y", "k": 1}') == "x" and db.put_json('{"id": "y"}') == "y" and len(db.put_json("{}")) == 36
    assert db.fetch_value("x") == {"_id": "x", "id": "y", "k": 1}
    seen = []
    db.map_database(lambda id, v: seen.append((id, v)))
    assert seen[0][1] == {} or seen[0] == ("a", 1)
    assert [s for s in seen if s[0] in "abcdef"] == list(zip("abcdef", [1, 2, 3, None, 5, 6], strict=True))


def test_indexes(db):
    db.register_index(DTYPE)
    db.put_bulk([("p1", {"dtype": "person"}), ("p2", {"dtype": "person"}), ("o1", {"dtype": "organization"}), ("n", {"other": 1})])
    assert db.index_document_ids("dtype", "person") == ["p1", "p2"]
    db.put(Document({"dtype": "organization"}, "p2"))
    assert db.index_document_ids("dtype", "person") == ["p1"] and db.index_document_ids("dtype", "organization") == ["o1", "p2"]
    assert [r["d"] for r in db.select_index("dtype", "person", [F.variant_get("value", "$.dtype", "string").alias("d")]).collect()] == ["person"]
    assert [(r["key"], r["id"]) for r in db.select_index_range("dtype", "organization", "person", limit=2).collect()] == [("organization", "o1"), ("organization", "p2")]
    db.delete_document("o1")
    assert db.index_document_ids("dtype", "organization") == ["p2"]
    db.clear_index("dtype")
    assert db.index_document_ids("dtype", "person") == []
    assert db.rebuild_index("dtype") == 2 and db.index_document_ids("dtype", "organization") == ["p2"]
    with pytest.raises(UnknownIndex):
        db.index_fetch("nope", "x")
    db.unregister_index("dtype")
    with pytest.raises(UnknownIndex):
        db.index_document_ids("dtype", "person")


def test_bulk_load(db):
    db.register_index(DTYPE)
    db.bulk_load([("p2", {"dtype": "person"}), ("o1", {"dtype": "organization"}), ("p1", {"dtype": "person", "name": "Ada"})])
    assert db.index_document_ids("dtype", "person") == ["p1", "p2"] and db.fetch_value("p1")["name"] == "Ada"
    with pytest.raises(NotEmpty):
        db.bulk_load([("q", {})])
    assert db.fetch("q") is None


def test_unique_index(db):
    db.register_index("email", "variant_get(value, '$.email', 'string')", unique=True)
    with pytest.raises(UniqueViolation):
        db.put_bulk([("a", {"email": "x@y"}), ("b", {"email": "x@y"})])
    assert db.documents().count() == 0 and db.postings("email").count() == 0
    db.put_bulk([("a", {"email": "x@y"})])
    db.put(Document({"email": "x@y", "again": True}, "a"))
    with pytest.raises(UniqueViolation):
        db.put(Document({"email": "x@y"}, "b"))
    assert db.index_document_ids("email", "x@y") == ["a"] and db.fetch("b") is None


def test_uint64_and_multi_valued(db):
    db.register_index("n", lambda v: v["n"], key_type="uint64")
    db.register_index("tags", "CAST(variant_get(value, '$.tags') AS ARRAY<STRING>)", multi_valued=True)
    db.put_bulk([("a", {"n": 0, "tags": ["t", "t", "u"]}), ("b", {"n": 2**63 - 1, "tags": []}), ("c", {"n": 5, "tags": None})])
    assert db.index_document_ids("n", 2**63 - 1) == ["b"] and db.index_document_ids("n", 2**64 - 1) == []
    assert [(int(r["key"]), r["id"]) for r in db.select_index_range("n", 0, 5).orderBy("key").collect()] == [(0, "a"), (5, "c")]
    assert sorted(map(tuple, db.postings("tags").collect())) == [("t", "a"), ("u", "a")]
    for bad in (-1, 2**64, "5", True):
        with pytest.raises(TypeError):
            db.index_document_ids("n", bad)


def test_graph(db):
    db.put_nodes([Node({"name": n}, n) for n in "abc"])
    db.put_edges([Edge("a", "b", "knows", "e1"), Edge("a", "c", "knows", "e2"), Edge("a", "c", "works-with", "e3")])
    assert db.fetch_node_edge_ids("a") == ["e1", "e2", "e3"] and db.fetch_node_edge_ids("a", predicate="knows") == ["e1", "e2"]
    assert ids(db.fetch_node_neighbors("a", predicate="knows")) == ["b", "c"] and ids(db.fetch_node_neighbors("c", incoming=True, predicate="works-with")) == ["a"]
    assert ids(db.fetch_node_neighbors("a")) == ["b", "c", "c"]
    db.put_edge(Edge("a", "b", "knows", "e4"))
    assert db.delete_edge(Edge("a", "b", "knows", "e1")) is True and db.delete_edge("absent") is True
    assert db.fetch_node_edge_ids("a", predicate="knows") == ["e4", "e2"]
    db.put_edge(Edge("a", "c", "works-with", "e4"))
    assert ids(db.fetch_node_edges("b", incoming=True)) == [] and db.fetch_edge("e4").target == "c"
    with pytest.raises(UnknownEndpoint):
        db.put_edges([Edge("a", "b", id="ok"), Edge("a", "zz", id="bad")])
    assert db.fetch_edge("ok") is None
    rows = {r["id"]: r["row_id"] for r in db.nodes().collect()}
    db.put_node(Node({"name": "new"}, "a"))
    assert {r["id"]: r["row_id"] for r in db.nodes().collect()} == rows and db.fetch_node("a").props == {"name": "new"}
    bulk = db.fetch_bulk_nodes(["b", "zz", "a"]).orderBy("ord").collect()
    assert [r["id"] for r in bulk] == ["b", None, "a"]
    db.put_edges_triples([("a", "b", None), ("b", "c", "near")])
    assert db.fetch_graph_edges().count() == 5 and {r["predicate"] for r in db.fetch_graph_edges().collect()} == {"knows", "works-with", "child", "near"}


def test_graph_namespaces_and_lifecycle(db):
    for graph in ("one", "two"):
        db.put_nodes([Node({"graph": graph}, n) for n in ("target", "same", "b")], graph)
    db.put_edges([Edge("same", "target", id="ab-1"), Edge("same", "target", id="ab-2"), Edge("b", "target", id="bc")], "one")
    db.put_edge(Edge("same", "b", id="ab-1"), "two")
    assert db.fetch_node("same", "one").props == {"graph": "one"} and ids(db.fetch_node_neighbors("same", "two")) == ["b"]
    assert [r["id"] for r in db.fetch_graph_nodes("one").collect()] == ["b", "same", "target"]
    assert db.delete_node("same", "one") is True and db.delete_node("same", "one") is None
    assert ids(db.fetch_graph_edges("one")) == ["bc"] and ids(db.fetch_node_edges("target", "one", incoming=True)) == ["bc"]
    with pytest.raises(RuntimeError), db.write_transaction():
        db.clear_graph("two")
        assert db.fetch_graph_nodes("two").count() == 0
        raise RuntimeError
    assert db.fetch_graph_nodes("two").count() == 3
    assert db.clear_graph("one") is True and db.fetch_graph_nodes("one").count() == 0 and db.fetch_graph_edges("two").count() == 1


def test_transactions(spark, tmp_path, db):
    db.register_index(DTYPE)
    with db.write_transaction(["metadata", "journal"]):
        db.put(Document({"dtype": "person"}, "p"))
        db.put_nodes([Node(None, "a"), Node(None, "b")])
        db.put_edge(Edge("a", "b", id="e"))
        db.put_bulk([("m", {"revision": 7})], "metadata")
        db.put_bulk([("j", {"operation": "commit"})], "journal")
        with db.read_transaction():
            assert db.fetch("p") is not None
            with pytest.raises(TransactionModeError):
                db.put_value(1, "q")
    number = db.database_stats()["snapshot"]
    assert number == 1
    for _ in range(2):
        assert (db.fetch_value("m", "metadata"), db.fetch_value("j", "journal")) == ({"revision": 7}, {"operation": "commit"})
        assert db.index_document_ids("dtype", "person") == ["p"] and db.fetch_edge("e").source == "a"
        db.close()
        with pytest.raises(StoreError):
            db.fetch("p")
        db.open([DTYPE])
    with pytest.raises(ValueError), db.write_transaction():
        db.put(Document({"dtype": "person"}, "gone"))
        db.put_edge(Edge("b", "a", "other", "e"))
        raise ValueError
    assert db.fetch("gone") is None and db.fetch_edge("e").source == "a" and db.index_document_ids("dtype", "person") == ["p"]
    assert db.database_stats()["snapshot"] == number and db.changes().count() == 1
    with Database(spark, str(tmp_path / "other")) as other:
        with pytest.raises(TransactionDatabaseError), db.write_transaction():
            db.put_value(1, "x")
            other.put_value(1, "x")
        assert db.fetch("x") is None and other.fetch("x") is None
    with db.read_transaction():
        before = db.documents().count()
        with pytest.raises(TransactionModeError):
            db.put_value(2, "y")
        assert db.documents().count() == before
    with pytest.raises(ValueError):
        Database(spark, str(tmp_path / "z"), durability="none")


def test_index_definitions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "defs")
    monkeypatch.setattr(dbm, "INDEX_DEFINITIONS", [DTYPE])
    with Database(spark, path) as db:
        db.put(Document({"dtype": "person"}, "p"))
    with Database(spark, path) as db:
        assert db.index_document_ids("dtype", "person") == ["p"]
    other = IndexDefinition("other", lambda v: v.get("x"))
    with Database(spark, path, index_definitions=[other]) as db:
        assert set(db.indexes) == {"other"}
        db.open([])
        assert not db.indexes
        db.close()
        assert not db.open().indexes


PEOPLE = View("people", lambda id, v: [(id, v["name"])] if v["dtype"] == "person" else [], reduce=len, value_type="string")


def test_views(db):
    db.put_bulk([("p1", {"dtype": "person", "name": "Ada"}), ("p3", {"dtype": "person", "name": "Cy"}), ("o1", {"dtype": "organization", "name": "Org"})])
    view = db.add_view(View("people", PEOPLE.map, reduce="CAST(count(1) AS STRING)"))
    db.apply_view_to_database(view)
    assert db.view_get(view, "p1") == ("Ada", True) and db.view_get(view, "o1", "none") == ("none", False)
    assert [r["key"] for r in db.view_rows(view).collect()] == ["p1", "p3"]
    assert [r["key"] for r in db.view_rows(view, "p1", "p3").collect()] == ["p1"] and [r["key"] for r in db.view_rows(view, "p3", limit=1).collect()] == ["p3"]
    assert db.view_rows(view, limit=0).count() == 0
    with pytest.raises(ValueError):
        db.view_rows(view, limit=-1)
    assert db.map_view(view, lambda k, v: None) == 2
    assert (db.reduce_view(view), db.reduce_view(view, "p2")) == ("2", "1")
    with db.with_views([view]):
        db.put(Document({"dtype": "organization", "name": "Ada"}, "p1"))
        db.put(Document({"dtype": "person", "name": "Bo"}, "p2"))
    assert [r["key"] for r in db.view_rows(view).collect()] == ["p1", "p2", "p3"]  # p1 is stale until rebuilt
    assert db.changes().count() == 0
    db.apply_view_to_database(view)
    assert [r["key"] for r in db.view_rows(view).collect()] == ["p2", "p3"]
    db.insert_results(view, [("k", "1"), ("k", "2")])
    assert db.view_get(view, "k") == ("2", True)
    with pytest.raises(ViewReducerMissing):
        db.reduce_view(View("people", PEOPLE.map))
    db.clear_view(view)
    assert db.view_rows(view).count() == 0
    assert db.delete_view(view) is True and "people" not in db.views


def test_view_errors(db):
    db.put_bulk([("a", {"name": "x"}), ("b", {}), ("c", {"name": "z"})])
    fails = View("fails", lambda id, v: [(id, v["name"])])
    with pytest.raises(ViewError):
        db.apply_view_to_database(fails)
    db.apply_view_to_database(fails, skip_errors=True)
    assert [r["key"] for r in db.view_rows(fails).collect()] == ["a", "c"]


def test_vacuum_and_conflict(db):
    for i in range(3):
        db.put_value(i, "x")
    from sedgework.errors import CommitConflict

    old = db.store.snapshot(1)
    with pytest.raises(CommitConflict):
        db.store.commit(old, {})
    db.clear_changes()
    assert db.store.vacuum(keep=1) > 0
    assert db.fetch_value("x") == 2


def _bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file() and "manifest" not in f.parts)


def test_a_write_costs_what_it_writes(spark, tmp_path):
    """Bytes of one put don't depend on the documents that are there; deltas are merged and stay right."""
    written = {}
    for n in (200, 20_000):
        root = tmp_path / str(n)
        db = Database(spark, str(root), index_definitions=[IndexDefinition("n", "variant_get(value, '$.n', 'bigint')", key_type="uint64")]).open()
        db.bulk_load(spark.range(n).selectExpr("lpad(id, 8, '0') AS id", "named_struct('n', id) AS value"))
        before = _bytes(root)
        db.put_value({"n": 7}, "00000005")
        written[n] = _bytes(root) - before
    assert written[20_000] <= 1.5 * written[200]
    for i in range(9):
        db.put_value({"n": 100_000 + i % 2}, f"0000001{i}")
    assert len(db.store.latest().keyspaces["doc/std"]["parts"]) <= 9
    assert db.count == 20_000 and db.index_document_ids("n", 100_001) == ["00000011", "00000013", "00000015", "00000017"]
    assert db.index_document_ids("n", 7) == ["00000005", "00000007"] and db.index_document_ids("n", 11) == []


def test_deltas_are_merged_with_a_small_base(spark, tmp_path):
    db = Database(spark, str(tmp_path), index_definitions=[]).open()
    for i in range(20):
        db.put_value(i, f"k{i % 12:02d}")
        if i == 18:
            db.delete_document("k05")
    assert [(r["id"], str(r["value"])) for r in db.documents().orderBy("id").collect()] == [(f"k{j:02d}", str(j + 12 if j < 8 else j)) for j in range(12) if j != 5]
    assert db.count == 11 and [r["seq"] for r in db.changes().orderBy("seq").collect()] == list(range(1, 21))
    assert len(db.store.latest().keyspaces["changes"]["parts"]) <= 9


def test_edges_in_both_orders(spark, tmp_path):
    db = Database(spark, str(tmp_path), index_definitions=[]).open()
    db.put_nodes([Node(None, x) for x in "abc"])
    db.put_edges([Edge("a", "b", "p", "1"), Edge("c", "b", "p", "2"), Edge("b", "b", "p", "3")])
    assert [r["id"] for r in db.fetch_node_neighbors("b", incoming=True).orderBy("id").collect()] == ["a", "b", "c"]
    db.put_edge(Edge("a", "c", "p", "1"))
    assert [r["id"] for r in db.fetch_node_neighbors("b", incoming=True).orderBy("id").collect()] == ["b", "c"]
    assert [r["id"] for r in db.fetch_node_neighbors("c", incoming=True).collect()] == ["a"]
    db.delete_node("b")
    assert [r["id"] for r in db.edges().collect()] == ["1"] and db.fetch_node_edges("b", incoming=True).count() == 0
    assert db.fetch_node_edge_ids("c", incoming=True) == ["1"]
