"""The user's database: documents, indexes, graphs and views over versioned snapshots, with transactions.

Point reads give Python objects, all other reads DataFrames of the snapshot they were made in. A write outside of a boundary is a
transaction of its own. Inside ``write_transaction`` all writes become visible together at its end, to others; inside they
are visible at once. An exception that leaves the boundary leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import contextvars
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework import schemas
from sedgework.errors import NotEmpty, StoreError, TransactionDatabaseError, TransactionModeError, UnknownIndex, ViewError
from sedgework.functions.ids import make_key_id
from sedgework.functions.keys import STRING, UINT64, Expression
from sedgework.functions.text import DEFAULT_PREDICATE
from sedgework.operators import documents as D
from sedgework.operators import graphs as G
from sedgework.operators import indexes as I
from sedgework.operators import views as V
from sedgework.operators.indexes import MAIN, IndexDefinition
from sedgework.sources.scratch import Scratch
from sedgework.sources.store import Snapshot, Store

DURABILITY = ("full", "metadata-lazy", "nosync")

#: A batch of at most so many rows, given as Python objects, looks up what it needs by its keys.
FEW = 1000
#: What a collection's rows are named and sorted by.
DOCUMENT_KEYS, NODE_ORDER = ["id"], ["graph", "id"]
EDGE_ORDER = {"edges": ["graph", "source", "predicate", "id"], "edges_in": ["graph", "target", "predicate", "id"]}

#: Definitions that each database applies when opened, unless it has its own.
INDEX_DEFINITIONS: list[IndexDefinition] = []

_active: contextvars.ContextVar[Transaction | None] = contextvars.ContextVar("active transaction", default=None)


@dataclass
class Document:
    value: object = None
    id: str = field(default_factory=make_key_id)
    changed: bool = False


@dataclass
class Node:
    props: object = None
    id: str = field(default_factory=make_key_id)
    edges: list = field(default_factory=list)


@dataclass
class Edge:
    source: str
    target: str
    predicate: str = DEFAULT_PREDICATE
    id: str = field(default_factory=make_key_id)


def edge_key(edge: Edge) -> str:
    return edge.id


def add_node_edge(node: Node, edge: Edge) -> Node:
    """Put an edge into the node object only; nothing is stored."""
    node.edges.append(edge)
    return node


def encode(value: object) -> str:
    """A value as JSON text."""
    return json.dumps(value, ensure_ascii=False)


def decode(text: str) -> object:
    return json.loads(text)


def _python(value: object) -> object:
    return value.toPython() if hasattr(value, "toPython") else value


def _as_json(kind: T.DataType) -> bool:
    """Whether JSON has the values of a type as they are, so that it can become a variant without becoming text first."""
    if isinstance(kind, T.StructType):
        return all(_as_json(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _as_json(kind.elementType)
    return isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType))


def _of_python(function: Callable) -> Callable:
    return lambda *args: function(*map(_python, args))


class Transaction:
    """A boundary: the snapshot it began with and the versions staged in it."""

    def __init__(self, database: Database, mode: str) -> None:
        self.database, self.mode = database, mode
        self.base: Snapshot = database.store.latest()
        self.staged: dict[str, dict | None] = {}

    def entry(self, keyspace: str) -> dict | None:
        return (self.staged if keyspace in self.staged else self.base.keyspaces).get(keyspace)

    def read(self, keyspace: str, schema: T.StructType) -> DataFrame:
        at = self.entry(keyspace)
        return self.database.spark.createDataFrame([], schema) if at is None else self.database.store.read_staged(at)

    def has(self, keyspace: str) -> bool:
        return self.entry(keyspace) is not None

    def rows(self, keyspace: str) -> int:
        at = self.entry(keyspace)
        return self.database.store.count(at) if at else 0

    def write(self, keyspace: str, rows: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ()) -> None:
        """Put rows in the place of all that is there."""
        meta = (self.entry(keyspace) or {}).get("meta", {})
        self.staged[keyspace] = self.database.store.stage(keyspace, rows, keys, order) | {"meta": meta}

    def change(self, keyspace: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], unique: bool = False, numbers: str | None = None) -> DataFrame:
        """Put rows in the place of those of their keys, or take these away where ``__gone``; what was written, read back. See Store.stage_delta.

        numbers: a column of numbers that are never used again; the keyspace's next one follows the greatest.
        """
        rows = rows if "__gone" in rows.columns else rows.withColumn("__gone", F.lit(False))
        store, at = self.database.store, self.entry(keyspace)
        new, part = store.stage_delta(keyspace, at, rows, keys, order, unique, numbers)
        self.staged[keyspace] = new
        if numbers:
            self.numbered(keyspace, max(self.next_number(keyspace), (part["top"] or 0) + 1))
        return store.read_part(new, part)

    def add(self, keyspace: str, rows: DataFrame) -> None:
        self.staged[keyspace] = self.database.store.stage_more(keyspace, self.entry(keyspace), rows)

    def next_number(self, keyspace: str) -> int:
        """The first number that no row of the keyspace has had."""
        return (self.entry(keyspace) or {}).get("meta", {}).get("next", 1)

    def numbered(self, keyspace: str, following: int) -> None:
        at = self.staged[keyspace]
        self.staged[keyspace] = at | {"meta": {"next": following}}

    def commit(self) -> None:
        if self.staged:
            self.database.store.commit(self.base, self.staged)


class Database:
    """A database in a folder. index_definitions: None for the global ones, a list for its own, an empty one for none."""

    def __init__(
        self, spark: SparkSession, path: str, name: str = "", durability: str = "full", index_definitions: Sequence[IndexDefinition] | None = None,
        max_size: int | None = None, max_dbs: int | None = None, max_readers: int | None = None,
    ) -> None:
        if durability not in DURABILITY:
            raise ValueError(f"durability is one of {', '.join(DURABILITY)}")
        self.spark, self.path, self.name, self.durability = spark, path, name, durability
        self.index_definitions = index_definitions
        self.max_size, self.max_dbs, self.max_readers = max_size, max_dbs, max_readers  # kept for callers; files have no such limits
        self.indexes: dict[str, IndexDefinition] = {}
        self.views: dict[str, V.View] = {}
        self.store: Store | None = None

    # lifecycle

    def open(self, index_definitions: Sequence[IndexDefinition] | None = None) -> Database:
        """Open, or apply other index definitions to an open database; given here they stay for later opens."""
        if index_definitions is not None:
            self.index_definitions = index_definitions
        if self.store is None:
            self.store = Store(self.spark, self.path, self.durability)
        self.indexes = {}
        try:
            for definition in INDEX_DEFINITIONS if self.index_definitions is None else self.index_definitions:
                self.register_index(definition)
        except BaseException:
            self.close()
            raise
        return self

    def close(self) -> None:
        self.store, self.indexes = None, {}

    @property
    def is_open(self) -> bool:
        return self.store is not None

    @property
    def count(self) -> int:
        """Documents of the main collection in the latest snapshot."""
        return self.database_stats()["entries"]

    def __enter__(self) -> Database:
        return self if self.is_open else self.open()

    def __exit__(self, *why: object) -> None:
        self.close()

    # boundaries

    @contextlib.contextmanager
    def _boundary(self, mode: str) -> Iterator[Transaction]:
        if not self.is_open:
            raise StoreError("the database isn't open")
        outer = _active.get()
        if outer is not None:
            if outer.database is not self:
                raise TransactionDatabaseError(outer.database, self)
            if mode == "write" and outer.mode == "read":
                raise TransactionModeError(self, outer.mode, mode)
            if mode == "read" and outer.mode == "write":
                # writes inside a read boundary are errors even if a write boundary is around it
                inner = _ReadView(outer)
                token = _active.set(inner)
                try:
                    yield inner
                finally:
                    _active.reset(token)
                return
            yield outer
            return
        own = Transaction(self, mode)
        token = _active.set(own)
        try:
            yield own
            own.commit()
        finally:
            _active.reset(token)

    def read_transaction(self, database_names: Iterable[str] = ()) -> contextlib.AbstractContextManager[Transaction]:
        """All reads inside see one snapshot. database_names are accepted and not needed."""
        return self._boundary("read")

    def write_transaction(self, database_names: Iterable[str] = ()) -> contextlib.AbstractContextManager[Transaction]:
        return self._boundary("write")

    def call_with_transaction(self, mode: str, function: Callable[[], object]) -> object:
        """function() inside a boundary of mode ``read`` or ``write``; its result."""
        if mode not in ("read", "write"):
            raise ValueError("a boundary is for read or write")
        with self._boundary(mode):
            return function()

    def _read(self, keyspace: str, schema: T.StructType) -> DataFrame:
        with self._boundary("any") as t:
            return t.read(keyspace, schema)

    # documents

    @staticmethod
    def _keyspace(collection: str) -> str:
        return f"doc/{collection}"

    def documents(self, collection: str = MAIN) -> DataFrame:
        """id, value (VARIANT), changed of a collection."""
        return self._read(self._keyspace(collection), schemas.DOCUMENT)

    def _frame(self, documents: DataFrame | Iterable[Document | tuple[str, object]], changed: bool | None) -> DataFrame:
        """id, value, changed, ord. A DataFrame has id and value, value being VARIANT or of any other type, and its ord if ids repeat."""
        if isinstance(documents, DataFrame):
            kind = documents.schema["value"].dataType
            nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
            value = F.col("value") if isinstance(kind, T.VariantType) else F.to_variant_object("value") if nested and _as_json(kind) else F.parse_json(F.to_json("value")) if nested else F.col("value").cast("variant")
            order = F.col("ord") if "ord" in documents.columns else F.lit(0)
            return documents.select("id", value.alias("value"), F.lit(bool(changed)).alias("changed"), order.cast("bigint").alias("ord"))
        last = {}
        for d in documents:
            d = d if isinstance(d, Document) else Document(d[1], d[0])
            last.pop(d.id, None)
            last[d.id] = d
        rows = [(d.id, encode(d.value), d.changed if changed is None else changed, i) for i, d in enumerate(last.values())]
        return self._local(rows, "id string, json string, changed boolean, ord bigint").select("id", F.when(F.col("json") != "null", F.parse_json("json")).alias("value"), "changed", "ord")

    def _local(self, rows: list, schema: str) -> DataFrame:
        """Python rows as a DataFrame of as few partitions as they need."""
        return self.spark.createDataFrame(rows, schema).coalesce(1 + len(rows) // 100_000)

    def _batch(self, documents: DataFrame | Iterable[Document | tuple[str, object]], changed: bool | None) -> DataFrame:
        """_frame with each id once; ids of a DataFrame without ord, which should be unique, are checked when they are written."""
        rows = self._frame(documents, changed)
        return D.last_writes(rows, ["id"], "ord") if isinstance(documents, DataFrame) and "ord" in documents.columns else rows

    def _write_documents(self, t: Transaction, rows: DataFrame, collection: str, track: bool) -> None:
        """rows: id, value, changed, ord; each id once."""
        written = t.change(self._keyspace(collection), rows.select("id", "value", "changed"), DOCUMENT_KEYS, DOCUMENT_KEYS, unique=True)
        for definition in self.secondary_indexes_for(collection):
            self._change_postings(t, definition, I.posting_changes(written, self._own_key(definition)))
        if track:
            # ids are generated once, when the documents are written; a batch of Python objects has its ids already
            self._log(t, rows.select("id", "ord"), collection)

    def _change_postings(self, t: Transaction, definition: IndexDefinition, changes: DataFrame) -> None:
        """Write a delta of postings; of a unique index, check the keys that it has."""
        written = t.change(self._index_keyspace(definition), changes, ["doc_id"], ["key", "doc_id"])
        if definition.unique:
            keys = written.select("key").where(F.col("key").isNotNull())
            few = [r[0] for r in keys.limit(FEW + 1).collect()]
            now = self._postings(t, definition)
            I.check_unique(now.where(F.col("key").isin(few)) if len(few) <= FEW else now.join(keys.distinct(), "key", "left_semi"), definition)

    def put(self, document: Document, collection: str = MAIN) -> Document:
        """Write one document, mark it changed and log its id."""
        with self._boundary("write") as t:
            self._write_documents(t, self._batch([document], True), collection, track=True)
        document.changed = True
        return document

    def put_value(self, value: object, id: str | None = None, collection: str = MAIN) -> Document:
        return self.put(Document(value) if id is None else Document(value, id), collection)

    def put_bulk(self, documents: DataFrame | Iterable[Document | tuple[str, object]], collection: str = MAIN, sorted: bool = False, track_changes: bool = False) -> None:
        """Write many documents in one transaction; of repeated ids the last wins. sorted is a hint without effect."""
        with self._boundary("write") as t:
            self._write_documents(t, self._batch(documents, True if track_changes else None), collection, track_changes)

    def put_json(self, text: str) -> str:
        """Write a JSON object into the main collection; the id is its ``_id``, its ``id`` or a generated one, and is returned."""
        value = decode(text)
        own = [value[k] for k in ("_id", "id") if isinstance(value, dict) and value.get(k) is not None]
        id = own[0] if own and isinstance(own[0], str) else str(own[0]) if own else make_key_id()
        self.put(Document(value, id))
        return id

    def bulk_load(self, documents: DataFrame | Iterable[Document | tuple[str, object]], collection: str = MAIN, track_changes: bool = False) -> None:
        """The first load of a collection, sorted by id, with all its indexes; raises NotEmpty if there are documents."""
        with self._boundary("write") as t:
            if t.rows(self._keyspace(collection)):
                raise NotEmpty(f"collection {collection!r} has documents")
            batch = self._batch(documents, True if track_changes else None)
            order = batch.select("id", "ord") if track_changes else None
            t.staged[self._keyspace(collection)] = None  # an empty keyspace, if there is one, gives way
            t.change(self._keyspace(collection), batch.select("id", "value", "changed").repartitionByRange("id"), DOCUMENT_KEYS, DOCUMENT_KEYS, unique=True)
            for definition in self.secondary_indexes_for(collection):
                self._write_postings(t, definition, I.rebuild_index(t.read(self._keyspace(collection), schemas.DOCUMENT), self._own_key(definition)))
            if order is not None:
                self._log(t, order, collection)

    def fetch(self, id: str, collection: str = MAIN) -> Document | None:
        row = D.fetch(self.documents(collection), id).first()
        return None if row is None else Document(_python(row["value"]), row["id"], row["changed"])

    def fetch_value(self, id: str, collection: str = MAIN) -> object:
        """The value, None for a miss and for a stored null."""
        found = self.fetch(id, collection)
        return None if found is None else found.value

    def fetch_bulk(self, ids: DataFrame | Iterable[str], collection: str = MAIN) -> DataFrame:
        """ord, id, value, changed, found; one row per id asked."""
        asked = ids if isinstance(ids, DataFrame) else D.requested(self.spark, ids)
        return D.fetch_bulk(self.documents(collection), asked)

    def fetch_bulk_values(self, ids: DataFrame | Iterable[str], collection: str = MAIN) -> DataFrame:
        return self.fetch_bulk(ids, collection).select("ord", "id", "value")

    def delete_document(self, id: str, collection: str = MAIN) -> bool | None:
        """True, or None if there was none. Not logged as a change."""
        with self._boundary("write") as t:
            if D.fetch(t.read(self._keyspace(collection), schemas.DOCUMENT), id).isEmpty():
                return None
            gone = self.spark.createDataFrame([(id,)], "id string")
            none = F.lit(None)
            t.change(self._keyspace(collection), gone.select("id", none.cast("variant").alias("value"), none.cast("boolean").alias("changed"), F.lit(True).alias("__gone")), DOCUMENT_KEYS, DOCUMENT_KEYS)
            for definition in self.secondary_indexes_for(collection):
                self._change_postings(t, definition, I.gone_postings(gone, definition))
            return True

    def select(self, where: Column | Callable | None = None, collection: str = MAIN, limit: int = 0, offset: int = 0) -> DataFrame:
        """See operators.documents.select; a callable gets values as Python objects."""
        return D.select(self.documents(collection), where if where is None or isinstance(where, Column) else _of_python(where), limit, offset)

    def select_primary_range(self, start: str, end: str | None = None, collection: str = MAIN, limit: int = 0) -> DataFrame:
        return D.select_primary_range(self.documents(collection), start, end, limit)

    def map_database(self, function: Callable[[str, object], object], collection: str = MAIN) -> None:
        """Call function(id, value) for all documents in order of id, here, partition after partition."""
        for row in self.documents(collection).orderBy("id").toLocalIterator():
            function(row["id"], _python(row["value"]))

    def database_stats(self, collection: str = MAIN) -> dict:
        """From the manifest; after writes that may replace documents, entries are counted by their ids."""
        with self._boundary("any") as t:
            return {"entries": t.rows(self._keyspace(collection)), "snapshot": t.base.number, "keyspaces": sorted(t.base.keyspaces)}

    # change log

    def _log(self, t: Transaction, batch: DataFrame, collection: str) -> None:
        start = t.next_number("changes")
        ordered = batch.repartitionByRange("ord", "id").sortWithinPartitions("ord", "id")
        fresh = ordered.select((F.monotonically_increasing_id() + start).alias("seq"), F.lit(collection).alias("collection"), F.col("id").alias("doc_id"))
        t.add("changes", fresh)
        t.numbered("changes", self._following(t, "changes", "seq", start))

    def _following(self, t: Transaction, keyspace: str, column: str, start: int) -> int:
        """The first number after those that the last part written has in a column."""
        at = t.entry(keyspace)
        return max(start, (self.store.read_part(at, at["parts"][-1]).agg(F.max(column)).first()[0] or 0) + 1)

    def changes(self) -> DataFrame:
        """seq, collection, doc_id of logged changes."""
        return self._read("changes", schemas.CHANGE)

    def touch_document(self, document: Document, collection: str = MAIN) -> Document:
        """Mark changed and log, without writing the document."""
        with self._boundary("write") as t:
            self._log(t, self.spark.createDataFrame([(document.id, 0)], "id string, ord bigint"), collection)
        document.changed = True
        return document

    @staticmethod
    def untouch_document(document: Document) -> Document:
        document.changed = False
        return document

    def clear_changes(self) -> None:
        with self._boundary("write") as t:
            if t.rows("changes"):
                t.write("changes", t.read("changes", schemas.CHANGE).limit(0))

    # indexes

    @staticmethod
    def _index_keyspace(definition: IndexDefinition) -> str:
        return f"idx/{definition.collection}/{definition.name}"

    @staticmethod
    def _own_key(definition: IndexDefinition) -> IndexDefinition:
        return definition if isinstance(definition.key, (Column, str)) else replace(definition, key=_of_python(definition.key))

    def _postings(self, t: Transaction, definition: IndexDefinition) -> DataFrame:
        return t.read(self._index_keyspace(definition), schemas.POSTING_UINT64 if definition.key_type == UINT64 else schemas.POSTING_STRING)

    def _write_postings(self, t: Transaction, definition: IndexDefinition, postings: DataFrame) -> None:
        t.write(self._index_keyspace(definition), I.sorted_for_storage(postings), ["doc_id"], ["key", "doc_id"])
        I.check_unique(self._postings(t, definition), definition)

    def register_index(self, index: IndexDefinition | str, key: Expression | None = None, collection: str = MAIN, key_type: str = STRING, unique: bool = False, multi_valued: bool = False, rebuild: bool = False) -> IndexDefinition:
        """Register by definition, or by name and the rest. An index on documents that are there is empty until rebuilt. A name registered again is replaced."""
        definition = index if isinstance(index, IndexDefinition) else IndexDefinition(index, key, collection, key_type, unique, multi_valued)
        self.indexes[definition.name] = definition
        if rebuild:
            self.rebuild_index(definition.name)
        return definition

    def unregister_index(self, name: str) -> None:
        """Forget the index; its postings stay as they are."""
        self.indexes.pop(name, None)

    def secondary_index(self, name: str) -> IndexDefinition:
        if name not in self.indexes:
            raise UnknownIndex(name)
        return self.indexes[name]

    def secondary_indexes_for(self, collection: str) -> list[IndexDefinition]:
        return [d for d in self.indexes.values() if d.collection == collection]

    def clear_index(self, name: str) -> None:
        definition = self.secondary_index(name)
        with self._boundary("write") as t:
            self._write_postings(t, definition, I.clear_index(self._postings(t, definition)))

    def rebuild_index(self, name: str) -> int:
        """Build the postings anew; how many there are."""
        definition = self.secondary_index(name)
        with self._boundary("write") as t:
            rows = t.read(self._keyspace(definition.collection), schemas.DOCUMENT)
            self._write_postings(t, definition, I.rebuild_index(rows, self._own_key(definition)))
            return t.rows(self._index_keyspace(definition))

    rebuild_index_fast = rebuild_index

    def postings(self, name: str) -> DataFrame:
        definition = self.secondary_index(name)
        with self._boundary("any") as t:
            return self._postings(t, definition)

    def index_document_ids(self, name: str, key: object) -> list[str]:
        """Ids under one key, ascending."""
        found = I.index_document_ids(self.postings(name), self.secondary_index(name), key)
        return [r[0] for r in found.orderBy("id").collect()]

    def index_fetch(self, name: str, key: object) -> DataFrame:
        definition = self.secondary_index(name)
        with self._boundary("any") as t:
            return I.index_fetch(self._postings(t, definition), t.read(self._keyspace(definition.collection), schemas.DOCUMENT), definition, key)

    def select_index(self, name: str, key: object, project: list[Column | str] | None = None) -> DataFrame:
        return self.index_fetch(name, key).select("id", *(project or ["value"]))

    def select_index_range(self, name: str, start: object, end: object = None, limit: int = 0, project: list[Column | str] | None = None) -> DataFrame:
        definition = self.secondary_index(name)
        with self._boundary("any") as t:
            return I.select_index_range(self._postings(t, definition), t.read(self._keyspace(definition.collection), schemas.DOCUMENT), definition, start, end, limit, project)

    # graphs

    def nodes(self) -> DataFrame:
        """graph, id, row_id, props of all graphs."""
        return self._read("nodes", schemas.NODE)

    def edges(self) -> DataFrame:
        return self._read("edges", schemas.EDGE)

    def put_node(self, node: Node, graph: str = G.DEFAULT_GRAPH) -> Node:
        self.put_nodes([node], graph)
        return node

    def put_nodes(self, nodes: DataFrame | Iterable[Node], graph: str = G.DEFAULT_GRAPH, sorted: bool = False) -> None:
        """Write nodes; one that is there keeps its row id. Of repeated ids the last wins. A DataFrame has id and props, and its ord if ids repeat."""
        if isinstance(nodes, DataFrame):
            order = "ord" if "ord" in nodes.columns else None
            batch = nodes.select(F.lit(graph).alias("graph"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("props")).alias("json"), (F.col("ord") if order else F.lit(0)).cast("bigint").alias("ord"))
            batch, few = batch.withColumn("json", F.get_json_object("json", "$.props")), None
            batch = D.last_writes(batch, G.KEY, "ord") if order else batch
        else:
            last = {}
            for n in nodes:
                last.pop(str(n.id), None)
                last[str(n.id)] = n
            order, few = "ord", list(last)
            batch = self._local([(graph, k, encode(n.props), i) for i, (k, n) in enumerate(last.items())], "graph string, id string, json string, ord bigint")
        with self._boundary("write") as t:
            new = G.with_row_ids(self._old(t, "nodes", schemas.NODE, graph, few), batch, order, t.next_number("nodes"))
            t.change("nodes", new.select("graph", "id", "row_id", F.when(F.col("json") != "null", F.parse_json("json")).alias("props")), G.KEY, NODE_ORDER, unique=True, numbers="row_id")

    def _old(self, t: Transaction, keyspace: str, schema: T.StructType, graph: str, ids: Sequence[str] | None) -> DataFrame | None:
        return self._named(t.read(keyspace, schema), graph, ids) if t.has(keyspace) else None

    @staticmethod
    def _named(rows: DataFrame, graph: str, ids: Sequence[str] | None) -> DataFrame:
        """rows, or if ids are few just those of these ids, so that few files are read."""
        return rows if ids is None or len(ids) > FEW else rows.where((F.col("graph") == graph) & F.col("id").isin(list(ids)))

    def fetch_node(self, id: str, graph: str = G.DEFAULT_GRAPH) -> Node | None:
        row = G.fetch(self.nodes(), graph, str(id)).first()
        return None if row is None else Node(_python(row["props"]), row["id"])

    def fetch_bulk_nodes(self, ids: DataFrame | Iterable[str], graph: str = G.DEFAULT_GRAPH) -> DataFrame:
        asked = ids if isinstance(ids, DataFrame) else D.requested(self.spark, map(str, ids))
        return G.fetch_bulk_nodes(self.nodes(), graph, asked)

    def put_edge(self, edge: Edge, graph: str = G.DEFAULT_GRAPH) -> Edge:
        self.put_edges([edge], graph)
        return edge

    def put_edges(self, edges: DataFrame | Iterable[Edge], graph: str = G.DEFAULT_GRAPH) -> None:
        """Write edges whose endpoints are nodes of the graph, else raise UnknownEndpoint and write none. Of repeated ids the last wins.

        A DataFrame has id, source, predicate and target, and its ord if ids repeat.
        """
        if isinstance(edges, DataFrame):
            order = "ord" if "ord" in edges.columns else None
            batch = edges.select(F.lit(graph).alias("graph"), "id", "source", F.coalesce("predicate", F.lit(DEFAULT_PREDICATE)).alias("predicate"), "target", (F.col("ord") if order else F.lit(0)).cast("bigint").alias("ord"))
            self._write_edges(D.last_writes(batch, G.KEY, "ord") if order else batch, graph, order)
            return
        last = {}
        for e in edges:
            last.pop(str(e.id), None)
            last[str(e.id)] = e
        rows = [(graph, k, str(e.source), str(e.predicate), str(e.target), i) for i, (k, e) in enumerate(last.items())]
        ends = list({x for r in rows for x in (r[2], r[4])})
        self._write_edges(self._local(rows, "graph string, id string, source string, predicate string, target string, ord bigint"), graph, "ord", list(last), ends)

    def _write_edges(self, batch: DataFrame, graph: str, order: str | None, ids: Sequence[str] | None = None, ends: Sequence[str] | None = None) -> None:
        with self._boundary("write") as t:
            G.check_endpoints(batch, self._named(t.read("nodes", schemas.NODE), graph, ends))
            new = G.with_row_ids(self._old(t, "edges", schemas.EDGE, graph, ids), batch, order, t.next_number("edges"))
            self._change_edges(t, new.select(*schemas.EDGE.names))

    @staticmethod
    def _change_edges(t: Transaction, rows: DataFrame) -> DataFrame:
        """Write a delta of edges in the order of their sources and, from what was written, in that of their targets."""
        had = t.has("edges")
        written = t.change("edges", rows, G.KEY, EDGE_ORDER["edges"], unique=True, numbers="row_id")
        if had or "__gone" not in rows.columns:
            t.change("edges_in", written, G.KEY, EDGE_ORDER["edges_in"])
        return written

    def put_edges_triples(self, triples: DataFrame | Iterable[Sequence[str]], graph: str = G.DEFAULT_GRAPH) -> None:
        """Edges with generated ids of (source, target) or (source, target, predicate); a DataFrame has these columns, predicate being optional."""
        if isinstance(triples, DataFrame):
            rows = triples if "predicate" in triples.columns else triples.withColumn("predicate", F.lit(None).cast("string"))
            # ids are generated once: written, then used
            self.put_edges(Scratch(self.spark, "triples").keep(G.edges_from_triples(rows, graph), "edges"), graph)
            return
        self.put_edges([Edge(t[0], t[1], t[2] if len(t) > 2 and t[2] is not None else DEFAULT_PREDICATE) for t in triples], graph)

    def fetch_edge(self, id: str, graph: str = G.DEFAULT_GRAPH) -> Edge | None:
        row = G.fetch(self.edges(), graph, str(id)).first()
        return None if row is None else Edge(row["source"], row["target"], row["predicate"], row["id"])

    def fetch_graph_nodes(self, graph: str = G.DEFAULT_GRAPH) -> DataFrame:
        return G.enumerate_graph(self.nodes(), graph).orderBy("id")

    def fetch_graph_edges(self, graph: str = G.DEFAULT_GRAPH) -> DataFrame:
        return G.enumerate_graph(self.edges(), graph).orderBy("id")

    def fetch_node_edges(self, node: str, graph: str = G.DEFAULT_GRAPH, incoming: bool = False, predicate: str | None = None) -> DataFrame:
        return G.node_edges(self._read(self._edges_of(incoming), schemas.EDGE), graph, node, incoming, predicate)

    @staticmethod
    def _edges_of(incoming: bool) -> str:
        return "edges_in" if incoming else "edges"

    def fetch_node_edge_ids(self, node: str, graph: str = G.DEFAULT_GRAPH, incoming: bool = False, predicate: str | None = None) -> list[str]:
        """Ids in order of insertion, neighbor by neighbor."""
        found = self.fetch_node_edges(node, graph, incoming, predicate)
        far = self.nodes().select("graph", F.col("id").alias("__far"), F.col("row_id").alias("__far_row"))
        end = "source" if incoming else "target"
        ordered = found.join(far, (found["graph"] == far["graph"]) & (found[end] == far["__far"])).orderBy("__far_row", "row_id")
        return [r["id"] for r in ordered.select("id").collect()]

    def fetch_node_neighbors(self, node: str, graph: str = G.DEFAULT_GRAPH, incoming: bool = False, predicate: str | None = None) -> DataFrame:
        with self._boundary("any") as t:
            return G.node_neighbors(t.read(self._edges_of(incoming), schemas.EDGE), t.read("nodes", schemas.NODE), graph, node, incoming, predicate)

    def delete_edge(self, edge: Edge | str, graph: str = G.DEFAULT_GRAPH) -> bool:
        """Always True, whether or not the edge was there."""
        gone = self.spark.createDataFrame([(graph, edge.id if isinstance(edge, Edge) else str(edge))], "graph string, id string")
        with self._boundary("write") as t:
            if t.has("edges"):
                self._change_edges(t, self._gone_edges(gone))
        return True

    @staticmethod
    def _gone_edges(gone: DataFrame) -> DataFrame:
        none = F.lit(None)
        return gone.select(*[F.col(f.name) if f.name in G.KEY else none.cast(f.dataType).alias(f.name) for f in schemas.EDGE.fields], F.lit(True).alias("__gone"))

    def delete_node(self, id: str, graph: str = G.DEFAULT_GRAPH) -> bool | None:
        """Delete a node and the edges at it, found through both orders of edges; None if there was none."""
        with self._boundary("write") as t:
            if G.fetch(t.read("nodes", schemas.NODE), graph, str(id)).isEmpty():
                return None
            none = F.lit(None)
            gone = self.spark.createDataFrame([(graph, str(id))], "graph string, id string")
            t.change("nodes", gone.select("graph", "id", none.cast("bigint").alias("row_id"), none.cast("variant").alias("props"), F.lit(True).alias("__gone")), G.KEY, NODE_ORDER)
            if t.has("edges"):
                at = [G.node_edges(t.read(self._edges_of(incoming), schemas.EDGE), graph, str(id), incoming).select(*G.KEY) for incoming in (False, True)]
                self._change_edges(t, self._gone_edges(at[0].unionByName(at[1]).distinct()))
            return True

    def clear_graph(self, graph: str = G.DEFAULT_GRAPH) -> bool:
        with self._boundary("write") as t:
            if t.has("nodes"):
                t.write("nodes", self.store.in_order(G.clear_graph(t.read("nodes", schemas.NODE), graph), NODE_ORDER), G.KEY, NODE_ORDER)
            for keyspace, order in EDGE_ORDER.items() if t.has("edges") else ():
                t.write(keyspace, self.store.in_order(G.clear_graph(t.read(keyspace, schemas.EDGE), graph), order), G.KEY, order)
        return True

    # views

    @staticmethod
    def _view_keyspace(view: V.View) -> str:
        return f"view/{view.name}"

    @staticmethod
    def _own_map(view: V.View) -> V.View:
        return replace(view, map=_of_python(view.map)) if callable(view.map) else view

    def _view_schema(self, view: V.View) -> T.StructType:
        return V.emitted(self.documents(view.source), view).select("key", "value").schema

    def view(self, view: V.View) -> DataFrame:
        """key and value of the view's rows."""
        return self._read(self._view_keyspace(view), self._view_schema(view))

    def add_view(self, view: V.View) -> V.View:
        self.views[view.name] = view
        return view

    def delete_view(self, view: V.View) -> bool:
        """Forget a view and drop its rows."""
        self.views.pop(view.name, None)
        with self._boundary("write") as t:
            if t.has(self._view_keyspace(view)):
                t.staged[self._view_keyspace(view)] = None
        return True

    def clear_view(self, view: V.View) -> None:
        with self._boundary("write") as t:
            t.write(self._view_keyspace(view), t.read(self._view_keyspace(view), self._view_schema(view)).limit(0), ["key"], ["key"])

    def insert_results(self, view: V.View, rows: Iterable[tuple[str, object]]) -> None:
        """Put rows into a view; of repeated keys the last wins."""
        schema = self._view_schema(view)
        new = self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*schema.fields, T.StructField("ord", T.LongType())]))
        with self._boundary("write") as t:
            t.change(self._view_keyspace(view), D.last_writes(new, ["key"], "ord").select("key", "value"), ["key"], ["key"])

    def apply_view_to_database(self, view: V.View, skip_errors: bool = False) -> None:
        """Build a view anew. A failing mapper raises ViewError, or its document is skipped."""
        try:
            with self._boundary("write") as t:
                t.write(self._view_keyspace(view), V.rebuild(t.read(self._keyspace(view.source), schemas.DOCUMENT), self._own_map(view), skip_errors).sortWithinPartitions("key"), ["key"], ["key"])
        except StoreError:
            raise
        except Exception as cause:
            raise ViewError(view, cause) from cause

    def apply_view(self, view: V.View, changed: DataFrame | Iterable[str]) -> None:
        """Map just the documents of changed, ids or (seq, doc_id) rows, into the view."""
        if not isinstance(changed, DataFrame):
            changed = self.spark.createDataFrame(list(enumerate(changed)), "seq bigint, doc_id string")
        with self._boundary("write") as t:
            t.change(self._view_keyspace(view), V.fresh(t.read(self._keyspace(view.source), schemas.DOCUMENT), changed, self._own_map(view)), ["key"], ["key"])

    @contextlib.contextmanager
    def with_views(self, views: Sequence[V.View]) -> Iterator[Database]:
        """After a normal end of the body the views take in all logged changes of their sources, and the log is cleared, in one transaction."""
        yield self
        with self._boundary("write") as t:
            for view in views:
                changed = t.read("changes", schemas.CHANGE).where(F.col("collection") == view.source).select("seq", "doc_id")
                self.apply_view(view, changed)
            self.clear_changes()

    def view_get(self, view: V.View, key: str, default: object = None) -> tuple[object, bool]:
        """(value, True), or (default, False)."""
        row = V.get(self.view(view), key).first()
        return (default, False) if row is None else (_python(row["value"]), True)

    def view_rows(self, view: V.View, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return V.select_rows(self.view(view), start, end, limit).orderBy("key")

    def map_view(self, view: V.View, function: Callable[[str, object], object], start: str | None = None, end: str | None = None, limit: int | None = None) -> int:
        """Call function(key, value) for the rows in order of key; how many."""
        n = 0
        for row in self.view_rows(view, start, end, limit).toLocalIterator():
            function(row["key"], _python(row["value"]))
            n += 1
        return n

    def reduce_view(self, view: V.View, start: str | None = None, end: str | None = None, limit: int | None = None) -> object:
        return _python(V.reduce(V.select_rows(self.view(view), start, end, limit), view).first()[0])


class _ReadView(Transaction):
    """A read boundary inside a write boundary: sees what is staged there."""

    def __init__(self, outer: Transaction) -> None:
        self.database, self.mode, self.base, self.staged = outer.database, "read", outer.base, outer.staged
