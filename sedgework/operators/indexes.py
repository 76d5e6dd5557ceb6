"""Secondary indexes: posting tables of (key, doc_id), and what is read through them.

A posting table is an ordinary DataFrame. Equal (key, doc_id) pairs are kept once, so is a key that a
multi-valued document repeats; a null key is not indexed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.errors import UniqueViolation
from sedgework.functions.keys import SPARK_TYPE, STRING, Expression, as_column, check_key_type, checked_key, key_column, literal_key

MAIN = "std"


@dataclass(frozen=True)
class IndexDefinition:
    """How to index a collection. key: a Column or a SQL expression over the documents, or a callable of the document's value."""

    name: str
    key: Expression
    collection: str = MAIN
    key_type: str = STRING
    unique: bool = False
    multi_valued: bool = False

    def __post_init__(self) -> None:
        check_key_type(self.key_type)
        if not isinstance(self.name, str) or not self.name:
            raise TypeError("an index has a name")
        if not (isinstance(self.key, (Column, str)) or callable(self.key)):
            raise TypeError("an index key is a Column, a SQL expression or a callable")


def index_keys(documents: DataFrame, definition: IndexDefinition) -> DataFrame:
    """(key, doc_id) of each document and key, repeats included: what the key expression yields, without nulls."""
    key = definition.key if isinstance(definition.key, (Column, str)) else checked_key(definition.key, definition.key_type, definition.multi_valued)
    raw = as_column(key, T.ArrayType(T.StringType()) if definition.multi_valued else T.StringType(), "value")
    if definition.multi_valued:
        rows = documents.select(F.explode(raw).alias("key"), F.col("id").alias("doc_id"))
    else:
        rows = documents.select(raw.alias("key"), F.col("id").alias("doc_id"))
    return rows.select(key_column(F.col("key"), definition.key_type).alias("key"), "doc_id").where(F.col("key").isNotNull())


def build_postings(documents: DataFrame, definition: IndexDefinition) -> DataFrame:
    """The posting table of all documents. Empty input gives an empty table."""
    keys = index_keys(documents, definition)
    return keys.distinct() if definition.multi_valued else keys


def rebuild_index(documents: DataFrame, definition: IndexDefinition) -> DataFrame:
    return build_postings(documents, definition)


def rebuild_index_fast(documents: DataFrame, definition: IndexDefinition) -> DataFrame:
    """As rebuild_index; a grouped build differs from a streaming one in nothing that Spark's planner wouldn't choose itself."""
    return build_postings(documents, definition)


def sorted_for_storage(postings: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by (key, doc_id), so that files prune by key. A heavy key spreads over many partitions."""
    return postings.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")


def unique_violations(postings: DataFrame) -> DataFrame:
    """Keys held by more than one document: key, holders. min and max of the id tell that without gathering ids."""
    spans = postings.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return postings.join(spans, "key", "left_semi").groupBy("key").agg(F.count_distinct("doc_id").alias("holders"))


def check_unique(postings: DataFrame, definition: IndexDefinition) -> None:
    """Raise UniqueViolation if the index is unique and some key has two documents."""
    if definition.unique:
        bad = postings.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("key").take(1)
        if bad:
            raise UniqueViolation(definition.name, bad[0][0])


def update_postings(postings: DataFrame, written: DataFrame, definition: IndexDefinition, ids: DataFrame | None = None) -> DataFrame:
    """Postings after documents were written: those of the written ids are replaced. ids: further ids (column id) whose postings go, as of deleted documents."""
    gone = written.select(F.col("id").alias("doc_id"))
    if ids is not None:
        gone = gone.unionByName(ids.select(F.col("id").alias("doc_id")))
    return postings.join(gone, "doc_id", "left_anti").select("key", "doc_id").unionByName(build_postings(written, definition))


def posting_changes(written: DataFrame, definition: IndexDefinition) -> DataFrame:
    """What written documents change in a posting table, as a delta: key, doc_id and ``__gone``, a row for each posting and one that takes away what the document had."""
    new = build_postings(written, definition).withColumn("__gone", F.lit(False))
    return new.unionByName(gone_postings(written.select("id"), definition))


def gone_postings(ids: DataFrame, definition: IndexDefinition) -> DataFrame:
    return ids.select(F.lit(None).cast(SPARK_TYPE[definition.key_type]).alias("key"), F.col("id").alias("doc_id"), F.lit(True).alias("__gone"))


def clear_index(postings: DataFrame) -> DataFrame:
    return postings.limit(0)


def index_document_ids(postings: DataFrame, definition: IndexDefinition, key: object) -> DataFrame:
    """Ids under one key; whether the documents exist is not checked. Column id."""
    return postings.where(F.col("key") == literal_key(key, definition.key_type)).select(F.col("doc_id").alias("id"))


def index_fetch(postings: DataFrame, documents: DataFrame, definition: IndexDefinition, key: object) -> DataFrame:
    """Documents under one key. Postings of documents that are gone yield nothing; the key is not checked again."""
    return documents.join(index_document_ids(postings, definition, key), "id", "left_semi")


def select_index(postings: DataFrame, documents: DataFrame, definition: IndexDefinition, key: object, project: list[Column | str] | None = None) -> DataFrame:
    found = index_fetch(postings, documents, definition, key)
    return found.select("id", *(project or ["value"]))


def select_index_range(
    postings: DataFrame, documents: DataFrame, definition: IndexDefinition, start: object, end: object = None, limit: int = 0, project: list[Column | str] | None = None
) -> DataFrame:
    """One row per posting whose key is from start to end, both inclusive; no end is open. Dangling postings don't count.

    limit takes the first by (key, id); 0 or less is no limit. Columns: key, id and the projection.
    """
    within = F.col("key") >= literal_key(start, definition.key_type)
    if end is not None:
        within &= F.col("key") <= literal_key(end, definition.key_type)
    rows = postings.where(within).withColumnRenamed("doc_id", "id").join(documents, "id")
    rows = rows.select("key", "id", *(project or ["value"]))
    return rows.orderBy("key", "id").limit(limit) if limit > 0 else rows


def _named(name: str) -> Callable[[Column], Column]:
    return lambda key: F.struct(F.lit(name).alias("name"), key.alias("key"))


def keys_of_definitions(documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, doc_id, key) of all rows of documents under the latest definition of each index, repeats included.

    definitions: name, key_fn (``value.<field>``), collection, registered_at; one row per registration. They are
    metadata and come to the driver. Of registrations at one time the one last by key_fn and collection holds.
    Definitions whose field doesn't exist, and null names, give nothing. Null gives no key, a list one key per non-null
    element, anything else its text. One scan serves all indexes.
    """
    last = Window.partitionBy("name").orderBy(F.desc("registered_at"), F.desc("key_fn"), F.desc("collection"))
    latest = definitions.where(F.col("name").isNotNull()).withColumn("__n", F.row_number().over(last)).where(F.col("__n") == 1)
    kinds = {f.name: f.dataType for f in documents.schema["value"].dataType.fields}
    pairs = []
    for name, key_fn, collection in sorted(tuple(r) for r in latest.select("name", "key_fn", "collection").collect() if r[1] and r[2] is not None):
        field = key_fn.removeprefix("value.")
        if not key_fn.startswith("value.") or field not in kinds:
            continue
        value = F.col("value").getField(field)
        text = value.cast("array<string>") if isinstance(kinds[field], T.ArrayType) else F.array(value.cast("string"))
        own = F.transform(text, _named(name))
        pairs.append(F.when((F.col("collection") == collection) & text.isNotNull(), own).otherwise(F.array().cast("array<struct<name:string,key:string>>")))
    if not pairs:
        return documents.select(F.lit("").alias("name"), F.col("id").alias("doc_id"), F.lit("").alias("key")).limit(0)
    rows = documents.select(F.col("id").alias("doc_id"), F.explode(F.concat(*pairs)).alias("k"))
    return rows.select("k.name", "doc_id", "k.key").where(F.col("key").isNotNull())
