"""Documents by key: (id, value) rows and any further columns. Ids are unique; ids and their order are those of strings by byte."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.functions.ids import generated_id


def _atomic(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_atomic(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _atomic(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def last_writes(batch: DataFrame, keys: Sequence[str], ordinal: str | Column) -> DataFrame:
    """Of the rows of each key the one with the greatest ordinal, null being least. Of equal ordinals one is chosen by a hash of the row, so always the same.

    Aggregated with partial results, so a key that a third of the rows have makes no task longer.
    """
    hashed = [F.col(f.name) if _atomic(f.dataType) else F.to_json(F.struct(f.name)) for f in batch.schema.fields if f.name != ordinal]
    order = F.struct(F.col(ordinal) if isinstance(ordinal, str) else ordinal, F.xxhash64(*hashed))
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("__row"))
    return best.select(*keys, "__row.*").select(*batch.columns)


def scan(documents: DataFrame) -> DataFrame:
    """All documents, in no order; sort by id if the order matters."""
    return documents


def select(documents: DataFrame, where: Column | Callable | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Documents that where holds for, by default those whose value isn't null.

    where: a Column, which reaches the scan, or a callable of (id, value). offset skips and limit ends by order of id;
    a limit of 0 or less is none.
    """
    if where is None:
        where = F.col("value").isNotNull()
    elif not isinstance(where, Column):
        where = F.udf(where, "boolean")("id", "value")
    found = documents.where(where)
    if limit > 0 or offset > 0:
        found = found.orderBy("id")
        found = found.offset(offset) if offset > 0 else found
        found = found.limit(limit) if limit > 0 else found
    return found


def select_primary_range(documents: DataFrame, start: str, end: str | None = None, limit: int = 0) -> DataFrame:
    """Documents with ids from start to end, both inclusive; no end is open, a limit of 0 or less none."""
    within = F.col("id") >= start
    if end is not None:
        within &= F.col("id") <= end
    found = documents.where(within)
    return found.orderBy("id").limit(limit) if limit > 0 else found


def fetch(documents: DataFrame, id: str) -> DataFrame:
    """The document of that id, or no row."""
    return documents.where(F.col("id") == id)


def requested(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    """(ord, id) of the ids in their order."""
    return spark.createDataFrame(list(enumerate(ids)), "ord bigint, id string")


def fetch_bulk(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per row of ids (ord, id), repeats and misses kept: ord, id, the document's columns, found. Sort by ord for the order asked."""
    rows = documents.withColumn("found", F.lit(True))
    return ids.select("ord", "id").join(rows, "id", "left").withColumn("found", F.coalesce("found", F.lit(False))).select("ord", "id", *[c for c in documents.columns if c != "id"], "found")


def upsert(documents: DataFrame, batch: DataFrame, ordinal: str | None = None) -> DataFrame:
    """documents after batch was written: rows of an id are replaced as a whole. Within a batch the greatest ordinal wins; without an ordinal its ids must be unique."""
    new = last_writes(batch, ["id"], ordinal) if ordinal else batch
    return documents.join(new.select("id"), "id", "left_anti").select(*documents.columns).unionByName(new.select(*documents.columns))


def delete(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents without those of ids (column id); absent ids do nothing, null ids match nothing."""
    return documents.join(ids.select("id"), "id", "left_anti")


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """id, value (VARIANT) and changed of JSON texts: the id is the text's ``_id``, else its ``id``, else a generated one.

    Malformed texts raise when the plan runs; null texts give a null value and a generated id.
    """
    value = F.parse_json(column)
    own = F.coalesce(F.try_variant_get(value, "$._id", "string"), F.try_variant_get(value, "$.id", "string"))
    return texts.select(F.coalesce(own, generated_id()).alias("id"), value.alias("value"), F.lit(True).alias("changed"))


def stats(documents: DataFrame) -> DataFrame:
    """One row: entries, first_id, last_id."""
    return documents.agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
