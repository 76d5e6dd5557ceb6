"""Map/reduce views: rows (key, value), unique by key, computed from the documents of a collection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.errors import ViewReducerMissing
from sedgework.operators.indexes import MAIN


@dataclass(frozen=True)
class View:
    """map: a Column or SQL expression that is an array of struct(key, value), in order of emission, or a callable of (id, value) that yields (key, value) pairs.

    reduce: an aggregate Column or SQL expression over key and value, or a callable of all selected rows as a list of (key, value). value_type is
    the type of emitted values, needed for a callable map.
    """

    name: str
    map: Column | str | Callable
    reduce: Column | str | Callable | None = None
    value_type: str = "string"
    source: str = MAIN


def emitted(documents: DataFrame, view: View, skip_errors: bool = False) -> DataFrame:
    """id, ord, key, value of each emission. Emissions without key are none. skip_errors: a document whose callable mapper fails emits nothing."""
    if not callable(view.map):
        pairs = F.expr(view.map) if isinstance(view.map, str) else view.map
    else:
        function = view.map

        def run(id: str, value: object) -> list:
            try:
                return [tuple(p) for p in function(id, value)]
            except Exception:
                if skip_errors:
                    return []
                raise

        pairs = F.udf(run, f"array<struct<key:string,value:{view.value_type}>>")("id", "value")
    rows = documents.select("id", F.posexplode(pairs).alias("ord", "e"))
    return rows.select("id", "ord", "e.key", "e.value").where(F.col("key").isNotNull())


def _last(rows: DataFrame, *order: str) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def rebuild(documents: DataFrame, view: View, skip_errors: bool = False) -> DataFrame:
    """The view's rows from nothing: of the emissions of one key that of the greatest (id, ord) holds."""
    return _last(emitted(documents, view, skip_errors), "id", "ord")


def apply(rows: DataFrame, documents: DataFrame, changed: DataFrame, view: View) -> DataFrame:
    """rows after the documents of changed (seq, doc_id) were mapped, in order of seq: their emissions replace rows of their keys.

    Rows that a document emitted before and doesn't any more stay, as do those of deleted documents; rebuild drops them.
    An id listed more than once counts at its last seq.
    """
    return insert(rows, fresh(documents, changed, view))


def fresh(documents: DataFrame, changed: DataFrame, view: View) -> DataFrame:
    """The rows that documents of changed (seq, doc_id) emit, one for each key, in order of seq."""
    last = changed.groupBy(F.col("doc_id").alias("id")).agg(F.max("seq").alias("seq"))
    found = emitted(documents.join(last.select("id"), "id", "left_semi"), view).join(last, "id")
    return _last(found, "seq", "ord")


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with those of new (key, value; unique keys) put in the place of theirs."""
    return rows.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def get(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key)


def select_rows(rows: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with keys from start, inclusive, to end, exclusive; limit takes the first by key. No limit is None; 0 is no rows; below is an error."""
    if limit is not None and limit < 0:
        raise ValueError("a limit of a view's rows is not below 0")
    found = rows
    if start is not None:
        found = found.where(F.col("key") >= start)
    if end is not None:
        found = found.where(F.col("key") < end)
    return found if limit is None else found.orderBy("key").limit(limit)


def reduce(rows: DataFrame, view: View) -> DataFrame:
    """One row, column ``result``: the view's reducer over rows. A callable gets all rows at once, in order of key, in one task; an aggregate Column is distributed."""
    if view.reduce is None:
        raise ViewReducerMissing(view)
    if not callable(view.reduce):
        return rows.agg((F.expr(view.reduce) if isinstance(view.reduce, str) else view.reduce).alias("result"))
    function = view.reduce
    gathered = rows.agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("rows"))
    return gathered.select(F.udf(lambda found: function([tuple(r) for r in found]), view.value_type)("rows").alias("result"))
