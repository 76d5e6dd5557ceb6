"""Schemas of the stored tables. A document's value is VARIANT in the store; the operators take any type."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("value", T.VariantType()), T.StructField("changed", T.BooleanType())])
POSTING_STRING = T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_id", T.StringType())])
POSTING_UINT64 = T.StructType([T.StructField("key", T.DecimalType(20, 0)), T.StructField("doc_id", T.StringType())])
NODE = T.StructType([T.StructField("graph", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("props", T.VariantType())])
EDGE = T.StructType([T.StructField("graph", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("predicate", T.StringType()), T.StructField("target", T.StringType())])
VIEW_ROW = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.VariantType())])
CHANGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("collection", T.StringType()), T.StructField("doc_id", T.StringType())])
