"""The collections and graphs that the queries run on, derived from the tables of one directory.

documents: events by padded id. graphs: ``sales`` of customers, orders and parts, ``geo`` of customers and nations; both
name customers alike, which only the graph tells apart. A line item's key is not unique, so its edge id has an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.sources.tables import table


def padded(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 12, "0")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """id, value (struct of event_id, user_id, event_type, value) of the events."""
    return table(spark, root, "events").select(padded("event_id").alias("id"), F.struct("event_id", "user_id", "event_type", "value").alias("value"))


def parts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(padded("p_partkey").alias("id"), F.struct("p_name").alias("value"))


def customers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(padded("c_custkey").alias("id"), F.struct("c_name", "c_nationkey", "c_acctbal").alias("value"))


def _named(graph: str, prefix: str, key: str, label: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(graph).alias("graph"), F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"))


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """graph, id, label."""
    customer = table(spark, root, "customer")
    found = _named("sales", "c", "c_custkey", "c_name", customer)
    found = found.unionByName(_named("sales", "o", "o_orderkey", "o_orderstatus", table(spark, root, "orders")))
    found = found.unionByName(_named("sales", "p", "p_partkey", "p_name", table(spark, root, "part")))
    found = found.unionByName(_named("geo", "c", "c_custkey", "c_mktsegment", customer))
    return found.unionByName(_named("geo", "n", "n_nationkey", "n_name", table(spark, root, "nation")))


def edges(spark: SparkSession, root: str) -> DataFrame:
    """graph, id, source, predicate, target."""

    def name(prefix: str, *columns: str) -> Column:
        return F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in columns])

    orders, lines, customer = table(spark, root, "orders"), table(spark, root, "lineitem"), table(spark, root, "customer")
    placed = orders.select(F.lit("sales").alias("graph"), name("e:o", "o_orderkey").alias("id"), name("c", "o_custkey").alias("source"), F.lit("placed").alias("predicate"), name("o", "o_orderkey").alias("target"))
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    lines = lines.withColumn("ordinal", F.row_number().over(same))
    contains = lines.select(F.lit("sales").alias("graph"), name("e:l", "l_orderkey", "l_linenumber", "l_partkey", "ordinal").alias("id"), name("o", "l_orderkey").alias("source"), F.lit("contains").alias("predicate"), name("p", "l_partkey").alias("target"))
    lives = customer.select(F.lit("geo").alias("graph"), name("e:c", "c_custkey").alias("id"), name("c", "c_custkey").alias("source"), F.lit("lives-in").alias("predicate"), name("n", "c_nationkey").alias("target"))
    return placed.unionByName(contains).unionByName(lives)
