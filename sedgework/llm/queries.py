"""Queries of the operators on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.llm import packing, residue, tokenize
from sedgework.sources.scratch import Scratch
from sedgework.sources.tables import table


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenize.encoded(table(spark, root, "documents"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """For each capacity of container_spec the container of each document or part of one."""
    scratch = Scratch(spark, "p8")
    sizes = scratch.keep(tokenize.token_counts(table(spark, root, "documents")), "sizes")
    out = None
    for name, capacity in sorted(tuple(r) for r in table(spark, root, "container_spec").select("spec_name", "capacity_tokens").distinct().collect()):
        own = packing.packed(sizes, capacity, scratch, f"items-{capacity}").select(F.lit(name).alias("spec_name"), F.lit(capacity).alias("capacity_tokens"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.judged(table(spark, root, "documents")).where("is_residue").select("doc_id")


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Placeholders and coverage of every document."""
    return residue.judged(table(spark, root, "documents"))


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    """The corpus without residue."""
    return residue.clean(table(spark, root, "documents")).select("doc_id", "lang", "n_chars", "page_id")


def p8_check(spark: SparkSession, root: str) -> DataFrame:
    """What a packing must not have, counted from its containers: documents that are missing, repeated, cut without need or with a gap; containers over capacity or with an empty item; numbers left out."""
    scratch = Scratch(spark, "p8")
    sizes = scratch.keep(tokenize.token_counts(table(spark, root, "documents")), "sizes")
    found = scratch.keep(p8_containers(spark, root), "found")
    specs = [(r[0], r[1]) for r in table(spark, root, "container_spec").select("spec_name", "capacity_tokens").distinct().collect()]
    each = F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).alias("capacity_tokens")) for n, c in specs])
    wanted = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("wanted"), F.inline(each))
    packed = found.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("part").alias("numbers"))
    both = packed.join(wanted, ["spec_name", "capacity_tokens", "doc_id"], "full")
    wrong = F.col("packed").isNull() | F.col("wanted").isNull() | (F.col("packed") != F.col("wanted")) | (F.col("end") != F.col("wanted")) | (F.col("numbers") != F.col("parts")) | (F.col("parts") != F.ceil(F.col("wanted") / F.col("capacity_tokens")))
    documents = both.groupBy("spec_name").agg(F.sum(wrong.cast("int")).alias("wrong_documents"))
    containers = found.groupBy("spec_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.min("n_tokens").alias("least"))
    containers = containers.groupBy("spec_name").agg(F.sum(((F.col("n") > F.col("capacity_tokens")) | (F.col("least") < 1)).cast("int")).alias("wrong_containers"), (F.max("container_id") + 1 - F.count(F.lit(1))).alias("numbers_left_out"))
    return documents.join(containers, "spec_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_ids": p7_ids, "p8_containers": p8_containers, "p8_check": p8_check, "p9_found": p9_found, "p9_scores": p9_scores, "p9_clean": p9_clean}


def oracle_sql() -> dict[str, str]:
    """A packing is checked by its properties: nothing may be wrong with it."""
    return {"p8_check": "SELECT DISTINCT spec_name, CAST(0 AS BIGINT) AS wrong_documents, CAST(0 AS BIGINT) AS wrong_containers, CAST(0 AS BIGINT) AS numbers_left_out FROM container_spec"}
