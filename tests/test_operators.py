from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgework.functions.ids import generated_id, make_key_id
from sedgework.functions.text import one_spelling
from sedgework.operators import documents as D
from sedgework.operators import graphs as G
from sedgework.operators import indexes as I
from sedgework.operators import views as V
from sedgework.operators.chunking import chunked

DOC = "id string, value struct<k:string,n:bigint>, ord bigint, extra string"


def test_ids_sort_and_differ(spark):
    made = [make_key_id() for _ in range(2000)]
    assert made == sorted(made) and len(set(made)) == 2000 and {len(x) for x in made} == {36}
    found = [r[0] for r in spark.range(500).select(generated_id().alias("i")).collect()]
    assert len(set(found)) == 500 and all(len(x) == 36 and x == x.upper() for x in found)


def test_one_spelling(spark):
    cases = {"Child": "child", " :KNOWS ": "knows", None: "child", "": "child", "  ": "child", ":": "child", "works-with": "works-with", "a b": "a b", "\tx\n": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", one_spelling(F.col("p"))).collect()} == cases


def test_last_writes_ties_and_nulls(spark, rows):
    df = spark.createDataFrame([("a", ("x", 1), 1, None), ("a", ("y", 2), 2, None), ("a", ("z", 3), 2, None), ("b", None, None, None), ("b", ("w", 1), 0, None), (None, ("v", 1), 5, None)], DOC)
    first = rows(D.last_writes(df, ["id"], "ord"), "id", "value.k")
    assert len(first) == 3 and ("b", "w") in first and (None, "v") in first
    assert rows(D.last_writes(df.orderBy(F.desc("ord")).repartition(3), ["id"], "ord"), "id", "value.k") == first
    assert rows(D.last_writes(df.limit(0), ["id"], "ord")) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), max_size=8), st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), max_size=6), st.sets(st.sampled_from("abcd")))
def test_incremental_index_is_rebuilt_index(spark, rows, before, written, gone):
    definition = I.IndexDefinition("k", "value.k")
    frame = lambda xs: spark.createDataFrame([(i, (k, 0), o, None) for o, (i, k) in enumerate(xs)], DOC)
    docs = D.upsert(frame([]), frame(before), "ord")
    batch = D.last_writes(frame(written), ["id"], "ord").withColumn("ord", F.lit(0).cast("bigint"))
    deleted = spark.createDataFrame([(g,) for g in sorted(gone)], "id string")
    after = D.delete(D.upsert(docs, batch), deleted)
    kept = D.delete(batch, deleted)
    postings = I.update_postings(I.build_postings(docs, definition), kept, definition, ids=deleted)
    assert rows(postings, "key", "doc_id") == rows(I.build_postings(after, definition), "key", "doc_id")


def test_keys_of_definitions(spark, rows):
    docs = spark.createDataFrame([("std", "1", ("a", 5, ["t", "t", None])), ("std", "2", None), ("meta", "3", (None, 7, [])), (None, "4", ("a", 1, None))], "collection string, id string, value struct<k:string,n:bigint,tags:array<string>>")
    made = [("by-k", "value.n", "std", 1), ("by-k", "value.k", "std", 2), ("by-n", "value.n", "meta", 1), ("tags", "value.tags", "std", 1), ("none", "value.nope", "std", 1), ("far", "value.k", "archive", 1), (None, "value.k", "std", 1), ("bad", None, "std", 1)]
    defs = spark.createDataFrame([(n, k, c, None, a) for n, k, c, a in made], "name string, key_fn string, collection string, extra string, registered_at bigint")
    assert rows(I.keys_of_definitions(docs, defs)) == [("by-k", "1", "a"), ("by-n", "3", "7"), ("tags", "1", "t"), ("tags", "1", "t")]
    assert rows(I.keys_of_definitions(docs, defs.limit(0))) == []


def test_unique_violations_and_key_types(spark, rows):
    postings = spark.createDataFrame([("k", "1"), ("k", "1"), ("m", "1"), ("m", "2")], "key string, doc_id string")
    assert rows(I.unique_violations(postings)) == [("m", 2)]
    with pytest.raises(TypeError):
        I.IndexDefinition("x", "value", key_type="float")
    negative = I.build_postings(spark.createDataFrame([("a", ("x", -1), 0, None)], DOC), I.IndexDefinition("n", "value.n", key_type="uint64"))
    with pytest.raises(Exception, match="unsigned"):
        negative.collect()


def test_cascade_leaves_no_dangling_edge(spark, rows):
    nodes = spark.createDataFrame([("g", n) for n in "abc"] + [("h", "a")], "graph string, id string")
    edges = spark.createDataFrame([("g", "1", "a", "p", "b"), ("g", "2", "b", "p", "a"), ("g", "3", "b", "p", "c"), ("h", "4", "a", "p", "a"), ("g", "5", "a", "p", "a")], "graph string, id string, source string, predicate string, target string")
    left, kept = G.delete_nodes(nodes, edges, spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "zz")], "graph string, id string"))
    assert rows(kept, "id") == [("3",), ("4",)] and rows(left) == [("g", "b"), ("g", "c"), ("h", "a")]
    assert rows(G.unknown_endpoints(kept, left)) == []
    assert rows(G.parallel_edges(edges.unionByName(edges)), "source", "n")[0] == ("a", 2)


def test_views_last_writer_and_incremental(spark, rows):
    docs = spark.createDataFrame([("1", ("a", 1), 0, None), ("2", ("a", 2), 0, None), ("3", (None, 3), 0, None), ("4", ("b", 4), 0, None)], DOC)
    view = V.View("v", "array(struct(value.k AS key, value.n AS value), struct('all' AS key, value.n AS value), struct('all' AS key, -value.n AS value))")
    built = V.rebuild(docs, view)
    assert rows(built) == [("a", 2), ("all", -4), ("b", 4)]
    changed = spark.createDataFrame([(5, "4"), (9, "1"), (7, "2"), (8, "gone"), (1, "1")], "seq bigint, doc_id string")
    assert rows(V.apply(built, docs, changed, view)) == [("a", 1), ("all", -1), ("b", 4)]
    assert rows(V.rebuild(docs.limit(0), view)) == []


@pytest.mark.parametrize("margin", [0, 2])
def test_chunked(spark, margin):
    data = [("long", i // 3, i) for i in range(37)] + [("short", 1, i) for i in range(5)] + [(None, None, 1)]
    df = spark.createDataFrame(data, "g string, h int, item bigint").withColumn("at", F.timestamp_seconds(F.col("h") * 1800))
    short, long = chunked(df, ["g"], "at", "item", 10, margin)
    got = short.collect() + long.collect()
    assert {r["__n"] for r in got} == {None, 37} and short.columns == long.columns
    core = [r for r in got if r["__core"]]
    assert sorted((r["g"], r["item"]) for r in core if r["g"]) == sorted((g, i) for g, _, i in data if g)
    for r in got:
        if r["g"] == "long":
            low, high = r["__chunk"] * 10, r["__chunk"] * 10 + 10
            assert (low <= r["item"] < high) == r["__core"] and low - margin <= r["item"] < high + margin
    assert len(got) == len(core) + (2 * margin * 3 if margin else 0)


def test_chunks_of_one_time(spark):
    """A group under one time, or none, is cut all the same; a table without long groups has no long part."""
    df = spark.range(95).selectExpr("'g' AS g", "if(id < 60, timestamp'2024-01-01', null) AS at", "if(id % 2 = 0, id, null) AS item", "id")
    short, long = chunked(df, ["g"], "at", "item", 10)
    assert short.count() == 0
    sizes = [r["count"] for r in long.groupBy("__chunk").count().orderBy("__chunk").collect()]
    assert sizes == [10] * 9 + [5] and long.select("id").distinct().count() == 95
    assert chunked(df, ["g"], "at", "item", 95)[1] is None
