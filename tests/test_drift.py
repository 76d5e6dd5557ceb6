from __future__ import annotations

import itertools
import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedgework.functions import layouts
from sedgework.operators import drift

FILE = "file_id bigint, suite string, path string, committed_at timestamp_ntz, arrived_at timestamp_ntz, body string"
T0 = datetime(2024, 1, 1)


def files(*bodies, suite="s", start=1):
    return [(start + i, suite, None, T0 + timedelta(hours=i), None, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]


def run(spark, rows, data):
    return rows(drift.changes(spark.createDataFrame(data, FILE)), "file_id", "field_name", "change_kind")


def test_kinds_of_change(spark, rows):
    data = files({"a": 1, "b": "x"}, {"a": 1.5, "b": "x", "c": None}, {"a": None, "c": [1]}, {"a": True, "c": {}, "b": "y"})
    assert run(spark, rows, data) == [(2, "a", "retyped"), (2, "c", "added"), (3, "b", "removed"), (4, "a", "retyped"), (4, "b", "added"), (4, "c", "retyped")]


def test_former_type_ends_with_the_field(spark, rows):
    data = files({"a": 1}, {"a": None}, {}, {"a": "x"}, {"a": None}, {"a": "y"}, {"a": 2})
    assert run(spark, rows, data) == [(3, "a", "removed"), (4, "a", "added"), (7, "a", "retyped")]


def test_renames(spark, rows):
    data = files({"schema_version": 1, "run_count": 4, "z": "q"}, {"schemaVersion": 1, "runs": 4, "z": "q"}, {"schemaVersion": 1, "runs": 4}, {"schemaVersion": 1, "count": "4"}, {"other": None})
    assert run(spark, rows, data) == [(2, "runs", "renamed"), (2, "schemaVersion", "renamed"), (3, "z", "removed"), (4, "count", "added"), (4, "runs", "removed"), (5, "count", "removed"), (5, "other", "added"), (5, "schemaVersion", "removed")]
    found = {r["field_name"]: r["former_name"] for r in drift.changes(spark.createDataFrame(data, FILE)).where("change_kind = 'renamed'").collect()}
    assert found == {"schemaVersion": "schema_version", "runs": "run_count"}


def test_bodies_that_are_no_objects(spark, rows):
    deep = "[" * 100_000 + "]" * 100_000
    data = files({"a": 1}, None, "", "  ", "[1]", "7", "NaN", '{"a": 1', "<html>", '{"a": NaN}', deep, '{"a": "x", "a": 2}', "{}")
    assert run(spark, rows, data) == [(13, "a", "removed")]


def test_order_ties_suites_and_repeats(spark, rows):
    tie = [(5, "s", None, T0, None, '{"b": 1}'), (4, "s", None, T0, None, '{"a": "x"}'), (6, "s", None, None, None, '{"a": "x"}'), (7, None, None, T0, None, '{"k": 1}'), (8, None, None, T0, None, '{"k": 1.0}')]
    assert run(spark, rows, tie) == [(5, "a", "removed"), (5, "b", "added"), (8, "k", "retyped")]
    twice = files({"a": 1}, {"a": 1}, {"a": "x"}, {"a": "x"})
    assert run(spark, rows, twice) == [(3, "a", "retyped")]
    assert run(spark, rows, []) == []


def test_long_suites_in_chunks(spark, rows, monkeypatch):
    """Whole and in chunks of three files the result is one."""
    options = [{"a": 1}, {"a": None}, {"a": "x", "b": 2}, {"c": "x"}, {"b": 2.5, "c": None}, {}, {"d": "x", "b": None}]
    bodies = [options[(i * i + 3 * (i // 4)) % len(options)] for i in range(60)]
    data = files(*bodies) + files({"a": 1}, {"b": 1}, suite="t", start=1000)
    whole = run(spark, rows, data)
    monkeypatch.setattr(drift, "CHUNK", 3)
    assert run(spark, rows, data) == whole


def test_unified_table(spark, rows):
    data = files({"schema_version": 1, "n": 1, "file_id": "f"}, {"schemaVersion": 2, "n": 2.5, "file_id": "g", "ok": True}, {"schemaVersion": 3, "n": None, "meta": {"x": 1}}, "broken")
    found = drift.unified(spark.createDataFrame(data, FILE))
    assert dict(found.dtypes) == {"file_id": "bigint", "suite": "string", "committed_at": "timestamp", "field_file_id": "string", "meta": "string", "n": "double", "ok": "boolean", "schemaVersion": "bigint"}
    assert rows(found, "file_id", "schemaVersion", "n", "ok", "meta", "field_file_id") == [(1, 1, 1.0, None, None, "f"), (2, 2, 2.5, True, None, "g"), (3, 3, None, None, '{"x": 1}', None)]


def test_whole_numbers_beyond_64_bits(spark, rows):
    """None is lost; that a number is longer is no change of type."""
    data = files({"a": 1, "b": 2**63 - 1, "c": 10**38, "d": 1.5, "e": 0.5}, {"a": 2**63, "b": -(2**63), "c": 7, "d": 10**20, "e": -(10**400)}, {"a": -(10**38) + 1, "b": None, "c": None, "d": None, "e": None})
    df = spark.createDataFrame(data, FILE)
    found = drift.unified(df)
    types = dict(found.dtypes)
    assert [types[c] for c in "abcde"] == ["decimal(38,0)", "bigint", "string", "double", "string"]
    assert [int(r[0]) for r in found.orderBy("file_id").select("a").collect()] == [1, 2**63, -(10**38) + 1]
    assert rows(found.where("b is not null"), "b", "c", "d", "e") == sorted([(2**63 - 1, str(10**38), 1.5, "0.5"), (-(2**63), "7", 1e20, str(-(10**400)))], key=str)
    assert rows(drift.changes(df), "field_name", "change_kind") == [("d", "retyped"), ("e", "retyped")]


def test_fields_found_together_stay_apart(spark):
    data = files({"a": "x"}, {"b": "x"}, {"a": "x", "b": "y"})
    assert {"a", "b"} <= set(drift.unified(spark.createDataFrame(data, FILE)).columns)


def test_long_numbers_deep_values_and_case(spark, rows):
    """Neither digits nor depth lose a file, and names that differ in case only are two columns."""
    long, deep = "7" * 6000, "[" * 30000 + "]" * 30000
    whole = f'{{"a": 3, "n": {long}, "meta": {{"x": {deep}}}, "s": "t"}}'
    assert layouts.parse_object(whole) == {"a": 3, "n": int(long), "meta": layouts.Deep("object", f'{{"x": {deep}}}'), "s": "t"}
    assert run(spark, rows, files({"a": 1, "s": "u"}, whole)) == [(2, "meta", "added"), (2, "n", "added")]
    for bad in (f'{{"a": {deep}', whole + "x", f'{{"a": {deep},}}', f'{{"a" {deep}}}', f"[{deep}]", f'{{"a": {deep[:-1]}}}}}', f'{{1: {deep}}}'):
        assert layouts.parse_object(bad) is None


def test_case_and_digits_in_the_table(spark, rows):
    data = files('{"a": 1, "A": 2, "n": 1' + "0" * 5000 + "}", {"a": 3, "A": None, "n": 5})
    found = drift.unified(spark.createDataFrame(data, FILE))
    assert set(found.columns) == {"file_id", "suite", "committed_at", "A", "a_2", "n"}
    assert rows(found, "a_2", "A") == [(1, 2), (3, None)] and {len(r[0]) for r in found.select("n").collect()} == {5001, 1}


def test_more_fields_than_columns(spark, rows, monkeypatch):
    monkeypatch.setattr(drift, "COLUMNS", 2)
    found = drift.unified(spark.createDataFrame(files({"a": 1, "b": 2, "x1": "u"}, {"a": 1, "b": 3, "x2": [1]}, {"a": 4, "b": 5}), FILE))
    assert set(found.columns) == {"file_id", "suite", "committed_at", "a", "b", "other_fields"}
    assert rows(found, "a", "b", "other_fields") == sorted([(1, 2, '{"x1": "u"}'), (1, 3, '{"x2": "[1]"}'), (4, 5, None)], key=str)


def test_name_similarity():
    assert layouts.name_similarity("schema_version", "schemaVersion") == 1
    assert layouts.name_similarity("run_count", "runs") > layouts.name_similarity("run_count", "aggregation")


def test_sketch_sees_the_whole_value():
    assert layouts.sketch("7" * 5000 + "x" * 5000)[1:] == [0.5, 0.5, 0.5, round(2 / 64, 4)]
    assert layouts.sketch("ab1") == [round(1.3862943611 / 12, 4), round(1 / 3, 4), round(2 / 3, 4), 1.0, 1.0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.integers(n, 5).flatmap(lambda m: st.lists(st.lists(st.floats(0, 9), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_least(cost):
    found = layouts.assign(cost)
    assert len(set(found)) == len(found)
    best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(cost[0])), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(found)) == pytest.approx(best)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.sampled_from([None, "whole", "string"]), max_size=3), min_size=2, max_size=8), st.integers(1, 7))
def test_chunk_summaries_compose(kinds, cut):
    """The state after all files is that of the second part's summary, given the state after the first."""
    found = [{k: (t, None) for k, t in x.items()} for x in kinds]
    cut = min(cut, len(found) - 1)
    state = None
    for x in found[:cut]:
        state, _ = layouts.step(state, x)
    after = state
    for x in found[cut:]:
        after, _ = layouts.step(after, x)
    assert layouts.carried(state, layouts.summary(found[cut:])) == after
