from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
#: One query of each kind; the driver compares all of them.
SAMPLE = ["p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "p6_paths", "p6_descendants", "p3_complete", "p5_rules", "calls_views", "calls_boundaries", "doc_upsert", "idx_after_replace", "graph_delete_node", "view_multi_emit", "store_flagship"]


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_every_oracle_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 7) if n != 4} <= set(entry.queries())


def test_only_the_entry_imports_the_subpackage_on_texts():
    for path in (ROOT / "sedgework").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(?m)^\s*(from|import)\s+sedgework\.llm", path.read_text()), path


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, entry, name):
    connection = duckdb.connect()
    for path in DATA.iterdir():
        connection.sql(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}'")
    found = entry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = connection.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_flagship(spark, entry):
    assert entry.entry(spark).columns == ["word", "n"]
    assert os.path.exists(ROOT / "bench.py")
