from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedgework.operators import changes

DOC = "collection string, id string, revision int, changed boolean, arrived_at timestamp_ntz, run_id string"
RUN = "run_id bigint, status string, read_to timestamp_ntz"
T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def brute(docs, runs):
    done = {}
    for run, status, to in runs:
        if status == "succeeded" and to is not None and run is not None:
            done[run] = max(done.get(run, to), to)
    marks = [(r, done[r]) for r in sorted(done)] + [(max([r for r, *_ in runs if r is not None], default=0) + 1, None)]
    out, since = [], None
    for i, (run, to) in enumerate(marks):
        keys = {d[:2] for d in docs}
        for key in keys:
            revisions = lambda limit: [d[2] for d in docs if d[:2] == key and d[2] is not None and (limit is None or (d[4] is not None and d[4] <= limit))]
            now, had = revisions(to), revisions(since) if i else []
            if now and (not had or max(now) > max(had)):
                out.append((run, *key))
        since = to
    return sorted(out, key=str)


DOCS = [
    ("std", "a", 1, True, at(1), "x"), ("std", "a", 2, False, at(5), None), ("std", "a", 2, True, at(9), None), ("std", "a", 1, None, at(11), None),
    ("std", "b", 3, None, at(3), None), ("std", "b", 2, None, at(6), None), ("meta", "a", 1, None, at(20), None), (None, None, 1, None, at(2), None), ("std", "c", None, None, at(2), None), ("std", "d", 1, None, None, None),
]


@pytest.mark.parametrize(
    "runs",
    [
        [(1, "succeeded", at(2)), (2, "failed", at(4)), (3, "succeeded", at(5)), (3, "succeeded", at(5)), (4, "succeeded", None), (5, "lost", at(30)), (6, "succeeded", at(10))],
        [(1, "succeeded", at(10)), (2, "succeeded", at(4)), (3, "succeeded", at(12))],
        [(7, "failed", at(4))],
        [],
    ],
)
def test_changed_per_run(spark, rows, runs):
    found = changes.changed_per_run(spark.createDataFrame(DOCS, DOC), spark.createDataFrame(runs, RUN))
    assert rows(found, "run_id", "collection", "doc_key") == brute(DOCS, runs)


def test_capture_goes_through_the_run_log(spark, rows, tmp_path):
    """The running job, broken off whenever a run failed, and the replay of the whole log give the same."""
    docs = [d for d in DOCS if d[2] is not None]
    runs = [(1, "succeeded", at(2)), (2, "failed", at(4)), (3, "lost", at(5)), (4, "succeeded", at(7)), (5, "failed", at(8)), (6, "aborted", None), (7, "failed", at(40)), (8, "succeeded", at(10))]
    df, log = spark.createDataFrame(docs, DOC), spark.createDataFrame(runs, RUN)
    found = changes.capture_runs(df, log, str(tmp_path / "job"))
    assert rows(found) == rows(changes.changed_per_run(df, log)) == brute(docs, runs)


def test_offsets(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.sql(f"SELECT {kind}'2024-10-27 02:30:00.123456' AS t UNION ALL SELECT {kind}'1969-12-31 23:59:59.999999'")
        found = [r[0] for r in df.select(changes.offset_of("t", kind).alias("o")).orderBy("o").collect()]
        assert found == [-1, 1729996200123456]
        assert df.where(F.col("t") == changes.offset_literal(found[1], kind)).count() == 1


def test_plan_rows():
    bounds = [at(5), at(10)]
    m = lambda n: changes.micros(at(n))
    assert changes.plan_rows(bounds, [("a", m(1), m(7)), (None, m(10), m(12))]) == [(0, "a", m(1) - 1, m(5)), (1, "a", m(5), m(7)), (1, None, m(10) - 1, m(10)), (2, None, m(10), m(12))]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    job = changes.ChangeCapture(spark, str(tmp_path / "job"), ["id"], "revision", "collection", buckets=8)
    log = spark.createDataFrame([("std", f"d{i}", 1, None, at(1), "") for i in range(60)] + [("std", "d7", 2, None, at(2), ""), ("std", "nodate", 1, None, None, "")], DOC)
    assert job.run(log.where("arrived_at <= timestamp_ntz'2024-01-01 01:00:00'")) == 1
    assert job.run(log) == 2
    assert len(job._names("state/batch=1/fresh=true")) == 8 and len(job._names("state/batch=2/fresh=true")) <= 2
    assert sorted(r["id"] for r in job.result().where("batch = 2").collect()) == ["d7", "nodate"]
    assert job.run(log) == 3 and job.result().where("batch = 3").count() == 0


def test_empty_documents(spark, rows):
    assert rows(changes.changed_per_run(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "succeeded", at(2))], RUN))) == []


@pytest.mark.parametrize("fail_at", ["plan", "batch", "state"])
def test_capture_survives_failures(spark, tmp_path, rows, fail_at):
    log = spark.createDataFrame([d for d in DOCS if d[2] is not None], DOC)
    job = changes.ChangeCapture(spark, str(tmp_path / "job"), ["collection", "id"], "revision", "collection")
    first = log.where("arrived_at <= timestamp_ntz'2024-01-01 05:00:00'")
    with pytest.raises(RuntimeError):
        job.run(first, fail_at=fail_at)
    assert job.last_commit() == 0
    # more has arrived when the batch is replayed; its plan has the offsets of the first attempt
    again = changes.ChangeCapture(spark, str(tmp_path / "job"), ["collection", "id"], "revision", "collection")
    assert again.run(log) == 1
    assert rows(again.result(), "collection", "id", "revision", "batch") == [("std", "a", 2, 1), ("std", "b", 3, 1), ("std", "d", 1, 1), (None, None, 1, 1)]
    assert again.run(log) == 2
    assert again.run(log) == 3
    assert rows(again.result().where("batch > 1"), "collection", "id", "revision", "batch") == [("meta", "a", 1, 2)]
