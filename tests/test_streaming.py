from __future__ import annotations

from sedgework.database import Database
from sedgework.operators.changes import ChangeCapture
from sedgework.operators.views import View
from sedgework.streaming import changes as stream_changes
from sedgework.streaming import views as stream_views

CHANGE = "seq bigint, collection string, doc_id string"


def test_view_from_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    view = View("names", lambda id, v: [(id, v)])
    with Database(spark, str(tmp_path / "db")) as db:
        db.put_bulk([("a", "1"), ("b", "2"), ("c", "3")])
        spark.createDataFrame([(1, "std", "a"), (2, "other", "b"), (3, "std", None)], CHANGE).write.parquet(feed)
        run = lambda: stream_views.maintain_view(db, stream_views.change_stream(spark, feed), view, str(tmp_path / "cp")).awaitTermination()
        run()
        assert [tuple(r) for r in db.view_rows(view).collect()] == [("a", "1")]
        spark.createDataFrame([(4, "std", "b"), (5, "std", "b")], CHANGE).write.mode("append").parquet(feed)
        run()
        run()
        assert [r["key"] for r in db.view_rows(view).collect()] == ["a", "b"]
        number = db.database_stats()["snapshot"]
        # the same batches again, from a lost checkpoint: already committed, so nothing happens
        stream_views.maintain_view(db, stream_views.change_stream(spark, feed), view, str(tmp_path / "cp2")).awaitTermination()
        assert db.database_stats()["snapshot"] == number


def test_capture_from_stream(spark, tmp_path):
    schema = "collection string, id string, revision int, arrived_at timestamp"
    feed, at = str(tmp_path / "feed"), "2024-01-0{} 00:00:00"
    rows = lambda *xs: spark.createDataFrame([(c, i, r, at.format(d)) for c, i, r, d in xs], "collection string, id string, revision int, a string").selectExpr("collection", "id", "revision", "CAST(a AS timestamp) AS arrived_at")
    job = ChangeCapture(spark, str(tmp_path / "job"), ["collection", "id"], "revision", "collection", at="batch")
    for batch in (rows(("s", "a", 1, 1), ("s", "b", 1, 1)), rows(("s", "a", 1, 2), ("s", "b", 3, 2)), rows(("s", "b", 2, 3))):
        batch.write.mode("append").parquet(feed)
        stream_changes.capture(job, spark.readStream.schema(schema).parquet(feed), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["id"], r["revision"], r["batch"]) for r in job.result().collect()) == [("a", 1, 1), ("b", 1, 1), ("b", 3, 2)]
