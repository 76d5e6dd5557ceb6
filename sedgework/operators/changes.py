"""Processing only records that are new or changed, through failures, once each.

Change capture from the log of deliveries. Each run has a write-ahead plan: for every partition of
the log, the offsets it will read, from and to. The plan is stored before any row is read; a run
that fails leaves a plan without a commit, and the offsets of that plan are read again by the run that commits next. The sink keeps,
per record key, the greatest offset it has: a delivery enters only if its offset is greater, so
repeats, late deliveries of old revisions and replayed batches change nothing.

``ChangeCapture`` is the running job, one batch after another. ``changed_per_run`` replays a whole log of runs at once: the plans of all
runs are one table, the deliveries are joined to it by partition and range of offsets, and one sink takes the batches in their order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.sources.scratch import Scratch

SUCCEEDED = "succeeded"
#: Ranges of offsets are joined day by day, in microseconds.
DAY = 86_400_000_000
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Batch:
    """One committed run: it takes deliveries that arrived after ``since`` (None: from the start) up to and with ``until`` (None: all)."""

    run_id: int
    since: object
    until: object


def batches_of(runs: DataFrame) -> list[Batch]:
    """The committed batches of a run log, in order of run_id, and one open batch numbered one above the greatest run_id.

    Runs are metadata, one row each, and come to the driver. A run logged twice counts once; of the
    read_to of its succeeded rows the greatest holds. Runs that did not succeed, and succeeded runs
    without read_to, kept nothing: what they read is read again by the next batch. An empty log gives
    the open batch alone, numbered 1.
    """
    kept = runs.where((F.col("status") == SUCCEEDED) & F.col("read_to").isNotNull() & F.col("run_id").isNotNull())
    done = sorted((r[0], r[1]) for r in kept.groupBy("run_id").agg(F.max("read_to")).collect())
    last = runs.agg(F.max("run_id")).first()[0]
    out, since = [], None
    for run_id, until in done:
        out.append(Batch(run_id, since, until))
        since = until
    return [*out, Batch((last or 0) + 1, since, None)]


def slots_of(batches: Sequence[Batch]) -> tuple[list[object], list[list[int]]]:
    """The stretches of offsets between the batches' bounds: the bounds in order, and for each stretch the runs that read it anew.

    Stretch j ends with bound j, the last is open. In a log whose runs read further each time every
    stretch has one run; a run that read less far than the one before leaves a stretch to two.
    """
    bounds = sorted({b.until for b in batches if b.until is not None})
    runs = [[b.run_id for b in batches if (b.since is None or end is None or end > b.since) and (b.until is None or (end is not None and end <= b.until))] for end in [*bounds, None]]
    return bounds, runs


def offset_of(at: str, kind: str) -> Column:
    """The column at as a 64-bit offset: microseconds for times, without regard to any zone for those that have none."""
    if kind == "timestamp":
        return F.unix_micros(at)
    if kind == "timestamp_ntz":
        second = F.extract(F.lit("SECOND"), F.col(at)) * 1_000_000
        return F.unix_date(F.to_date(at)) * F.lit(DAY) + (F.hour(at) * 3600 + F.minute(at) * 60).cast("bigint") * 1_000_000 + second.cast("bigint")
    return F.col(at).cast("bigint")


def offset_literal(offset: int, kind: str) -> Column:
    """An offset as a literal of the column that it is of, so that comparisons reach the files."""
    if kind == "timestamp":
        return F.timestamp_micros(F.lit(offset))
    if kind == "timestamp_ntz":
        return F.expr(f"TIMESTAMP_NTZ'{(_EPOCH + timedelta(microseconds=offset)).isoformat(sep=' ', timespec='microseconds')}'")
    return F.lit(offset)


def micros(when: datetime) -> int:
    return (when.replace(tzinfo=None) - _EPOCH) // timedelta(microseconds=1)


def plan_rows(bounds: Sequence[datetime], ends: Sequence[tuple[object, int, int]]) -> list[tuple[int, object, int, int]]:
    """The write-ahead plan of all stretches: (batch_no, partition, from, to), offsets after from up to and with to, for the stretches in which the partition (name, first, last offset) can have deliveries."""
    marks = [micros(b) for b in bounds]
    out = []
    for name, first, last in ends:
        for number, (lo, hi) in enumerate(zip([None, *marks], [*marks, None], strict=True)):
            lo = first - 1 if lo is None else max(lo, first - 1)
            hi = last if hi is None else min(hi, last)
            if lo < hi:
                out.append((number, name, lo, hi))
    return out


def covered(log: DataFrame, plan: DataFrame, partition: str, offset: str) -> DataFrame:
    """The deliveries that a plan (batch_no, p, lo, hi) covers, with their ``batch_no``; those without an offset aren't.

    An equi-join on partition and day, within which the range is compared: where the plan isn't small enough to be broadcast, a partition
    that most deliveries are in is spread over its days.
    """
    day = lambda c: F.floor(c / F.lit(DAY)).cast("bigint")
    days = plan.withColumn("plan_day", F.explode(F.sequence(day(F.col("lo") + 1), day(F.col("hi")))))
    within = log[partition].eqNullSafe(days["p"]) & (day(log[offset]) == days["plan_day"]) & (log[offset] > days["lo"]) & (log[offset] <= days["hi"])
    return log.join(days, within).drop("p", "lo", "hi", "plan_day")


def accept(assigned: DataFrame, key: Sequence[str], offset: str, state: DataFrame | None = None) -> DataFrame:
    """The sink: for each batch and key the greatest offset, where it is greater than all of the batches before.

    Deliveries are first reduced to one row per (key, batch), so a key's rows in the window are at most as many
    as batches, however often it was delivered. state: key columns and ``last_offset``, what the sink held before
    the first batch. Rows with a null offset are no revision and are ignored.
    """
    key = list(key)
    best = assigned.where(F.col(offset).isNotNull()).groupBy(*key, "batch_no").agg(F.max(offset).alias(offset))
    if state is not None:
        held = state.select(*key, F.lit(-1).alias("batch_no"), F.col("last_offset").cast(dict(best.dtypes)[offset]).alias(offset))
        best = best.unionByName(held)
    before = Window.partitionBy(*key).orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    new = best.withColumn("__had", F.max(offset).over(before)).where(F.col("__had").isNull() | (F.col(offset) > F.col("__had")))
    return new.where(F.col("batch_no") >= 0).drop("__had")


def changed_per_run(documents: DataFrame, runs: DataFrame, partition: str = "collection") -> DataFrame:
    """For each committed run, and one further run that reads everything, the documents added or changed since the one before.

    Columns: run_id, collection, doc_key. A document counts if its greatest revision so far grew; a
    tombstone is a revision like any other and the writer's flag says nothing. Null collection and id are
    names of their own. Deliveries without a time are read by the open run. See batches_of and accept for the other cases.
    partition: the column that the log is partitioned by; its values, with their first and last offsets, come to the driver.

    A run that read less far than the one before finds nothing; the next finds that stretch once more.
    """
    spark = documents.sparkSession
    batches = batches_of(runs)
    bounds, owners = slots_of(batches)
    kind = dict(documents.dtypes)["arrived_at"]
    log = documents.select("collection", F.col("id").alias("doc_key"), "revision", F.col(partition).alias("log_partition"), offset_of("arrived_at", kind).alias("log_offset"))
    ends = [tuple(r) for r in log.where(F.col("log_offset").isNotNull()).groupBy("log_partition").agg(F.min("log_offset"), F.max("log_offset")).collect()]
    plan = spark.createDataFrame(plan_rows(bounds, ends), f"batch_no int, p {dict(log.dtypes)['log_partition']}, lo bigint, hi bigint")
    plan = Scratch(spark, "changes").keep(plan, "plan")
    undated = log.where(F.col("log_offset").isNull()).withColumn("batch_no", F.lit(len(bounds)))
    grown = accept(covered(log, plan, "log_partition", "log_offset").unionByName(undated), ["collection", "doc_key"], "revision")
    of_runs = spark.createDataFrame([(number, run) for number, found in enumerate(owners) for run in found], "batch_no int, run_id bigint")
    found = grown.join(of_runs, "batch_no").select("run_id", "collection", "doc_key")
    return found if all(len(x) == 1 for x in owners) else found.distinct()


class ChangeCapture:
    """An incremental job over a log of deliveries that can be cut off at any moment.

    root: a folder that all executors share. ``plans/<n>.json`` is the write-ahead plan of batch n, ``batch/<n>``
    what it read, ``state/batch=<n>`` the greatest offset per key of the buckets that it touched, those with ``fresh=true`` being its own rows, the sink,
    ``commits/<n>.json`` its commit with the version of every bucket. Files of a batch without commit are overwritten when the batch is replayed, with the offsets that its plan has; so
    each change is in exactly one committed batch. A batch reads the log between its offsets, by comparisons that reach the files, and of the
    state the buckets of its keys.

    at: the column whose values are offsets, a time or a number; within a partition what comes later must have a greater one. Deliveries without
    an offset are read by every batch, and taken once, by the sink.
    """

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], offset: str, partition: str, at: str = "arrived_at", buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.offset, self.partition, self.at, self.buckets = spark, root.rstrip("/"), list(key), offset, partition, at, buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, what: dict) -> None:
        """All or nothing: written aside, then renamed."""
        aside, where = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(where.getParent())
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if not self._fs.rename(aside, where):
            raise RuntimeError(f"{name} could not be written")

    def _names(self, name: str) -> list[str]:
        where = self._path(f"{self.root}/{name}")
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def last_commit(self) -> int:
        """The number of the last committed batch, 0 if none."""
        return max((int(n.split(".")[0]) for n in self._names("commits") if n[0].isdigit()), default=0)

    def plan(self, log: DataFrame) -> tuple[int, dict]:
        """The next batch and its offsets, stored before anything is read. A plan that was stored and not committed is used again.

        Partitions come to the driver, one row each; a null partition is one named by null.
        """
        n = self.last_commit() + 1
        if stored := self._read(f"plans/{n}.json"):
            return n, stored
        seen = dict((self._read(f"plans/{n - 1}.json") or {"to": []})["to"])
        kind = dict(log.dtypes)[self.at]
        fresh = ~F.coalesce(F.col(self.partition).isin([p for p in seen if p is not None]), F.lit(False)) if None not in seen else F.lit(False)
        if None in seen:
            fresh = F.col(self.partition).isNotNull() & ~F.col(self.partition).isin([p for p in seen if p is not None])
        for p, to in seen.items():
            fresh = fresh | (F.col(self.partition).eqNullSafe(F.lit(p)) & (F.col(self.at) > offset_literal(to, kind)))
        rows = (log.where(fresh) if seen else log).where(F.col(self.at).isNotNull()).select(F.col(self.partition).alias("p"), offset_of(self.at, kind).alias("o"))
        ends = {r[0]: r[1] for r in rows.groupBy("p").agg(F.max("o")).collect()}
        names = sorted({*seen, *ends}, key=str)
        plan = {"from": [[p, seen.get(p)] for p in names], "to": [[p, ends.get(p, seen.get(p))] for p in names]}
        self._write(f"plans/{n}.json", plan)
        return n, plan

    def _covered(self, log: DataFrame, plan: dict) -> DataFrame:
        kind = dict(log.dtypes)[self.at]
        within = F.col(self.at).isNull()
        for (p, lo), (_, hi) in zip(plan["from"], plan["to"], strict=True):
            if lo is None or lo < hi:
                own = F.col(self.partition).eqNullSafe(F.lit(p)) & (F.col(self.at) <= offset_literal(hi, kind))
                within = within | (own if lo is None else own & (F.col(self.at) > offset_literal(lo, kind)))
        return log.where(within)

    def run(self, log: DataFrame, fail_at: str | None = None) -> int:
        """Process one batch and commit it; its number. fail_at: for tests, the step after which to break off."""
        n, plan = self.plan(log)
        self._stop(fail_at, "plan")
        versions = (self._read(f"commits/{n - 1}.json") or {"buckets": {}})["buckets"]
        kinds = dict(log.dtypes)
        columns = ", ".join(f"`{k}` {kinds[k]}" for k in self.key)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        read = self._covered(log, plan).where(F.col(self.offset).isNotNull()).groupBy(*self.key).agg(F.max(self.offset).alias("new")).select("*", bucket).repartition("bucket")
        read.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch/{n}")
        self._stop(fail_at, "batch")
        touched = [x.split("=")[1] for x in self._names(f"batch/{n}") if x.startswith("bucket=")]
        both = self.spark.read.schema(f"{columns}, new {kinds[self.offset]}, bucket int").parquet(f"{self.root}/batch/{n}").select(*self.key, "new", F.lit(None).cast(kinds[self.offset]).alias("held"))
        held = [f"{self.root}/state/batch={versions[b]}/fresh=*/bucket={b}" for b in touched if b in versions]
        if held:
            state = self.spark.read.schema(f"{columns}, last_offset {kinds[self.offset]}").parquet(*held)
            both = both.unionByName(state.select(*self.key, F.lit(None).cast(kinds[self.offset]).alias("new"), F.col("last_offset").alias("held")))
        # the sink takes what is greater than all that it had of the key
        merged = both.groupBy(*self.key).agg(F.max("new").alias("new"), F.max("held").alias("held"))
        fresh = F.coalesce(F.col("new").isNotNull() & (F.col("held").isNull() | (F.col("new") > F.col("held"))), F.lit(False))
        merged = merged.select(*self.key, F.greatest("new", "held").alias("last_offset"), fresh.alias("fresh"), bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("fresh", "bucket").parquet(f"{self.root}/state/batch={n}")
        self._stop(fail_at, "state")
        self._write(f"commits/{n}.json", {"buckets": versions | {b: n for b in touched}, "key": columns, "offset": kinds[self.offset]})
        return n

    def has_plan(self) -> bool:
        """Whether a plan waits to be replayed."""
        return self._read(f"plans/{self.last_commit() + 1}.json") is not None

    @staticmethod
    def _stop(fail_at: str | None, step: str) -> None:
        if fail_at == step:
            raise BrokenOff(step)

    def result(self) -> DataFrame:
        """The rows of all committed batches, with their batch."""
        n = self.last_commit()
        if not n:
            raise ValueError("nothing is committed yet")
        kinds = self._read(f"commits/{n}.json")
        rows = self.spark.read.schema(f"{kinds['key']}, last_offset {kinds['offset']}, batch int, fresh boolean, bucket int").parquet(f"{self.root}/state")
        return rows.where(F.col("fresh") & (F.col("batch") <= n)).select(*self.key, F.col("last_offset").alias(self.offset), "batch")


class BrokenOff(RuntimeError):
    """A run that was broken off on purpose."""

    def __init__(self, step: str) -> None:
        super().__init__(f"broken off after {step}")


def capture_runs(documents: DataFrame, runs: DataFrame, root: str, buckets: int = 16) -> DataFrame:
    """changed_per_run by a ChangeCapture job that goes through the run log: every run reads what had arrived by its read_to, and runs that didn't succeed are broken off.

    They break off after plan, batch and state by turns. A run that succeeds first replays the plan that a broken one left, then reads on to its own
    read_to; both batches are its own. read_to must grow from one succeeded run to the next; a run that failed beyond the read_to of the next that
    succeeded is passed over, for what it planned is not the other's to commit. Columns as of changed_per_run.
    """
    spark = documents.sparkSession
    log = documents.withColumnRenamed("id", "doc_key")
    kind = dict(log.dtypes)["arrived_at"]
    job = ChangeCapture(spark, root, ["collection", "doc_key"], "revision", "collection", buckets=buckets)
    kept = {b.run_id: b.until for b in batches_of(runs)}
    failed = {r[0]: r[1] for r in runs.where(F.col("read_to").isNotNull() & F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("read_to")).collect() if r[0] not in kept}
    committed, steps = [], 0
    for run in sorted({*kept, *failed}):
        to = kept[run] if run in kept else failed[run]
        reach = log if to is None else log.where(F.col("arrived_at") <= offset_literal(micros(to), kind))
        if run in kept:
            committed += [(job.run(reach), run) for _ in range(1 + job.has_plan())]
            continue
        following = kept[min(r for r in kept if r > run)]
        if following is not None and to > following:
            continue
        steps += 1
        try:
            job.run(reach, fail_at=("plan", "batch", "state")[steps % 3])
        except BrokenOff:
            pass
    found = job.result().join(spark.createDataFrame(committed, "batch int, run_id bigint"), "batch")
    return found.select("run_id", "collection", "doc_key").distinct()
