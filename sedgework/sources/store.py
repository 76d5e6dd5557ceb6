"""Versioned snapshots: keyspaces of Parquet files under one manifest, committed together or not at all.

A keyspace is a list of parts, folders ``<root>/data/<keyspace>/<token>/``: base parts, whose rows all count, and then deltas, in
their order. A delta's rows replace all rows of their keys; a row with ``__gone`` only takes them away. A write adds a delta, so it costs what it
writes and not what is there; a read leaves the base rows of the deltas' keys out. When deltas become many they are merged
into one, and when they are large against the base, with it, in the keyspace's order. ``<root>/manifest/<n>.json`` names the parts
of each keyspace in snapshot n. A commit writes manifest n + 1 only if nobody else did; readers keep the snapshot they began with.
Nothing that a manifest names is ever written again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.errors import CommitConflict
from sedgework.operators.documents import last_writes

#: Snapshots that a vacuum keeps besides those named.
KEEP = 10
#: Deltas, or small base parts, of a keyspace from which they are merged, and the share of the base's rows from which deltas are merged with it.
DELTAS, SHARE = 8, 0.25
SMALL = 1_000_000
#: File systems on which a rename fails if the name is taken.
RENAMES = {"hdfs", "viewfs", "file"}


@dataclass(frozen=True)
class Snapshot:
    """number and, by keyspace, its parts, schema and rows (None if they must be counted)."""

    number: int
    keyspaces: dict[str, dict] = field(default_factory=dict)


class Store:
    """Snapshots under a folder that all executors share. durability ``full`` syncs a manifest before it counts; ``metadata-lazy`` and ``nosync`` leave that to the file system."""

    def __init__(self, spark: SparkSession, root: str, durability: str = "full") -> None:
        self.spark, self.root, self.durability = spark, root.rstrip("/"), durability
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def latest(self) -> Snapshot:
        numbers = self._numbers()
        return self.snapshot(numbers[-1]) if numbers else Snapshot(0)

    def snapshot(self, number: int) -> Snapshot:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{number}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(number, json.loads(text)["keyspaces"])

    def read(self, snapshot: Snapshot, keyspace: str) -> DataFrame | None:
        """The keyspace as of the snapshot; None if it isn't there."""
        at = snapshot.keyspaces.get(keyspace)
        return None if at is None else self.read_staged(at)

    def _parts(self, at: dict, delta: bool) -> list[dict]:
        return [p for p in at["parts"] if p["delta"] == delta]

    def _base(self, at: dict) -> DataFrame:
        schema = T.StructType.fromJson(at["schema"])
        paths = [f"{self.root}/{p['path']}" for p in self._parts(at, False)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _delta(self, at: dict) -> DataFrame:
        """The rows of a keyspace's deltas that no later delta replaces, with ``__gone``."""
        schema = T.StructType([*T.StructType.fromJson(at["schema"]).fields, T.StructField("__gone", T.BooleanType())])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{p['path']}") for p in self._parts(at, True)]
        if len(parts) == 1:
            return parts[0]
        rows = parts[0].withColumn("__n", F.lit(0))
        for n, part in enumerate(parts[1:], 1):
            rows = rows.unionByName(part.withColumn("__n", F.lit(n)))
        last = F.max("__n").over(Window.partitionBy(*at["keys"]))
        return rows.withColumn("__last", last).where(F.col("__n") == F.col("__last")).drop("__n", "__last")

    def read_staged(self, at: dict) -> DataFrame:
        base = self._base(at)
        if not self._parts(at, True):
            return base
        delta = self._delta(at)
        kept = base.join(delta.select(*at["keys"]), at["keys"], "left_anti").select(*base.columns)
        return kept.unionByName(delta.where(~F.col("__gone")).select(*base.columns))

    def _write(self, keyspace: str, rows: DataFrame, delta: bool, keys: Sequence[str] = (), numbers: str | None = None) -> dict:
        """Write a part: its path and rows; with keys, also whether keys repeat and the greatest of a column of numbers, found in the same pass over what was written."""
        path = f"data/{quote(keyspace, safe='')}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        found = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")
        if not keys:
            return {"path": path, "rows": found.count(), "delta": delta}  # from the files' footers
        one = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(numbers if numbers else F.lit(0).cast("bigint")).alias("top"))
        n, most, top = one.agg(F.sum("n"), F.max("n"), F.max("top")).first()
        return {"path": path, "rows": n or 0, "delta": delta, "repeats": (most or 0) > 1, "top": top}

    def read_part(self, at: dict, part: dict) -> DataFrame:
        """The rows of one part alone."""
        schema = T.StructType.fromJson(at["schema"])
        found = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("__gone", T.BooleanType())]) if part["delta"] else schema)
        return found.parquet(f"{self.root}/{part['path']}")

    def stage(self, keyspace: str, rows: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ()) -> dict:
        """Write a version of a keyspace that no manifest names yet. keys: what names a row; order: that in which rows are sorted when they are merged."""
        part = self._write(keyspace, rows, False)
        return {"parts": [part], "rows": part["rows"], "schema": rows.schema.jsonValue(), "keys": list(keys), "order": list(order)}

    def stage_more(self, keyspace: str, at: dict | None, rows: DataFrame) -> dict:
        """A version with rows added, for keyspaces whose rows are never replaced."""
        if at is None:
            return self.stage(keyspace, rows)
        part = self._write(keyspace, rows, False)
        new = at | {"parts": [*at["parts"], part], "rows": at["rows"] + part["rows"]}
        small = [p for p in new["parts"] if p["rows"] < SMALL]
        if len(small) > DELTAS:
            merged = self._write(keyspace, self._base(new | {"parts": small}).coalesce(1 + sum(p["rows"] for p in small) // SMALL), False)
            new = new | {"parts": [p for p in new["parts"] if p not in small] + [merged]}
        return new

    def stage_delta(self, keyspace: str, at: dict | None, rows: DataFrame, keys: Sequence[str], order: Sequence[str], unique: bool = False, numbers: str | None = None) -> tuple[dict, dict]:
        """A version in which rows (with ``__gone``) replace those of their keys, and the part that holds them. Without anything before, the rows that stay are the base.

        unique: a key may have one row only, so if keys repeat the rows are written once more, one row of each key, chosen by its hash.
        """
        columns = [c for c in rows.columns if c != "__gone"]
        first = at is None or not at["parts"]
        rows = rows.where(~F.col("__gone")).select(*columns) if first else rows.select(*columns, "__gone")
        part = self._write(keyspace, rows.sortWithinPartitions(*order), not first, keys if unique else (), numbers)
        if part.get("repeats"):
            written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{part['path']}")
            part = self._write(keyspace, last_writes(written, keys, F.lit(0)).sortWithinPartitions(*order), not first, keys, numbers)
        if first:
            return {"parts": [part], "rows": part["rows"], "schema": rows.schema.jsonValue(), "keys": list(keys), "order": list(order)}, part
        return self._merged(keyspace, at | {"parts": [*at["parts"], part], "rows": None, "keys": list(keys), "order": list(order)}), part

    def _merged(self, keyspace: str, at: dict) -> dict:
        deltas = self._parts(at, True)
        if len(deltas) <= DELTAS:
            return at
        if sum(p["rows"] for p in deltas) >= SHARE * sum(p["rows"] for p in self._parts(at, False)):
            return self.stage(keyspace, self.in_order(self.read_staged(at), at["order"]), at["keys"], at["order"]) | {"meta": at.get("meta", {})}
        one = self._write(keyspace, self._delta(at).sortWithinPartitions(*at["order"]), True)
        return at | {"parts": [*self._parts(at, False), one]}

    @staticmethod
    def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
        """Range-partitioned and sorted, so that a look-up reads few files."""
        return rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows

    def count(self, at: dict) -> int:
        return at["rows"] if at["rows"] is not None else self.read_staged(at).count()

    def commit(self, base: Snapshot, staged: dict[str, dict | None]) -> Snapshot:
        """Publish staged versions on top of base; None drops a keyspace. Raises CommitConflict if base isn't the latest any more."""
        keyspaces = {k: v for k, v in (base.keyspaces | staged).items() if v is not None}
        number = base.number + 1
        text = json.dumps({"keyspaces": keyspaces}, sort_keys=True)
        if not (self._publish_local(number, text) if self._local else self._publish(number, text)):
            raise CommitConflict(f"snapshot {number} was committed by another writer")
        return Snapshot(number, keyspaces)

    def _publish_local(self, number: int, text: str) -> bool:
        folder = os.path.join(urlparse(self.root).path if "://" in self.root or self.root.startswith("file:") else self.root, "manifest")
        aside = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(aside, "w") as out:
            out.write(text)
            if self.durability == "full":
                out.flush()
                os.fsync(out.fileno())
        try:
            os.link(aside, os.path.join(folder, f"{number}.json"))  # fails if the name is taken
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        if self.durability == "full":
            at = os.open(folder, os.O_RDONLY)
            os.fsync(at)
            os.close(at)
        return True

    def _publish(self, number: int, text: str) -> bool:
        """By a rename where a rename onto a name that is taken fails, else by a create that does (object stores show a file only when it is whole)."""
        final = self._path(f"{self.root}/manifest/{number}.json")
        renames = self._fs.getUri().getScheme() in RENAMES
        at = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}") if renames else final
        try:
            out = self._fs.create(at, False)
            out.write(bytearray(text.encode()))
            if self.durability == "full" and renames:
                out.hsync()
            out.close()
        except Exception:
            if not renames and self._fs.exists(final):
                return False
            raise
        if renames and not self._fs.rename(at, final):
            self._fs.delete(at, False)
            return False
        return True

    def vacuum(self, keep: int = KEEP) -> int:
        """Delete all but the last ``keep`` snapshots and the data that no other names; how many versions of keyspaces went. Not while a writer has staged data."""
        numbers = self._numbers()
        for number in numbers[:-keep] if keep else numbers:
            self._fs.delete(self._path(f"{self.root}/manifest/{number}.json"), False)
        used = {p["path"] for n in self._numbers() for v in self.snapshot(n).keyspaces.values() for p in v["parts"]}
        gone = 0
        data = self._path(f"{self.root}/data")
        for keyspace in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for version in self._fs.listStatus(keyspace.getPath()):
                if f"data/{keyspace.getPath().getName()}/{version.getPath().getName()}" not in used:
                    self._fs.delete(version.getPath(), True)
                    gone += 1
        return gone
