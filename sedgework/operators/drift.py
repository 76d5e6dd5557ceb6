"""Schemas that drift between files: one consistent table of all, and a report of each change.

Every file is profiled where it lies: its top-level fields with type and a sketch of the value. Within a
suite each file is held against the one before. Fields that went and fields that came are matched, type by
type, as a bipartite graph weighted by likeness of names and of values: a pair is a rename. Names that renames
join, and that are not found in one file together, become one column of the unified table.

Long suites are cut into chunks of ``CHUNK`` files. Each chunk is first summed up by what it makes of any state before
it; the summaries, one row a chunk, are folded along the suite; then each chunk is read with the state that it begins with.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.functions import layouts
from sedgework.operators.chunking import chunked
from sedgework.sources.scratch import Scratch

CHUNK = 2048
#: Fields that get a column of their own in the unified table; rarer ones share one.
COLUMNS = 5000

PROFILE = "file_id bigint, suite string, committed_at timestamp, layout string"
CHANGES = "file_id bigint, field_name string, change_kind string, former_name string"


def profiles(files: DataFrame) -> DataFrame:
    """file_id, suite, committed_at and layout of the files whose body is a JSON object; layout is JSON: field -> [type or null, sketch, layouts.width_of].

    Written once, so that bodies are parsed once however often the profiles are read.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            objects, kept = _objects(batch)
            texts = [json.dumps({k: [layouts.type_of(v), None if v is None else layouts.sketch(v), layouts.width_of(v)] for k, v in o.items()}) for o in objects]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=["file_id", "suite", "committed_at", "layout"])

    found = files.select("file_id", "suite", F.col("committed_at").cast("timestamp"), "body").mapInArrow(profile, PROFILE)
    return Scratch(files.sparkSession, "drift").keep(found, "profiles")


def _objects(batch: pa.RecordBatch) -> tuple[list[dict], list[pa.Array]]:
    """The JSON objects of a batch of files (file_id, suite, committed_at, body) and the other columns of their rows."""
    found = [layouts.parse_object(b) for b in batch.column(3).to_pylist()]
    at = pa.array([i for i, o in enumerate(found) if o is not None], pa.int64())
    return [o for o in found if o is not None], [batch.column(i).take(at) for i in range(3)]


def _load(text: str | None) -> layouts.State | None:
    return None if text is None else {k: tuple(x[:2]) for k, x in json.loads(text).items()}


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["committed_at", "file_id"], kind="stable", na_position="first")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    group = _ordered(group)
    state = _load(group["before"].iloc[0]) if group["before"].notna().any() else None
    rows = []
    for file_id, text in zip(group["file_id"], group["layout"], strict=True):
        state, changes = layouts.step(state, _load(text))
        rows += [(file_id, *c) for c in changes]
    return pd.DataFrame(rows, columns=["file_id", "field_name", "change_kind", "former_name"])


def _sum_up(group: pd.DataFrame) -> pd.DataFrame:
    group = _ordered(group)
    after = layouts.summary([_load(t) for t in group["layout"]])
    return pd.DataFrame({"suite": [group["suite"].iloc[0]], "chunk": [group["__chunk"].iloc[0]], "after": [json.dumps(after)]})


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    state, before = None, []
    for text in group["after"]:
        before.append(None if state is None else json.dumps(state))
        state = layouts.carried(state, _load(text))
    return pd.DataFrame({"suite": group["suite"], "chunk": group["chunk"], "before": before})


def changes(files: DataFrame) -> DataFrame:
    """Each change of a file against the file before it in its suite: file_id, field_name, change_kind, former_name.

    files: file_id, suite, committed_at, body; other columns are ignored. Order is by committed_at, null first,
    then file_id. change_kind is ``added``, ``removed``, ``retyped`` or ``renamed``; former_name is set for renames, else ''.
    Files whose body is null, empty, cut off, no JSON or no object are left out; the first file of a suite has
    no changes, and a file delivered twice none at the second. A null suite is a suite. If several fields of one
    type went and several came, as many as possible are renames, those most alike being paired.
    """
    return changes_of(profiles(files))


def changes_of(profiled: DataFrame) -> DataFrame:
    """changes() of files whose profiles are known."""
    few, many = chunked(profiled, ["suite"], "committed_at", "file_id", CHUNK)
    short = few.select("suite", "__chunk", "file_id", "committed_at", "layout", F.lit(None).cast("string").alias("before"))
    if many is not None:
        long = many.select("suite", "__chunk", "file_id", "committed_at", "layout")
        summed = long.groupBy("suite", "__chunk").applyInPandas(_sum_up, "suite string, chunk bigint, after string")
        begun = summed.groupBy("suite").applyInPandas(_fold, "suite string, chunk bigint, before string").select(F.col("suite").alias("s"), F.col("chunk").alias("c"), "before")
        short = short.unionByName(long.join(begun, long["suite"].eqNullSafe(begun["s"]) & (long["__chunk"] == begun["c"])).select(*short.columns))
    return short.groupBy("suite", "__chunk").applyInPandas(_walk, CHANGES)


def one_names(profiled: DataFrame, found: DataFrame) -> dict[str, str]:
    """Field name -> column of the unified table, for the ``COLUMNS`` names that most files have. Only those come to the driver, with their numbers of files, renames and files together.

    Names that a rename joins are one column, named by the most frequent, unless some file has two of the
    column's names. Pairs renamed more often come first.
    """
    fields = profiled.select("file_id", F.explode(F.json_object_keys("layout")).alias("name"))
    top = fields.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(COLUMNS)
    count = {r[0]: r[1] for r in top.collect()}
    own = top.select("name")
    pairs = found.where(F.col("change_kind") == "renamed").groupBy(F.least("field_name", "former_name").alias("a"), F.greatest("field_name", "former_name").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    links = pairs.join(own.withColumnRenamed("name", "a"), "a", "left_semi").join(own.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b", "n").collect()
    if not links:
        return {k: k for k in count}
    linked = sorted({x for r in links for x in r[:2]})
    known = fields.where(F.col("name").isin(linked))
    together = {frozenset(r) for r in known.alias("x").join(known.alias("y"), (F.col("x.file_id") == F.col("y.file_id")) & (F.col("x.name") < F.col("y.name"))).select("x.name", "y.name").distinct().collect()}
    group = {k: {k} for k in count}
    for a, b, _ in sorted(links, key=lambda r: (-r[2], r[0], r[1])):
        if group[a] is not group[b] and not any(frozenset((x, y)) in together for x in group[a] for y in group[b]):
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    return {k: max(g, key=lambda x: (count[x], x)) for k, g in group.items()}


def column_names(fields: Sequence[str], taken: Iterable[str]) -> list[str]:
    """Names for columns that Spark can tell apart, case aside: a field's own, ``field_`` before one that is taken, a number after one that differs in case only."""
    used = {t.lower() for t in taken}
    out = []
    for name in fields:
        own = f"field_{name}" if name.lower() in used and name.lower() in {t.lower() for t in taken} else name
        free, n = own, 2
        while free.lower() in used:
            free, n = f"{own}_{n}", n + 1
        used.add(free.lower())
        out.append(free)
    return out


def unified(files: DataFrame) -> DataFrame:
    """One table of all files that are JSON objects: file_id, suite, committed_at and a column per field, renamed fields in one.

    A column is bigint, double or boolean if all its values are whole, numbers or booleans; else it is
    string, objects and arrays being JSON text. A bigint column with whole numbers beyond 64 bits is decimal(38,0) instead;
    with one of more than 38 digits, it, or a double column, is string. Columns are in order of name; one that clashes with file_id,
    suite or committed_at gets ``field_`` before its name, one that differs from another in case only a number after it. If files have more than
    ``COLUMNS`` names, the values of the rarer ones are kept in ``other_fields``, a JSON object.
    """
    profiled = profiles(files)
    to = one_names(profiled, changes_of(profiled))
    kinds: dict[str, set[str]] = {}
    widths: dict[str, int] = {}
    seen = profiled.select(F.explode(F.from_json("layout", "map<string, array<string>>")).alias("name", "x")).groupBy("name").agg(F.collect_set(F.element_at("x", 1)).alias("kinds"), F.max(F.element_at("x", 3).cast("int")).alias("width"))
    names_wanted = files.sparkSession.createDataFrame([(k,) for k in to], "name string")
    for name, own, width in seen.join(names_wanted, "name", "left_semi").select("name", "kinds", "width").collect():
        widths[to[name]] = max(width, widths.get(to[name], 0))
        kinds.setdefault(to[name], set()).update(own)
    columns = sorted(kinds)
    type_name = {frozenset(): "string", frozenset({layouts.WHOLE}): "bigint", frozenset({layouts.POINT}): "double", frozenset({layouts.WHOLE, layouts.POINT}): "double", frozenset({layouts.BOOLEAN}): "boolean"}
    wider = {("bigint", 1): "decimal(38,0)", ("bigint", 2): "string", ("double", 2): "string"}
    types = [type_name.get(frozenset(kinds[c]), "string") for c in columns]
    types = [wider.get((t, widths[c]), t) for t, c in zip(types, columns, strict=True)]
    fixed = ["file_id", "suite", "committed_at"]
    more = len(to) == COLUMNS
    names = column_names(columns, [*fixed, "other_fields"] if more else fixed)
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(columns)}
        for batch in batches:
            objects, kept = _objects(batch)
            values: list[list[str | None]] = [[None] * len(objects) for _ in columns]
            rest: list[str | None] = [None] * len(objects)
            for row, found in enumerate(objects):
                other = {}
                for name, value in found.items():
                    if value is not None:
                        if name in to:
                            values[place[to[name]]][row] = layouts.text_of(value)
                        else:
                            other[name] = layouts.text_of(value)
                if other:
                    rest[row] = json.dumps(other, ensure_ascii=False)
            arrays = [pa.array(v, pa.string()) for v in ([*values, rest] if more else values)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*fixed, *names, *(["other_fields"] if more else [])])

    raw = files.select("file_id", "suite", F.col("committed_at").cast("timestamp").alias("committed_at"), "body").mapInArrow(spread, "file_id bigint, suite string, committed_at timestamp, " + ", ".join(f"{q} string" for q in [*quoted, *(["other_fields"] if more else [])]))
    wide = {"bigint": "try_cast({} as bigint)", "decimal(38,0)": "try_cast({} as decimal(38,0))", "double": "try_cast({} as double)", "boolean": "try_cast({} as boolean)", "string": "{}"}
    return raw.selectExpr(*fixed, *[f"{wide[t].format(q)} as {q}" for q, t in zip(quoted, types, strict=True)], *(["other_fields"] if more else []))
