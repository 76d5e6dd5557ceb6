"""Implausible spikes in measurements, relative to what each source normally does.

Every reading of a series is scored by an isolation forest grown on that series' ordinary readings: its level against the
stretch around it, its step from the ordinary reading before, its level against the same time of day, and the length of the
run of equal readings it is in, all in units in which ``CUT`` is the limit of what is ordinary. A reading is a spike if its score is
above the one that the same forest gives to a reading that stands off by just CUT, so each source has a threshold of its own. Two
rules of physics hold without a score: a reading that is no finite number above zero, and one of at least
``STUCK`` successive equal readings.

Repeats are removed first. Levels and spreads are those around a reading: series are read in windows of ``CHUNK`` readings, nulls
not counted, with MARGIN readings of each neighbour; most series are one window. A forest is its whole series': it is grown on
the ``SAMPLE`` ordinary readings of least hash and scores all readings of all windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.functions.batches import whole_groups
from sedgework.functions.series import deviations, grow, run_lengths
from sedgework.operators.chunking import chunked
from sedgework.sources.scratch import Scratch

CHUNK, MARGIN = 4096, 256
#: Between the four deviations within which ordinary readings stay and the six from which a reading is a case.
CUT = 5.0
STUCK = 5
TREES, SAMPLE = 24, 128
#: The room around a node's range, and how often each feature is drawn.
PAD, WEIGHTS = 4.0, (3, 1, 1, 1)
HOURS = 6
#: Series whose forests are grown together: arrays stay small enough for the processor's caches.
TOGETHER = 16

FEATURES = ["__level", "__step", "__season", "__run"]
#: A step is the difference of two readings; a run of STUCK readings is at the limit.
_STEP, _RUN = 1 / np.sqrt(2), CUT / (STUCK - 1)
#: Readings that stand off by just CUT, upwards and downwards, after a reading at the level.
PROBES = np.array([[side * CUT, side * CUT * _STEP, side * CUT, 0.0] for side in (1, -1)])


def featured(values: np.ndarray, hours: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
    """Features, deviation, run length and reason so far of each reading of several series, one after another, each in order of time. number: of a reading's series, ascending.

    NaN is a reading here, nulls have been left out. ``ordinary`` tells what a forest can be grown on.
    """
    n = len(values)
    place = np.arange(n)
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]][:n])
    finite = np.isfinite(values) & (values > 0)
    runs, z = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
    for lo, hi in zip(starts, np.r_[starts[1:], n][: len(starts)], strict=True):
        runs[lo:hi] = run_lengths(values[lo:hi])
        z[lo:hi] = deviations(values[lo:hi], finite[lo:hi] & (runs[lo:hi] < STUCK), CUT)[0]
    stuck = runs >= STUCK
    level = np.where(np.isnan(z), 0.0, z)
    ordinary = finite & ~stuck & (np.abs(level) <= CUT)
    last = np.maximum.accumulate(np.where(ordinary, place, -1)) if n else place
    before = np.r_[-1, last[:-1]][:n]
    begin = np.repeat(starts, np.diff(np.r_[starts, n]))
    step = (level - np.where(before >= begin, level[before], 0.0)) * _STEP if n else level
    slot = number * (24 // HOURS + 1) + np.nan_to_num(hours).astype(int) // HOURS
    usual = pd.Series(level[ordinary]).groupby(slot[ordinary]).median()
    season = level - usual.reindex(slot).fillna(0.0).to_numpy()
    return {"__level": level, "__step": step, "__season": season, "__run": (runs - 1) * _RUN, "ordinary": ordinary, "deviation": z, "run_length": runs, "reason": np.where(~finite, "not_positive", np.where(stuck, "stuck", None))}


def decided(features: np.ndarray, source: np.ndarray, train: np.ndarray, train_source: np.ndarray, n_sources: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and threshold of each row of features by the forest of its source, grown on the rows of train. A source without two of them has no threshold (NaN)."""
    score, limit = np.zeros(len(features)), np.zeros(n_sources)
    for begin in range(0, n_sources, TOGETHER):
        k = min(TOGETHER, n_sources - begin)
        own, fit = (source >= begin) & (source < begin + k), (train_source >= begin) & (train_source < begin + k)
        forests = grow(train[fit], train_source[fit] - begin, k, WEIGHTS, PAD, TREES)
        score[own] = forests.scores(features[own], source[own] - begin)
        limit[begin : begin + k] = np.min([forests.scores(np.tile(p, (k, 1)), np.arange(k)) for p in PROBES], axis=0)
        limit[begin : begin + k][forests.sizes < 2] = np.nan
    return score, limit[source]


def _featured_rows(rows: pd.DataFrame, number: np.ndarray) -> pd.DataFrame:
    hours = pd.to_datetime(rows["__at"]).dt.hour.to_numpy(dtype=float)
    return rows.assign(**featured(rows["__value"].to_numpy(dtype=float), hours, number))


def _once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with one row for each ``__id`` of a series, the first delivered, by partial aggregates; of rows that arrived together the least. Rows without ``__id`` all stay."""
    rest = [c for c in rows.columns if c not in {*keys, "__id"}]
    first = F.min(F.struct(F.col("__arrived").isNull().alias("__late"), *[F.col(c) for c in ["__arrived", *[c for c in rest if c != "__arrived"]]])).alias("__first")
    one = rows.where(F.col("__id").isNotNull()).groupBy(*keys, "__id").agg(first)
    return one.select(*keys, "__id", *[F.col("__first")[c].alias(c) for c in rest]).unionByName(rows.where(F.col("__id").isNull()))


def judged(readings: DataFrame, fields: Sequence[str], series: Sequence[str] = ("runner", "metric"), item: str = "measurement_id", at: str = "measured_at", cases_only: bool = False) -> DataFrame:
    """One row per non-null reading: item, field_name, score, threshold, deviation, run_length, reason (null if ordinary).

    readings: series columns, item, at, ``arrived_at`` and the numeric fields; other columns are ignored. A series is one
    field of one combination of the series columns, nulls being values, in order of at (null first), then item.
    Repeats of an item count once, as first delivered; rows without item all count. Nulls are left out before
    successive readings are counted. Series of fewer than three usable readings have no spikes. cases_only leaves
    out ordinary readings. Empty input gives no rows.
    """
    series, fields = list(series), list(fields)
    types = {f.name: f.dataType for f in readings.schema.fields}
    out = T.StructType([T.StructField(item, types[item]), T.StructField("field_name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("deviation", T.DoubleType()), T.StructField("run_length", T.LongType()), T.StructField("reason", T.StringType())])
    names = np.array(fields, dtype=object)

    def result(rows: pd.DataFrame, score: np.ndarray, limit: np.ndarray) -> pd.DataFrame:
        spike = rows["reason"].isna().to_numpy() & (score > limit)
        reason = rows["reason"].mask(spike, "spike")
        score = np.where(reason.eq("not_positive"), np.nan, score)
        found = pd.DataFrame({item: rows["__id"], "field_name": names[rows["__field"].to_numpy()], "score": score, "threshold": limit, "deviation": rows["deviation"], "run_length": rows["run_length"], "reason": reason})
        return found[reason.notna()] if cases_only else found

    def judge_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, number in whole_groups(batches, [*keys, "__field"]):
            found = _featured_rows(rows, number)
            order = np.lexsort((found["__hash"].to_numpy(), number))
            order = order[found["ordinary"].to_numpy()[order]]
            rank = pd.Series(number[order]).groupby(number[order]).cumcount().to_numpy()
            fit = order[rank < SAMPLE]
            matrix = found[FEATURES].to_numpy()
            yield result(found, *decided(matrix, number, matrix[fit], number[fit], int(number[-1]) + 1))

    def feature_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, number in whole_groups(batches, [*keys, "__field", "__chunk"]):
            found = _featured_rows(rows, number)
            yield found[found["__core"]][kept_columns]

    def judge_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, number in whole_groups(batches, [*keys, "__field", "__chunk"]):
            train = rows["__train"].to_numpy(dtype=bool)
            matrix, own = rows[FEATURES].to_numpy(dtype=float), rows[~train]
            yield result(own, *decided(matrix[~train], number[~train], matrix[train], number[train], int(number[-1]) + 1))

    keys = [f"__s{i}" for i in range(len(series))]
    values = [f"__f{i}" for i in range(len(fields))]
    slim = readings.select(*[F.col(c).alias(k) for c, k in zip(series, keys, strict=True)], F.col(item).alias("__id"), F.col(at).alias("__at"), F.col("arrived_at").alias("__arrived"), *[F.col(f).cast("double").alias(v) for f, v in zip(fields, values, strict=True)])
    each = F.array(*[F.struct(F.lit(i).alias("__field"), F.col(v).alias("__value")) for i, v in enumerate(values)])
    long = _once(slim, keys).select(*keys, "__id", "__at", "__arrived", F.inline(each)).where(F.col("__value").isNotNull())
    long = long.withColumn("__hash", F.xxhash64("__id", "__at", "__value"))
    scratch = Scratch(readings.sparkSession, "spikes")
    few, windows = chunked(scratch.keep(long, "readings"), [*keys, "__field"], "__at", "__id", CHUNK, MARGIN)
    by, order = [*keys, "__field", "__chunk"], ["__at", "__id", "__arrived", "__value"]
    short = few.drop("__core", "__n").repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(judge_short, out)

    if windows is None:
        return short
    kept_columns = [*by, "__id", "__hash", "__n", *FEATURES, "ordinary", "deviation", "run_length", "reason"]
    kept = T.StructType([windows.schema[c] for c in [*by, "__id", "__hash", "__n"]] + [T.StructField(c, T.DoubleType()) for c in FEATURES] + [T.StructField("ordinary", T.BooleanType()), T.StructField("deviation", T.DoubleType()), T.StructField("run_length", T.LongType()), T.StructField("reason", T.StringType())])
    whole = windows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(feature_long, kept)
    whole = scratch.keep(whole, "features")
    # about eight times the sample, so that few rows of a series, however long it is, are ranked
    share = (F.col("__hash") / F.lit(2.0**63) + 1) / 2 < F.lit(8.0 * SAMPLE) / F.col("__n")
    least = Window.partitionBy(*keys, "__field").orderBy("__hash", "__chunk", *FEATURES)
    sample = whole.where(F.col("ordinary") & share).withColumn("__r", F.row_number().over(least)).where(F.col("__r") <= SAMPLE)
    sample = sample.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, "__field"])], *FEATURES)
    chunks = whole.select(*by).distinct()
    same = F.lit(True)
    for i, c in enumerate([*keys, "__field"]):
        same = same & chunks[c].eqNullSafe(sample[f"__k{i}"])
    train = chunks.join(sample, same).select(*by, *FEATURES, F.lit(True).alias("__train"))
    both = whole.drop("__hash", "__n", "ordinary").withColumn("__train", F.lit(False)).unionByName(train, allowMissingColumns=True)
    return short.unionByName(both.repartition(*by).sortWithinPartitions(*by).mapInPandas(judge_long, out))


def cases(readings: DataFrame, fields: Iterable[str], **how: object) -> DataFrame:
    """The readings that can't be right: item, field_name."""
    found = judged(readings, list(fields), cases_only=True, **how)
    return found.select(found.columns[0], "field_name")
