"""Levels, spreads and isolation scores of one series of measurements, in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Least readings of a stretch at one level, and the t value from which two stretches differ in level.
LEAST_STRETCH, LEVEL_T = 6, 5.5
#: Readings on each side in the first, rough comparison.
SIDE = 12
#: Trees are as deep as those of so many rows at least, whatever other sources a forest is grown with.
SAMPLE_DEPTH = 128


def run_lengths(values: np.ndarray) -> np.ndarray:
    """For each value the length of the run of equal values that it is in. NaN equals nothing."""
    n = len(values)
    if not n:
        return np.zeros(0, dtype=int)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    lengths = np.diff(np.r_[starts, n])
    return np.repeat(lengths, lengths)


def _side_medians(y: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the SIDE clean values before and after each place, NaN where there are none."""
    at = np.flatnonzero(clean)
    k = len(at)
    before = np.cumsum(clean) - clean  # clean values before each place
    padded = np.r_[np.full(SIDE, np.nan), y[at], np.full(SIDE, np.nan)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, SIDE)  # window j ends before clean value j
    ordered = np.sort(windows, axis=1)  # NaN comes last
    valid = SIDE - np.isnan(windows).sum(axis=1)
    pick = lambda i: np.take_along_axis(ordered, np.clip(i, 0, SIDE - 1)[:, None], axis=1)[:, 0]
    middle = np.where(valid > 0, (pick((valid - 1) // 2) + pick(valid // 2)) / 2, np.nan)
    left = middle[before]
    right = middle[np.minimum(before + clean + SIDE, k + SIDE)]
    return left, right


def _split(x: np.ndarray, lo: int, hi: int, spread: float, cuts: list[int]) -> None:
    """Binary segmentation of x[lo:hi] by mean, in units of spread relative to the level."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n < 2 * LEAST_STRETCH:
            continue
        part = x[lo:hi]
        total = np.cumsum(part)
        k = np.arange(LEAST_STRETCH, n - LEAST_STRETCH + 1)
        left, right = total[k - 1] / k, (total[-1] - total[k - 1]) / (n - k)
        t = np.abs(left - right) / (spread * np.minimum(left, right) * np.sqrt(1 / k + 1 / (n - k)))
        best = int(np.argmax(t))
        if t[best] > LEVEL_T:
            cuts.append(lo + int(k[best]))
            todo += [(lo, lo + int(k[best])), (lo + int(k[best]), hi)]


def deviations(values: np.ndarray, usable: np.ndarray, cut: float = 5.0, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each usable value stands off from the level around it, in standard deviations of the ordinary values there.

    values: positive where usable. Levels are piecewise constant and spreads in proportion to them. First each value
    is compared with the medians of the clean values before and after it, and counts as clean if it fits either; then the clean
    values are cut into stretches of one level, each with its mean and spread, and all values are compared with their
    stretch, those between two stretches with the nearer level. That is repeated with what is clean now.
    Returns deviations (signed, NaN if not usable), levels and relative spreads.
    """
    n = len(values)
    nothing = np.full(n, np.nan)
    if usable.sum() < 3:
        return np.where(usable, 0.0, np.nan), np.where(usable, values, np.nan), nothing
    clean = usable.copy()
    y = np.where(usable, values, np.nan)
    for _ in range(2):
        left, right = _side_medians(y, clean)
        a, b = y / left - 1, y / right - 1
        off = np.fmin(np.abs(a), np.abs(b))
        scale = 1.4826 * np.nanmedian(off[clean])
        if not scale > 0:
            scale = np.nanmean(off[clean]) or 1e-9
        clean = usable & (off <= 6 * scale)
        if clean.sum() < 3:
            clean = usable.copy()
            break
    z = level_of = spread_of = nothing
    for _ in range(rounds):
        at = np.flatnonzero(clean)
        x = values[at]
        step = np.diff(x) / np.minimum(x[1:], x[:-1])
        spread = max(1.4826 * float(np.median(np.abs(step))) / np.sqrt(2), 1e-9) if len(step) else 1e-9
        cuts: list[int] = []
        _split(x, 0, len(x), spread, cuts)
        edges = np.array([0, *sorted(cuts), len(x)])
        own = np.searchsorted(edges, np.arange(len(x)), side="right") - 1
        level = np.add.reduceat(x, edges[:-1]) / np.diff(edges)
        rest = x / level[own] - 1
        pooled = np.sqrt(np.sum(rest**2) / max(1, len(x) - len(level)))
        sizes = np.diff(edges)
        each = np.sqrt(np.add.reduceat(rest**2, edges[:-1]) / np.maximum(1, sizes - 1))
        each = np.where(sizes >= 20, each, np.where(sizes >= 3, np.sqrt((each**2 * sizes + pooled**2 * 20) / (sizes + 20)), pooled))
        each = np.maximum(each, 1e-9)
        before = np.searchsorted(at, np.arange(n), side="right") - 1
        lo, hi = own[np.clip(before, 0, len(x) - 1)], own[np.clip(np.where(clean, before, before + 1), 0, len(x) - 1)]
        za, zb = (y / level[lo] - 1) / each[lo], (y / level[hi] - 1) / each[hi]
        use_lo = np.abs(za) <= np.abs(zb)
        z = np.where(use_lo, za, zb)
        level_of, spread_of = np.where(use_lo, level[lo], level[hi]), np.where(use_lo, each[lo], each[hi])
        now = usable & (np.abs(z) <= cut)
        if now.sum() < 3 or (now == clean).all():
            break
        clean = now
    return np.where(usable, z, np.nan), level_of, spread_of


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n values, by which isolation depths are measured."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forests:
    """Isolation forests of several sources, grown together. splits: for each level an array by (tree, source, node); depths: how deep a row is cut off, by the nodes of the last level."""

    feature: np.ndarray
    splits: list[np.ndarray]
    depths: np.ndarray
    sizes: np.ndarray

    def scores(self, features: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Scores in (0, 1] of rows of features, each by the forest of its source; the greater, the sooner a row is cut off. 0.5 where a source has no forest."""
        columns = np.ascontiguousarray(features.T)
        at = _roots(source, len(self.sizes), len(self.feature))
        for level, split in enumerate(self.splits):
            at = 2 * at + (columns[self.feature[:, level]] >= split[at])
        usual = np.maximum(average_path(self.sizes), 1e-9)[source]
        return np.where(self.sizes[source] > 1, 2.0 ** (-self.depths[at].mean(axis=0) / usual), 0.5)


def _roots(source: np.ndarray, n_sources: int, trees: int) -> np.ndarray:
    return (np.arange(trees, dtype=np.int32)[:, None] * n_sources + source.astype(np.int32)).astype(np.int32)


def grow(features: np.ndarray, source: np.ndarray, n_sources: int, weights: Sequence[float], pad: float, trees: int, seed: int = 0) -> Forests:
    """One isolation forest per source on the rows of features (a bounded sample; source: the number of each row's).

    Each tree grows to depth log2 of the largest source's rows, one more for the room around them: at each level of a tree a feature is
    drawn by weights, and at each node a split from the range that the node's rows have in it, widened by pad on both sides. The room lets scores tell
    how far outside a reading lies, which the range alone can't.
    """
    sizes = np.bincount(source, minlength=n_sources)
    depth = int(np.ceil(np.log2(max(2, SAMPLE_DEPTH, sizes.max(initial=2))))) + 1
    rng = np.random.default_rng(seed)
    feature = rng.choice(features.shape[1], size=(trees, depth), p=np.asarray(weights) / np.sum(weights))
    columns = np.ascontiguousarray(features.T)
    at = _roots(source, n_sources, trees)
    cut_off = np.full(trees * n_sources, np.nan)
    splits = []
    for level in range(depth):
        slots = trees * n_sources << level
        count = np.bincount(at.ravel(), minlength=slots)
        cut_off = np.where(np.isnan(cut_off) & (count <= 1), level, cut_off)
        values = columns[feature[:, level]]
        lo, hi = np.full(slots, np.inf), np.full(slots, -np.inf)
        np.minimum.at(lo, at.ravel(), values.ravel())
        np.maximum.at(hi, at.ravel(), values.ravel())
        chance = rng.random((trees, 1, 1 << level))  # a source's forest doesn't depend on those it is grown with
        chance = np.broadcast_to(chance, (trees, n_sources, 1 << level)).ravel()
        with np.errstate(invalid="ignore"):
            split = np.where(count > 1, lo - pad + chance * (hi - lo + 2 * pad), np.inf)
        splits.append(split)
        at = 2 * at + (values >= split[at])
        cut_off = np.repeat(cut_off, 2)
    count = np.bincount(at.ravel(), minlength=trees * n_sources << depth)
    further = average_path(np.arange(count.max(initial=0) + 1))[count]
    return Forests(feature, splits, np.where(np.isnan(cut_off), depth + further, cut_off), sizes)
