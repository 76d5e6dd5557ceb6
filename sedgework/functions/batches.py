"""Groups of rows in a stream of batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def starts(rows: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Whether each row begins a group: it differs in by from the row before. Nulls are equal."""
    new = np.zeros(len(rows), dtype=bool)
    for c in by:
        now, before = rows[c], rows[c].shift()
        new |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(dtype=bool)
    new[:1] = True
    return new


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows in whole groups and the number of each row's group; rows come sorted by group. What is held is a batch and the group that it ends in."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if starts(pd.concat([held[0].iloc[:1], batch], ignore_index=True), by)[1:].any():
            rows = pd.concat(held, ignore_index=True)
            begin = starts(rows, by)
            cut = int(np.flatnonzero(begin)[-1])
            if cut:
                yield rows.iloc[:cut], np.cumsum(begin[:cut]) - 1
            held = [rows.iloc[cut:]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, np.cumsum(starts(rows, by)) - 1
