"""Runs of equal keys in sorted streams of rows, for bucket joins within a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAIRS = 1 << 17


def runs(tables: Iterator[np.ndarray], most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """From tables of int64 rows, sorted by column 0 over all of them:

    ("short", rows, starts with the total at the end): all runs of 2 to `most` rows of a table at once;
    ("long", rows, []): a run of more rows, and ("more", rows, []): a further part of it, so that a run
    of any length passes through in parts."""
    rest = None
    going = None
    for x in tables:
        if rest is not None and len(rest):
            x = np.concatenate([rest, x])
        if not len(x):
            continue
        if going is not None and x[0, 0] != going:
            going = None
        at = np.concatenate([[0], np.flatnonzero(x[1:, 0] != x[:-1, 0]) + 1, [len(x)]])
        rest = x[at[-2] :]
        size = np.diff(at)[:-1]
        begin = 0
        if going is not None and len(size):
            yield "more", x[: at[1]], at[:0]
            begin, going = 1, None
        short = np.flatnonzero((size >= 2) & (size <= most))
        short = short[short >= begin]
        if len(short):
            which = np.zeros(len(size), dtype=bool)
            which[short] = True
            rows = x[: at[-2]][np.repeat(which, size)]
            yield "short", rows, np.concatenate([[0], np.cumsum(size[short])])
        for g in np.flatnonzero(size > most):
            if g >= begin:
                yield "long", x[at[g] : at[g + 1]], at[:0]
        if going is not None or len(rest) > most:
            yield "more" if going is not None else "long", rest, at[:0]
            going, rest = rest[0, 0], rest[:0]
    if rest is not None and len(rest) > 1:
        yield "short", rest, np.array([0, len(rest)])


def all_pairs(rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both sides of all pairs within the short runs, in portions."""
    size = np.diff(starts)
    for s in np.unique(size):
        i, j = np.triu_indices(int(s), 1)
        of = starts[:-1][size == s]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(of), step):
            g = of[k : k + step, None]
            yield rows[(g + i).ravel()], rows[(g + j).ravel()]


def table_of(batch, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)])
