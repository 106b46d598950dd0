"""Micro-batch windows over a source that grows: by count, sliding, by processing time, by cursor; with persisted state.

State is a small JSON file (offset, cursor, last run, last batch's bounds), replaced atomically and saved
after a batch's steps have run, so a crash repeats a batch rather than losing it.
Rows are addressed by their number in the source, so no buffer of rows is kept.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import ORD, Table


def seconds(text: str | float) -> float:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(ms|s|min|m|h|d)", str(text).strip())
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return float(m[1]) * {"ms": 0.001, "s": 1, "min": 60, "m": 60, "h": 3600, "d": 86400}[m[2]]


@dataclass
class State:
    offset: int = 0
    cursor: object = None
    last_run: float | None = None


class Store:
    """path None keeps the state in memory."""

    def __init__(self, path: str | None = None):
        self.path, self.memory = path, {}

    def load(self, pipeline: str) -> State:
        d = self.memory
        if self.path and os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                d = json.load(f)
        x = d.get(pipeline, {})
        return State(x) if isinstance(x, int) else State(**x)

    def save(self, pipeline: str, state: State) -> None:
        d = self.memory
        if self.path and os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                d = json.load(f)
        d[pipeline] = asdict(state)
        if self.path:
            with open(self.path + ".tmp", "w", encoding="utf-8") as f:
                json.dump(d, f)
            os.replace(self.path + ".tmp", self.path)


class Window:
    """size: rows, or a duration text. overlap: rows of a batch that the next one gets again. cursor: a column whose
    values only grow; backfill: (from, to) of it, inclusive, delivered once without moving the cursor."""

    def __init__(self, name: str, read: Callable[[], DataFrame], size: int | str | None = None, overlap: int = 0, cursor: str | None = None, backfill: tuple | None = None, store: Store | None = None, clock: Callable[[], float] = time.time):
        if isinstance(size, int) and not 0 <= overlap < size:
            raise ValueError("0 <= overlap < size")
        self.name, self.read, self.size, self.overlap, self.cursor, self.backfill = name, read, size, overlap, cursor, backfill
        self.store, self.clock = store or Store(), clock
        self.filled = False

    def tick(self, steps: Callable[[Table], object]) -> bool:
        """One turn: runs steps on a batch if a window is full or due."""
        s = self.store.load(self.name)
        now = self.clock()
        if isinstance(self.size, str) and s.last_run is not None and now - s.last_run < seconds(self.size):
            return False
        df = self.read()
        if self.cursor:
            return self._by_cursor(df, s, now, steps)
        n = df.count()
        s.offset = min(s.offset, n)  # the source may have shrunk
        size = self.size if isinstance(self.size, int) else n - s.offset
        if not size or n - s.offset < size:
            return False
        rows = Table(df)._numbered().where((F.col(ORD) >= s.offset) & (F.col(ORD) < s.offset + size)).orderBy(ORD).drop(ORD)
        steps(Table(rows))
        s.offset += size - (self.overlap if isinstance(self.size, int) else 0)
        s.last_run = now
        self.store.save(self.name, s)
        return True

    def _by_cursor(self, df: DataFrame, s: State, now: float, steps) -> bool:
        c = F.col(f"`{self.cursor}`")
        if not df.where(c.isNull()).isEmpty():
            raise ValueError(f"the cursor {self.cursor} has nulls")
        if self.backfill and not self.filled:
            self.filled = True
            steps(Table(df.where(c.between(*self.backfill)).orderBy(c)))
            return True
        new = df.where(c > F.lit(s.cursor)) if s.cursor is not None else df
        if isinstance(self.size, int):
            new = new.orderBy(c).limit(self.size)
            if new.count() < self.size:
                return False
        last = new.agg(F.max(c)).first()[0]
        if last is None:
            return False
        steps(Table(new.orderBy(c)))
        s.cursor, s.last_run = last, now
        self.store.save(self.name, s)
        return True


def numbered_windows(df: DataFrame, order: str, size: int, overlap: int = 0) -> DataFrame:
    """The batch form: each row with the numbers of the full windows that it is in (column `window`)."""
    step = size - overlap
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    d = Table(df.orderBy(order))._numbered()
    n = d.count()
    full = max(0, (n - size) // step + 1) if n >= size else 0
    first = F.greatest(F.ceil((F.col(ORD) - size + 1) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col(ORD) / step), F.lit(full - 1)).cast("long")
    return d.where(first <= last).withColumn("window", F.explode(F.sequence(first, last))).drop(ORD)


def event_windows(df: DataFrame, time_column: str, size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Rows with their event-time windows, for batch and for streams (with a watermark)."""
    d = df.withWatermark(time_column, late) if late else df
    return d.withColumn("window", F.window(time_column, size, slide) if slide else F.window(time_column, size))
