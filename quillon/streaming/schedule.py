"""Cron schedules and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from datetime import datetime, timedelta

FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _field(text: str, lo: int, hi: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (lo, hi) if span == "*" else (int(a), int(b or a))
        if not lo <= first <= last <= hi or (step and int(step) < 1):
            raise ValueError(f"cron field {text!r}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def parse(cron: str) -> list[set[int]]:
    parts = cron.split()
    if len(parts) != 5:
        raise ValueError(f"five fields are needed: {cron!r}")
    sets = [_field(p, *f) for p, f in zip(parts, FIELDS, strict=True)]
    sets[4] = {d % 7 for d in sets[4]}
    return sets


def following(cron: str, after: datetime) -> datetime:
    """The first minute after `after` that all five fields allow (day of month and of week both), within 366 days."""
    minute, hour, day, month, weekday = parse(cron)
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = after + timedelta(days=366)
    while t <= end:
        if t.month not in month or t.day not in day or t.isoweekday() % 7 not in weekday:
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        elif t.hour not in hour:
            t = t.replace(minute=0) + timedelta(hours=1)
        elif t.minute not in minute:
            t += timedelta(minutes=1)
        else:
            return t
    raise ValueError(f"{cron!r} never comes")


def retry(run: Callable[[], object], times: int = 0, wait: float = 0.0, backoff: float = 1.0, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Runs again after a failure, up to `times` more; waits wait * backoff ** k and a jitter, 300 s at most."""
    for k in range(times + 1):
        try:
            return run()
        except Exception:
            if k == times:
                raise
            sleep(min(300.0, wait * backoff**k + random.uniform(0, jitter)))
