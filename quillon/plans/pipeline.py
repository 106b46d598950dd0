"""Pipelines: a source, steps in order, callbacks, retries and a time limit."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators.table import Table
from ..streaming.schedule import retry


@dataclass
class Pipeline:
    name: str
    source: Callable[[SparkSession], Table]
    steps: list[Callable[[Table], Table]] = field(default_factory=list)
    on_success: Callable[[Table], object] | None = None
    on_failure: Callable[[Exception], object] | None = None
    retries: int = 0
    wait: float = 0.0
    backoff: float = 1.0
    time_limit: float | None = None
    log: Callable[[str], object] | None = None

    def step(self, f: Callable[[Table], Table]) -> Pipeline:
        self.steps.append(f)
        return self

    def run(self, spark: SparkSession, action: Callable[[Table], object] | None = None) -> object:
        """Builds the plan from the steps and runs action on its result (the table itself if there is none)."""
        began = time.time()
        group = f"{self.name}-{uuid.uuid4().hex[:8]}"

        def once() -> object:
            t = self.source(spark)
            for s in self.steps:
                t = s(t)
            return action(t) if action else t

        timer = None
        if self.time_limit:
            import threading

            spark.sparkContext.setJobGroup(group, self.name, interruptOnCancel=True)
            timer = threading.Timer(self.time_limit, lambda: spark.sparkContext.cancelJobGroup(group))
            timer.start()
        try:
            out = retry(once, self.retries, self.wait, self.backoff)
        except Exception as e:
            if self.on_failure:
                self.on_failure(e)
            self._say("failed", began, error=str(e)[:200])
            raise
        finally:
            if timer:
                timer.cancel()
        if self.on_success:
            self.on_success(out)
        self._say("done", began)
        return out

    def _say(self, status: str, began: float, **more: object) -> None:
        if self.log:
            self.log(json.dumps({"pipeline": self.name, "status": status, "seconds": round(time.time() - began, 3), **more}))
