"""Several pieces of work on one session at a time, each in a fair scheduler pool of its own."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Outcome:
    """What a piece of work returned, or the error that ended it, and when it ran."""

    value: Any
    error: Exception | None
    began: float
    ended: float


def run_jobs(spark: SparkSession, work: Mapping[str, Callable[[], Any]], workers: int) -> dict[str, Outcome]:
    """The outcomes by name, in the given order; at most workers run at a time. One that fails doesn't stop the others.

    A piece's Spark jobs go to the pool of its name (with spark.scheduler.mode=FAIR pools share the executors evenly) and
    carry its name as description. Each thread has properties of its own, so nothing leaks into the caller's.
    """
    context = spark.sparkContext
    inherited = {k: context.getLocalProperty(k) for k in ("spark.job.tags", "spark.jobGroup.id")}

    def one(name: str) -> Outcome:
        for key, value in inherited.items():
            if value is not None:
                context.setLocalProperty(key, value)
        context.setLocalProperty("spark.scheduler.pool", name)
        context.setJobDescription(name)
        began = time.monotonic()
        try:
            return Outcome(work[name](), None, began, time.monotonic())
        except Exception as e:
            return Outcome(None, e, began, time.monotonic())
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            context.setJobDescription(None)

    with ThreadPoolExecutor(max_workers=max(1, workers), thread_name_prefix="cairn") as threads:
        return dict(zip(work, threads.map(one, work)))
