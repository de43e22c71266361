"""Stage checkpoints: each stage's table is written once under a fingerprint of the run's parameters, and read on resume."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def fingerprint(parameters: Mapping) -> str:
    return hashlib.sha1(json.dumps(dict(parameters), sort_keys=True, default=str).encode()).hexdigest()[:12]


class Store:
    """Stages of one run in <folder>/<kind>_<name>_<fingerprint>/<stage>.parquet, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, name: str, parameters: Mapping, resume: bool = False) -> None:
        self.spark, self.resume = spark, resume
        self.folder = f"{folder.rstrip('/')}/{kind}_{name}_{fingerprint(parameters)}"

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}.parquet"

    def exists(self, stage: str) -> bool:
        """Whether the stage was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(stage)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def get(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not (self.resume and self.exists(stage)):
            make().write.mode("overwrite").parquet(self.path(stage))
        return self.spark.read.parquet(self.path(stage))
