"""Steps whose result is stored: it is computed once, and a lost executor costs no more than the step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); a temporary one only where one machine does all."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-stored-")
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cairn/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
