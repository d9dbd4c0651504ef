"""Tables written between the parts of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: its plan runs once, and survives lost executors.

    What lies in that folder is scratch; like checkpoints it is kept until whoever runs the cluster clears it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/slotforge-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
