"""Written tables as cuts in the lineage: what many steps stand on is computed once, and a lost executor cannot undo it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where none is set and there is no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-stage-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: for frames of bars and zones, which are small next to the ticks."""
    path = f"{shared_dir(df.sparkSession)}/bars/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
