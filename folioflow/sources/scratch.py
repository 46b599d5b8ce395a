"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: what follows may use it several times, and lost executors lose nothing. Where
    that is unset, a new temporary folder in local mode (tests), and an error on a cluster, whose executors would each write to a disk of their own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/notes-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
