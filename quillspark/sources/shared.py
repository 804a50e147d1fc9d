"""The folder that all machines of a session share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a folder of its own machine; on
    a cluster, whose machines share no such folder, ValueError is raised.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "quillspark-checkpoints")
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder now, so that what reads it several times doesn't work it out again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
