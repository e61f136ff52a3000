"""Rows kept where all machines can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def durable_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where a local session has none (tests), a
    temporary one is set; on a cluster that is an error, as no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or spark._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Compute df now and cut its lineage, by a checkpoint in the shared folder."""
    durable_folder(df.sparkSession)
    return df.checkpoint(eager=True)
