"""Intermediate rows that several later steps read, written once to the shared folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare_folder(spark: SparkSession) -> None:
    """Uses the folder of `spark.checkpoint.dir`; only a session without executors of its own may do without and gets a new local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from the shared folder from here on; a lost executor costs no recomputation."""
    prepare_folder(df.sparkSession)
    return df.checkpoint()
