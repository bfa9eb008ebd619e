"""Results that are computed once: kept in the folder that all executors share, or read again from the files of their shuffles."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without one, only a local session gets a folder of its own, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, with its partitions as they are; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffled_once(df: DataFrame) -> DataFrame:
    """df, whose shuffles run now: later jobs read their files and do again only what stands above them, such as a sort.

    Nothing is written besides. What is lost with an executor is computed again, so rows that a sort leaves tied may come in another order.
    """
    session = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), session)
