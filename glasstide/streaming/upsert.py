"""Bars that arrive as a stream are put into the stored bars batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..sources.bars import merge_bars, normalize_bars, read_bars
from ..sources.versions import upsert_months


def upsert_batch(spark: SparkSession, path: str, swap: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merged bars go to path + "_<batch>", then swap(new, old) puts them in the old one's place.

    A batch that is repeated after a failure gives the same bars again, since an upsert is idempotent.
    """

    def put(batch: DataFrame, number: int) -> None:
        new = f"{path}_{number}"
        merge_bars(read_bars(spark, path), normalize_bars(batch)).write.mode("overwrite").parquet(new)
        swap(new, path)

    return put


def stream_into(bars: DataFrame, path: str, checkpoint: str, swap: Callable[[str, str], None]) -> DataStreamWriter:
    """A writer that upserts a stream of raw bars into the bars stored at path; the caller starts it."""
    return bars.writeStream.foreachBatch(upsert_batch(bars.sparkSession, path, swap)).option("checkpointLocation", checkpoint)


def stream_into_months(bars: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that upserts a stream of raw bars into bars stored by month; a batch rewrites the months it touches, once."""
    spark = bars.sparkSession
    return bars.writeStream.foreachBatch(lambda df, n: upsert_months(spark, folder, normalize_bars(df), f"{checkpoint}:{n}") and None).option("checkpointLocation", checkpoint)
