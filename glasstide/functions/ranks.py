"""Trailing ranks: where each value stands among the last ones of its series.

Rows are partitioned by symbol, sorted, and streamed through Arrow batches, as recursive means are. Between batches only the last
values of the running symbol are held; inside one they pass through pandas' rolling rank, which keeps its window in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ewm import _own, _segments


def _rank_share(values: np.ndarray, window: int, least: int, before: np.ndarray) -> np.ndarray:
    """Rank shares of values (NaN: missing), which come after the values before."""
    joined = np.nan_to_num(np.concatenate([before, values]), nan=np.nan, posinf=np.finfo(float).max, neginf=np.finfo(float).min)
    return pd.Series(joined).rolling(window, min_periods=least).rank(pct=True).to_numpy()[len(before) :]


def trailing_ranks(df: DataFrame, col: str, window: int, least: int, name: str, skip_nulls: bool = False, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with column name: the rank of col among the non-null values of its symbol's last ``window`` rows, ties averaged, divided by their
    number; null where col is null or fewer than ``least`` values are not. skip_nulls: of its last ``window`` non-null values instead.
    """
    at, key = df.columns.index(col), df.columns.index(symbol)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = object(), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = np.full(len(values), np.nan)
            for a, b in _segments(batch.column(key)):
                own = _own(batch.column(key), a)
                if own != current:
                    current, before = own, np.zeros(0)
                place = a + np.flatnonzero(~np.isnan(values[a:b])) if skip_nulls else np.arange(a, b)
                out[place] = _rank_share(values[place], window, least, before)
                before = np.concatenate([before, values[place]])[-(window - 1) :] if window > 1 else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=[*batch.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.repartition(symbol).sortWithinPartitions(symbol, ts).mapInArrow(ranked, schema)
