"""Recursive exponential means of many series in one pass.

Bars are partitioned by symbol, sorted, and streamed through Arrow batches. Of a symbol only the running means travel from
batch to batch, so neither a long series nor many symbols have to fit in memory. On a ranged frame (see ``ranges``), where a long
series lies in pieces on many tasks, a mean is affine in the mean before its piece: pieces are summed up side by side, a few numbers
for each are chained, and every piece starts from what the chain hands it.

Contract: the first non-null value seeds the mean, leading nulls stay null. A null leaves the mean as it was, and the next
value meets the old weight (1 - alpha)^g against alpha, where g is the number of rows since the last value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import HALO, in_ranges, is_ranged, whole
from .storage import kept


@dataclass(frozen=True)
class Mean:
    """One recursive mean: of column source, with weight alpha for the newest value, into column name."""

    source: str
    alpha: float
    name: str


def span(length: int) -> float:
    return 2.0 / (length + 1)


def wilder(length: int) -> float:
    return 1.0 / length


def continue_mean(values: np.ndarray, alpha: float, last: float, gap: int) -> tuple[np.ndarray, float, int]:
    """Means of values (NaN: missing) after a series that stood at last, gap rows since its last value; NaN last: not begun."""
    ahead = np.concatenate([[last], np.full(gap, np.nan)]) if not np.isnan(last) else np.zeros(0)
    means = pd.Series(np.concatenate([ahead, values])).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()[len(ahead) :]
    seen = np.flatnonzero(~np.isnan(values))
    if len(seen):
        gap = len(values) - 1 - int(seen[-1])
    elif not np.isnan(last):
        gap += len(values)
    return means, float(means[-1]) if len(means) else last, gap


def _segments(keys: pa.Array) -> list[tuple[int, int]]:
    """Stretches of equal keys, from dictionary codes; nulls are equal. A struct changes where one of its fields does."""
    new = np.zeros(max(0, len(keys) - 1), bool)
    for part in keys.flatten() if pa.types.is_struct(keys.type) else [keys]:
        codes = part.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]
    return list(zip(edges[:-1], edges[1:]))


def _own(keys: pa.Array, at: int) -> object:
    """A key as something that can be looked up: a struct as the tuple of its fields."""
    key = keys[at].as_py()
    return tuple(key.values()) if isinstance(key, dict) else key


State = list[tuple[float, int]]


def _streamed(batches: Iterator[pa.RecordBatch], means: list[Mean], key: int, starts: dict[object, State] | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with their means; starts: the state in which a piece of a series begins, where that is not afresh."""
    fresh: State = [(float("nan"), 0)] * len(means)
    current, state = object(), fresh
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.schema.get_field_index(m.source) for m in means]
        values = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at]
        out = [np.empty(batch.num_rows) for _ in means]
        for a, b in _segments(batch.column(key)):
            own = _own(batch.column(key), a)
            if own != current:
                current, state = own, list((starts or {}).get(own, fresh))
            for k, m in enumerate(means):
                out[k][a:b], *new = continue_mean(values[k][a:b], m.alpha, *state[k])
                state = [*state[:k], tuple(new), *state[k + 1 :]]
        yield batch, out


def _with_means(batch: pa.RecordBatch, out: list[np.ndarray], means: list[Mean]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, from_pandas=True) for o in out)], names=[*batch.schema.names, *(m.name for m in means)])


def _widened(df: DataFrame, means: list[Mean]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(m.name, T.DoubleType()) for m in means)])


class _Summary:
    """How a range changes a mean that comes in: the first value's place and size, then mean -> decay * mean + offset, and rows since the last value."""

    def __init__(self, alpha: float):
        self.alpha, self.rows, self.place, self.value = alpha, 0, -1, 0.0
        self.ends: list[tuple[float, int]] = [(0.0, 0), (1.0, 0)]  # what means of 0 and 1 after the first value become

    def add(self, values: np.ndarray) -> None:
        seen = np.flatnonzero(~np.isnan(values)) if self.place < 0 else None
        if seen is not None and len(seen):
            self.place, self.value = self.rows + int(seen[0]), float(values[seen[0]])
            rest = values[seen[0] + 1 :]
        else:
            rest = values if seen is None else values[:0]
        self.ends = [continue_mean(rest, self.alpha, *e)[1:] for e in self.ends]
        self.rows += len(values)

    def told(self) -> list[float]:
        (low, gap), (high, _) = self.ends
        return [float(self.rows), float(self.place), self.value, high - low, low, float(gap)]

    @staticmethod
    def carried(alpha: float, told: list[float], last: float, gap: int) -> tuple[float, int]:
        """The state after the range, from the one before it."""
        rows, place, value, decay, offset, after = told
        if place < 0:
            return (last, gap + int(rows)) if not np.isnan(last) else (last, 0)
        mean, _, _ = continue_mean(np.concatenate([np.full(int(place), np.nan), [value]]), alpha, last, gap)
        return decay * float(mean[-1]) + offset, int(after)


def recursive_means(df: DataFrame, means: list[Mean], symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with one double column per Mean, computed along ts within each symbol. Ties in ts are taken in any order.

    On a ranged frame copies of other pieces' rows (see ``ranges.with_halo``) are left out, and so is their mark.
    """
    key = df.columns.index(symbol)
    starts: dict[object, State] | None = None
    if is_ranged(df, symbol):
        df = (df.where(f"not {HALO}").drop(HALO) if HALO in df.columns else df).repartition(symbol).sortWithinPartitions(symbol, ts)
        df = kept(df)  # read twice
        starts = _chained(df, means, symbol)
    else:
        df = df.repartition(symbol).sortWithinPartitions(symbol, ts)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _streamed(batches, means, key, starts):
            yield _with_means(batch, out, means)

    return df.mapInArrow(streamed, _widened(df, means))


def _chained(frame: DataFrame, means: list[Mean], symbol: str) -> dict[object, State]:
    """The state in which each piece of a cut series begins: the driver gets a few numbers for each piece and chains them."""
    sources = list(dict.fromkeys(m.source for m in means))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, []

        def told(keys: pa.DataType) -> Iterator[pa.RecordBatch]:
            if current is not None:
                numbers = pa.array([[x for s in sums for x in s.told()]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([current[1]], keys), numbers], names=["range", "own", "told"])

        for batch in batches:
            for a, b in _segments(batch.column(0)) if batch.num_rows else ():
                own = _own(batch.column(0), a)
                if own != current:
                    yield from told(batch.schema.field(0).type.field(1).type)
                    current, sums = own, [_Summary(m.alpha) for m in means]
                for m, s in zip(means, sums):
                    s.add(batch.column(1 + sources.index(m.source))[a:b].cast(pa.float64()).to_numpy(zero_copy_only=False))
        if current is not None:
            yield from told(batch.schema.field(0).type.field(1).type)

    kind = frame.schema[symbol].dataType["symbol"].dataType.simpleString()
    pieces = frame.where(F.col(f"{symbol}.range") >= 0).select(symbol, *sources)
    rows = pieces.mapInArrow(summed, f"range int, own {kind}, told array<double>").collect()  # two for each range at most
    starts: dict[object, State] = {}
    states: dict[object, State] = {}
    for r in sorted(rows, key=lambda r: r["range"]):
        before = states.get(r["own"], [(float("nan"), 0)] * len(means))
        starts[(r["range"], r["own"])] = before
        states[r["own"]] = [_Summary.carried(m.alpha, r["told"][6 * k : 6 * k + 6], *before[k]) for k, m in enumerate(means)]
    return starts


def blocked_means(df: DataFrame, means: list[Mean], symbol: str = "symbol", ts: str = "ts", blocks: int | None = None) -> DataFrame:
    """As recursive_means, with every series cut into ranges of ts, so that no task holds more than its share of all rows."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole(recursive_means(in_ranges(df, n, symbol, ts), means, symbol, ts), symbol)


def gap_of(name: str) -> str:
    """The column that holds, beside a mean, how many rows ago its last value came."""
    return f"_gap_{name}"


def continued_means(df: DataFrame, means: list[Mean], symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with the means of its new rows, continued from rows that have theirs already.

    df holds for each Mean a column of its name and one called gap_of(name). Rows marked by ``_halo`` come first in their symbol and
    hold both from an earlier time; the other rows get theirs. A symbol without marked rows begins afresh.
    """
    key, marked = df.columns.index(symbol), df.columns.index(HALO)
    columns = [c for m in means for c in (m.name, gap_of(m.name))]
    places = [df.columns.index(c) for c in columns]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: State = [(float("nan"), 0)] * len(means)
        current, state = object(), fresh
        for batch in batches:
            if not batch.num_rows:
                continue
            halo = batch.column(marked).to_numpy(zero_copy_only=False).astype(bool)
            values = [batch.column(batch.schema.get_field_index(m.source)).cast(pa.float64()).to_numpy(zero_copy_only=False) for m in means]
            out = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).copy() for i in places]
            for a, b in _segments(batch.column(key)):
                own = _own(batch.column(key), a)
                if own != current:
                    current, state = own, list(fresh)
                first = a + int(halo[a:b].sum())
                for k, m in enumerate(means):
                    means_of, gaps = out[2 * k], out[2 * k + 1]
                    if first > a:
                        state[k] = (means_of[first - 1], int(gaps[first - 1]))
                    last, gap = state[k]
                    seen = ~np.isnan(values[k][first:b])
                    at = np.arange(b - first)
                    since = np.maximum.accumulate(np.where(seen, at, -1)) if b > first else at
                    begun = 0 if np.isnan(last) else gap + 1
                    gaps[first:b] = np.where(since >= 0, at - since, begun + at if begun else 0)
                    means_of[first:b], *new = continue_mean(values[k][first:b], m.alpha, last, gap)
                    state[k] = tuple(new)
            arrays = list(batch.columns)
            for i, o in zip(places, out):
                arrays[i] = pa.array(o, from_pandas=True)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema.fields])
    return df.repartition(symbol).sortWithinPartitions(symbol, ts).mapInArrow(streamed, schema)
