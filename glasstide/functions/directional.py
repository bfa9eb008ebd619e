"""Directional means of a dealt frame (see ``ranges``): true ranges, moves and their index in three passes, without another shuffle.

Of each piece of a series the driver gets a few numbers, twice: how it changes the means of true range and moves, then, with these
known, how it changes the index's mean. A piece's first row looks back on the last row of the piece before, so the driver enters it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ewm import State, _own, _segments, _Summary, continue_mean
from .ranges import RANGE

PRICES = ("high", "low", "close")
MEANS = ("tr_mean", "plus_mean", "minus_mean")
FRESH: State = [(float("nan"), 0)] * len(MEANS)
Row = tuple[object, ...]


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _finite(values: np.ndarray) -> np.ndarray:
    """values with NaN for infinite ones, which means take for missing."""
    return np.where(np.isfinite(values), values, np.nan)


def _more(a: pa.Array, b: pa.Array | pa.Scalar) -> np.ndarray:
    """a > b as Spark has it: NaN is more than any number, null is not."""
    found = pc.fill_null(pc.greater(a, b), False)
    if pa.types.is_floating(a.type):
        found = pc.or_(found, pc.fill_null(pc.and_(pc.is_nan(a), pc.invert(pc.is_nan(b))), False))
    return found.to_numpy(zero_copy_only=False)


def moves(high: pa.Array, low: pa.Array, close: pa.Array, before: Row) -> list[np.ndarray]:
    """true_range, plus_dm and minus_dm, as ``operators.indicators`` has them (NaN: missing); before: high, low and close of the row before."""
    high, low, close = (x.cast(pa.decimal256(57, x.type.scale)) if pa.types.is_decimal(x.type) else x for x in (high, low, close))  # room for differences
    h, l, c = (pa.concat_arrays([pa.array([v], x.type), x.slice(0, len(x) - 1)]) for x, v in zip((high, low, close), before))
    wide = [pc.subtract(high, low), pc.abs(pc.subtract(high, c)), pc.abs(pc.subtract(low, c))]
    true_range = np.fmax.reduce([_floats(w) for w in wide])
    for w in wide:
        if pa.types.is_floating(w.type):  # NaN is the greatest of all, null is left out
            true_range[pc.fill_null(pc.is_nan(w), False).to_numpy(zero_copy_only=False)] = np.nan
    up, down = pc.subtract(high, h), pc.subtract(l, low)
    zero = pa.scalar(0).cast(up.type)
    plus, minus = (np.where(_more(a, b) & _more(a, zero), _floats(a), 0.0) for a, b in ((up, down), (down, up)))
    return [_finite(true_range), _finite(plus), _finite(minus)]


def _dx(tr: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """dx of ``operators.indicators.with_dx``."""
    with np.errstate(all="ignore"):
        base = np.where(tr == 0, np.nan, tr)
        plus_di, minus_di = 100 * (plus / base), 100 * (minus / base)
        total = plus_di + minus_di
        return _finite(100 * (np.abs(plus_di - minus_di) / np.where(total == 0, np.nan, total)))


def _stretches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, object, list[pa.Array]]]]]:
    """Batches with their stretches of one piece: from, to, its key, prices. names: of range, symbol and prices."""
    for batch in batches:
        if batch.num_rows:
            number, keys, *prices = (batch.column(batch.schema.get_field_index(n)) for n in names)
            at = number[0].as_py()
            yield batch, [(a, b, (at, _own(keys, a)), [p.slice(a, b - a) for p in prices]) for a, b in _segments(keys)]


def _with_dx(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], alpha: float, starts: dict[object, tuple[Row, State]]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, object]], np.ndarray]]:
    """Batches with their stretches and, as rows of an array, MEANS and dx; starts: of the pieces that go on."""
    current, before, state = None, (), []
    for batch, stretches in _stretches(batches, names):
        out = np.empty((len(MEANS) + 1, batch.num_rows))
        for a, b, own, prices in stretches:
            if own != current:
                current, (before, state) = own, starts.get(own, ((None,) * len(PRICES), FRESH))
            new = [continue_mean(values, alpha, *s) for values, s in zip(moves(*prices, before), state)]
            out[:-1, a:b] = [means for means, _, _ in new]
            before, state = tuple(p[-1].as_py() for p in prices), [(last, gap) for _, last, gap in new]
        out[-1] = _dx(*out[:-1])
        yield batch, [s[:3] for s in stretches], out


def _told(pieces: Iterator[tuple[object, list[pa.Array], list[_Summary]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for the first and the last of a range's pieces; those between lie in it as a whole."""
    ends = []
    for piece in pieces:
        ends = [*ends[:1], piece]
    for columns, sums in ends:
        yield pa.RecordBatch.from_arrays([*columns, pa.array([[x for s in sums for x in s.told()]], pa.list_(pa.float64()))], names=names)


def _moves_told(names: tuple[str, ...], alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each piece the first row's prices, the last row's, and how the rows after the first change MEANS."""

    def pieces(batches: Iterator[pa.RecordBatch]):
        current, first, last, sums = None, [], [], []
        for batch, stretches in _stretches(batches, names):
            for a, b, own, prices in stretches:
                skipped = 0
                if own != current:
                    if current is not None:
                        yield [*first, *last], sums
                    current, sums, skipped = own, [_Summary(alpha) for _ in MEANS], 1
                    first = [batch.column(batch.schema.get_field_index(n)).slice(a, 1) for n in names]
                    before = (None,) * len(PRICES)
                else:
                    before = tuple(p[0].as_py() for p in last)
                for s, values in zip(sums, moves(*prices, before)):
                    s.add(values[skipped:])
                last = [p.slice(len(p) - 1, 1) for p in prices]
        if current is not None:
            yield [*first, *last], sums

    return lambda batches: _told(pieces(batches), ["range", "own", *(f"first_{p}" for p in PRICES), *(f"last_{p}" for p in PRICES), "told"])


def _dx_told(names: tuple[str, ...], alpha: float, starts: dict[object, tuple[Row, State]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each piece how it changes the mean of dx."""

    def pieces(batches: Iterator[pa.RecordBatch]):
        current, first, summary = None, [], _Summary(alpha)
        for batch, stretches, out in _with_dx(batches, names, alpha, starts):
            for a, b, own in stretches:
                if own != current:
                    if current is not None:
                        yield first, [summary]
                    current, summary = own, _Summary(alpha)
                    first = [batch.column(batch.schema.get_field_index(n)).slice(a, 1) for n in names[:2]]
                summary.add(out[-1, a:b])
        if current is not None:
            yield first, [summary]

    return lambda batches: _told(pieces(batches), ["range", "own", "told"])


def directional_means(frame: DataFrame, alpha: float, symbol: str = "symbol") -> DataFrame:
    """A dealt frame with its MEANS and adx, all of weight alpha."""
    names = (RANGE, symbol, *PRICES)
    kinds = {n: frame.schema[n].dataType for n in names}
    shown = frame.select(*names)  # what the first two passes need
    keys, numbers = [T.StructField("range", kinds[RANGE]), T.StructField("own", kinds[symbol])], T.StructField("told", T.ArrayType(T.DoubleType()))
    ends = [T.StructField(f"{end}_{p}", kinds[p]) for end in ("first", "last") for p in PRICES]

    starts: dict[object, tuple[Row, State]] = {}
    reached: dict[object, tuple[Row, State]] = {}
    rows = shown.mapInArrow(_moves_told(names, alpha), T.StructType([*keys, *ends, numbers])).collect()  # two for each range at most
    for r in sorted(rows, key=lambda r: r["range"]):
        own = r["own"]
        if own in reached:
            starts[(r["range"], own)] = reached[own]
        before, state = reached.get(own, ((None,) * len(PRICES), FRESH))
        entered = moves(*(pa.array([r[f"first_{p}"]], to_arrow_type(kinds[p])) for p in PRICES), before)
        state = [continue_mean(values, alpha, *s)[1:] for values, s in zip(entered, state)]
        state = [_Summary.carried(alpha, r["told"][6 * k : 6 * k + 6], *s) for k, s in enumerate(state)]
        reached[own] = (tuple(r[f"last_{p}"] for p in PRICES), state)

    adx_starts: dict[object, tuple[float, int]] = {}
    adx_reached: dict[object, tuple[float, int]] = {}
    rows = shown.mapInArrow(_dx_told(names, alpha, starts), T.StructType([*keys, numbers])).collect()
    for r in sorted(rows, key=lambda r: r["range"]):
        state = adx_starts[(r["range"], r["own"])] = adx_reached.get(r["own"], FRESH[0])
        adx_reached[r["own"]] = _Summary.carried(alpha, r["told"], *state)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, FRESH[0]
        for batch, stretches, out in _with_dx(batches, names, alpha, starts):
            for a, b, own in stretches:
                if own != current:
                    current, state = own, adx_starts.get(own, FRESH[0])
                out[-1, a:b], *state = continue_mean(out[-1, a:b], alpha, *state)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, from_pandas=True) for o in out)], names=[*batch.schema.names, *MEANS, "adx"])

    return frame.mapInArrow(streamed, T.StructType([*frame.schema.fields, *(T.StructField(n, T.DoubleType()) for n in (*MEANS, "adx"))]))
