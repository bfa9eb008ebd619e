"""Series cut into ranges of time, so that no task holds more than its share of all rows.

Bars are dealt once by range of (symbol, ts) and kept in the shared checkpoint folder. A ranged frame is such a table whose symbol is
a struct of range and symbol: everything that works by symbol then works by piece of a series, on as many tasks as there are
ranges. A series that lies in one range as a whole has range -1. What reaches beyond a piece is handed over in one of three ways:

- windows of bounded length see the rows around their piece as copies (``with_halo``),
- what depends on all rows before is told by each piece in a row and summed up over the pieces before (``before_each``),
- recursive means chain such summaries (``ewm.recursive_means`` knows ranged frames).

``_at`` numbers rows in order of (symbol, ts). There are at most two pieces for each range that go on elsewhere, so tables of
pieces stay as small as the number of ranges, whatever the number of rows and symbols.

A dealt frame is the leaner form for what streams through a range in order: rows are shuffled once, nothing is kept besides, and
``_range`` numbers the partitions. Each pass sorts again what it reads from the shuffle's files (see ``directional``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import kept, shuffled_once

AT, HALO, RANGE = "_at", "_halo", "_range"


def is_ranged(df: DataFrame, symbol: str = "symbol") -> bool:
    kind = df.schema[symbol].dataType
    return isinstance(kind, T.StructType) and kind.names == ["range", "symbol"] and AT in df.columns


def in_ranges(df: DataFrame, blocks: int, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df as a ranged frame of about ``blocks`` ranges; rows with equal (symbol, ts) stay in one range."""
    dealt = df.repartitionByRange(blocks, symbol, ts).sortWithinPartitions(symbol, ts)
    dealt = kept(dealt.withColumns({AT: F.monotonically_increasing_id(), "_range": F.spark_partition_id()}))
    meets = dealt.groupBy(symbol).agg(F.min("_range").alias("a"), F.max("_range").alias("b")).where("a < b")
    cut = [r[symbol] for r in meets.select(symbol).collect()]  # at most one for each range
    number = F.when(F.col(symbol).isin([s for s in cut if s is not None]) | (F.col(symbol).isNull() & F.lit(None in cut)), F.col("_range")).otherwise(-1)
    return dealt.withColumn(symbol, F.struct(number.cast("int").alias("range"), F.col(symbol).alias("symbol"))).drop("_range")


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return _sortable(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.BinaryType, T.DatetimeType))


def dealt(df: DataFrame, blocks: int, by: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """df as a dealt frame: about ``blocks`` ranges of the order ``by``, each a sorted partition with its number in ``_range``.

    Rows that tie are told apart by their other columns, so that all passes see them in one order. Columns may be added and left
    out afterwards; partitions must stay as they are. Plain columns that differ early in ``by`` sort much faster than structs.
    """
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in by and _sortable(f.dataType)]
    frame = df.repartitionByRange(blocks, *by).withColumn(RANGE, F.spark_partition_id())
    return shuffled_once(frame.sortWithinPartitions(*by, *others))


def whole(frame: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The frame's own rows, by plain symbol."""
    own = frame.where(f"not {HALO}") if HALO in frame.columns else frame
    return own.drop(AT, HALO).withColumn(symbol, F.col(f"{symbol}.symbol"))


def _pieces(frame: DataFrame, symbol: str) -> dict[object, list[tuple[int, int, int]]]:
    """By symbol that lies in several ranges: number, first and last ``_at`` of each piece, in order."""
    ends = frame.where(F.col(f"{symbol}.range") >= 0).groupBy(symbol).agg(F.min(AT).alias("a"), F.max(AT).alias("b")).collect()
    found = defaultdict(list)
    for r in ends:
        found[r[symbol]["symbol"]].append((r[symbol]["range"], r["a"], r["b"]))
    return {s: sorted(p) for s, p in found.items()}


def _copies(pieces: list[tuple[int, int, int]], back: int, ahead: int) -> list[tuple[int, int, int, int]]:
    """Which rows of a series go where: number of their piece, of the piece that sees them, first and last ``_at``."""
    out = []
    for i, (target, _, _) in enumerate(pieces):
        for others, left, last in ((reversed(pieces[:i]), back, True), (pieces[i + 1 :], ahead, False)):
            for number, a, b in others:
                if left <= 0:
                    break
                n = min(left, b - a + 1)
                out.append((number, target, b - n + 1, b) if last else (number, target, a, a + n - 1))
                left -= n
    return out


def with_halo(frame: DataFrame, back: int = 0, ahead: int = 0, symbol: str = "symbol") -> DataFrame:
    """frame with copies, marked by ``_halo``, of up to ``back`` rows before each piece and ``ahead`` rows after it.

    frame is read twice: let it be kept.
    """
    plan = [((number, s), target, a, b) for s, pieces in _pieces(frame, symbol).items() for number, target, a, b in _copies(pieces, back, ahead)]
    own = frame.withColumn(HALO, F.lit(False))
    if not plan:
        return own
    kind = T.StructType([T.StructField("_key", frame.schema[symbol].dataType), T.StructField("_target", T.IntegerType()), T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType())])
    moves = F.broadcast(frame.sparkSession.createDataFrame(plan, kind))  # a few rows for each range
    met = frame.where(F.col(f"{symbol}.range") >= 0).join(moves, F.col(symbol).eqNullSafe(F.col("_key")) & F.col(AT).between(F.col("_a"), F.col("_b")))
    seen = met.withColumn(symbol, F.struct(F.col("_target").alias("range"), F.col(f"{symbol}.symbol").alias("symbol"))).withColumn(HALO, F.lit(True))
    return own.unionByName(seen.select(*own.columns))


def over_ranges(df: DataFrame, f: Callable[[DataFrame], DataFrame], blocks: int | None, back: int = 0, ahead: int = 0) -> DataFrame:
    """f(df), where f looks at most ``back`` rows back and ``ahead`` rows ahead within a symbol; with blocks, piece by piece.

    Recursive means may follow f's windows, not precede them: they leave no copies behind.
    """
    return f(df) if not blocks else whole(f(with_halo(in_ranges(df, blocks), back, ahead)))


def before_each(frame: DataFrame, told: dict[str, Column], joined: dict[str, Callable[[str, object], Column]], symbol: str = "symbol") -> DataFrame:
    """frame with a column for each of ``joined``: what all pieces of its series before its own have told, null without any.

    told: aggregates of a piece's rows; joined: name -> function of the name and the window of pieces before.
    """
    pieces = frame.where(F.col(f"{symbol}.range") >= 0).groupBy(symbol).agg(*[e.alias(n) for n, e in told.items()])
    before = Window.partitionBy(F.col(f"{symbol}.symbol")).orderBy(F.col(f"{symbol}.range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.select(F.col(symbol).alias("_key"), *[f(n, before).alias(n) for n, f in joined.items()])
    return frame.join(F.broadcast(sums), F.col(symbol).eqNullSafe(F.col("_key")), "left").drop("_key")
