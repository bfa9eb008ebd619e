"""Bars in, reports out."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Universe
from ..schema import BARS, PRICES

#: Names that a closing price may go by, best first.
CLOSE_NAMES = ("close", "Close", "CLOSE", "adj close", "Adj Close")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars of all symbols: one Parquet dataset with symbol as a column."""
    return spark.read.schema(BARS).parquet(path)


def close_column(df: DataFrame):
    """The first of CLOSE_NAMES that df has, as column close; null if it has none."""
    found = next((c for c in CLOSE_NAMES if c in df.columns), None)
    return (F.col(f"`{found}`") if found else F.lit(None).cast("double")).cast("double").alias("close")


def _number(df: DataFrame, name: str):
    own = next((c for c in df.columns if c.lower() == name), None)
    value = F.col(f"`{own}`").cast("double") if own else close_column(df) if name == "close" else F.lit(None).cast("double")
    return F.when(~F.isnan(value), value).alias(name)


def wall_time(df: DataFrame, name: str):
    """Column name of df as a timestamp. Text keeps the wall time it shows: an offset or zone behind it is dropped, not converted by."""
    if dict(df.dtypes)[name] != "string":
        return F.col(f"`{name}`").cast("timestamp")
    plain = F.regexp_replace(F.trim(F.col(f"`{name}`")), r"(:\d{2}(?:[.,]\d+)?)\s*(?:[Zz]|UTC|GMT|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$", "$1")
    return F.to_timestamp_ntz(plain).cast("timestamp")


def normalize_bars(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """Clean bars of raw: names in any case, known columns only, NaN as null, one bar per (symbol, ts), none without close.

    Without a close column an adjusted close stands in (see close_column). Times given as text keep their wall time (see wall_time).

    Of bars with one key the last by ``arrival`` stays, before those without close go: a last bar without close removes
    its key. Without arrival any one of them stays.
    """
    lower = {c.lower(): c for c in raw.columns}
    rows = raw.select(F.col(f"`{lower['symbol']}`").cast("string").alias("symbol"), wall_time(raw, lower["ts"]).alias("ts"), *[_number(raw, c) for c in PRICES], (F.col(arrival) if arrival else F.lit(0)).alias("_at"))
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc("_at"))
    kept = rows.where("symbol is not null and ts is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return kept.where("close is not null").select("symbol", "ts", *PRICES)


def merge_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored with incoming bars put in; where both have a (symbol, ts), incoming's stays."""
    both = stored.select("symbol", "ts", *PRICES, F.lit(0).alias("_source")).unionByName(incoming.select("symbol", "ts", *PRICES, F.lit(1).alias("_source")))
    newest = both.groupBy("symbol", "ts").agg(F.max_by(F.struct(*PRICES), "_source").alias("bar"))
    return newest.select("symbol", "ts", "bar.*")


def load_universe(bars: DataFrame, universe: Universe) -> DataFrame:
    """Bars of the universe's symbols. A missing target is an error, any other missing symbol is left out."""
    if bars.where(F.col("symbol") == universe.target).limit(1).count() == 0:
        raise ValueError(f"no bars for the target {universe.target}")
    return bars.where(F.col("symbol").isin(universe.symbols()))


def slice_window(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Bars with start <= ts <= end; what is computed after starts afresh at the window's first bar."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.to_timestamp(F.lit(end)))
    return bars


def history_window(df: DataFrame, bars: DataFrame, target: str, years: int = 5) -> DataFrame:
    """Rows of df from ``years`` calendar years before the target's last bar on; a close column is rounded to 2."""
    as_of = bars.where(F.col("symbol") == target).agg(F.max("ts").alias("as_of")).first()["as_of"]
    kept = df.where(F.col("ts") >= F.lit(as_of) - F.make_interval(years=F.lit(years))) if as_of else df.limit(0)
    return kept.withColumn("close", F.bround("close", 2)) if "close" in df.columns else kept


def _non_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether value holds a NaN or infinite number at any depth; None if its type cannot."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _non_finite(value.getField(f.name), f.dataType)) is not None]
        return reduce(operator.or_, parts) if parts else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if _non_finite(F.lit(None).cast(inner), inner) is None:
            return None
        return F.coalesce(F.exists(value if isinstance(kind, T.ArrayType) else F.map_values(value), lambda x: _non_finite(x, inner)), F.lit(False))
    return None


def non_finite_rows(df: DataFrame) -> int:
    """How many rows hold a NaN or infinite number, at any depth."""
    bad = [p for f in df.schema.fields if (p := _non_finite(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return df.where(reduce(operator.or_, bad)).count() if bad else 0


def write_json_report(df: DataFrame, path: str) -> None:
    """df as JSON lines under path; NaN and infinite numbers are refused."""
    if bad := non_finite_rows(df):
        raise ValueError(f"{bad} rows hold numbers that JSON cannot")
    df.write.mode("overwrite").json(path)


def bars_of_items(lineitem: DataFrame, symbol, keep: str = "l_shipdate") -> DataFrame:
    """Daily bars of line items: a price is extended price by quantity, in the order of the item's keys."""
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = lineitem.select(symbol.alias("symbol"), F.to_timestamp(keep).alias("ts"), price.alias("p"), order.alias("o"), F.col("l_quantity").cast("double").alias("q"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("q").alias("volume")
    )


def bars_of_events(events: DataFrame) -> DataFrame:
    """Hourly bars of event values by event type; volume is the number of events."""
    order = F.struct("ts", "event_id")
    hour = F.date_trunc("hour", "ts").alias("hour")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), hour)
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .withColumnRenamed("hour", "ts")
    )
