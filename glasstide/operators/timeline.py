"""Label timelines: labels on a calendar, runs of one colour, year marks and price extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bars_in_order, looked_up
from ..functions.ranges import HALO, before_each, in_ranges, whole, with_halo
from ..functions.storage import kept
from .features import forward_fill

# Labels of both engines that share a colour.
COLOURS = {
    "Risk-On": "risk-on",
    "Risk-On-Retreat": "retreat",
    "Risk-Off": "risk-off",
    "Risk-Off-Stable": "stable",
    "bull": "risk-on",
    "bull_high_vol": "risk-on",
    "bear": "risk-off",
    "bear_high_vol": "risk-off",
    "range": "neutral",
    "high_vol": "volatile",
}


def colour_key(label: Column) -> Column:
    """The colour of a label: neutral for an unknown one, null for none."""
    return F.when(label.isNotNull(), looked_up(label, COLOURS, F.lit("neutral")))


def label_timeline(calendar: DataFrame, labels: DataFrame, blocks: int | None = None) -> DataFrame:
    """symbol, ts, regime on calendar: gaps are filled from before, a leading gap stays null. labels are by symbol and ts."""
    joined = calendar.select("symbol", "ts").join(labels.select("symbol", "ts", "regime"), ["symbol", "ts"], "left")
    return forward_fill(joined, ["regime"], blocks)


def regime_runs(timeline: DataFrame, blocks: int | None = None) -> DataFrame:
    """symbol, run, colour, start, end, bars of the longest stretches of consecutive bars of one colour; null ones are left out.

    With blocks, runs are counted in ranges of time, numbered on from the ranges before, and joined where they cross an end.
    """
    w = bars_in_order()
    df = timeline.select("symbol", "ts", colour_key(F.col("regime")).alias("colour"))
    df = with_halo(in_ranges(df, blocks), back=1) if blocks else df
    df = df.withColumn("_new", (~F.col("colour").eqNullSafe(F.lag("colour").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    if blocks:
        df = kept(df.where(f"not {HALO}").drop(HALO))
        df = before_each(df, {"_runs": F.sum("_new")}, {"_runs": lambda c, before: F.sum(c).over(before)})
        df = whole(df.withColumn("run", F.sum("_new").over(w) + F.coalesce("_runs", F.lit(0))))
    else:
        df = df.withColumn("run", F.sum("_new").over(w))
    runs = df.groupBy("symbol", "run").agg(F.first("colour").alias("colour"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"))
    return runs.where("colour is not null")


def year_marks(bars: DataFrame) -> DataFrame:
    """symbol, year, first: the first bar of each calendar year."""
    return bars.groupBy("symbol", F.year("ts").alias("year")).agg(F.min("ts").alias("first"))


def price_extent(bars: DataFrame) -> DataFrame:
    """symbol, low, high of the closes."""
    return bars.groupBy("symbol").agg(F.min("close").alias("low"), F.max("close").alias("high"))


