"""Panel features: several symbols on one calendar, as a matrix of 18 columns per bar of the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Universe
from ..functions.ewm import Mean, recursive_means, span
from ..functions.expressions import bars_in_order, ratio
from ..functions.ranges import AT, before_each, in_ranges, over_ranges, whole
from ..functions.ranks import trailing_ranks
from ..functions.storage import kept

# The features in the order that a state model expects.
FEATURE_NAMES = (
    "spy_ema21_spread", "spy_ema50_spread", "spy_ema200_spread", "qqq_spy_rel_21d", "vix_pctl_252d", "vix_slope_10d", "breadth_ema50",
    "spy_return_126d", "credit_spread_21d", "tlt_return_21d", "copper_gold_21d", "vix_accel_5d", "credit_spread_momentum",
    "breadth_acceleration", "tsy_3m_yield_slope", "fed_funds_futures_slope", "yield_curve_slope_10y2y", "recession_probability_nyfed",
)


def filled(value: Column, order) -> Column:
    """value, or else the last one before it."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(df: DataFrame, cols: list[str], blocks: int | None = None) -> DataFrame:
    """symbol, ts and cols, each null filled by the last value before it in its symbol; a leading gap stays null.

    With blocks a range of time begins with the last value of all ranges before it.
    """
    frame = in_ranges(df.select("symbol", "ts", *cols), blocks) if blocks else df
    values = {c: filled(F.col(c), bars_in_order()) for c in cols}
    if not blocks:
        return frame.select("symbol", "ts", *[v.alias(c) for c, v in values.items()])
    last = {f"_last{i}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(AT))) for i, c in enumerate(cols)}
    frame = before_each(frame, last, {n: (lambda n, before: F.last(n, ignorenulls=True).over(before)) for n in last})
    return whole(frame.select("symbol", "ts", AT, *[F.coalesce(values[c], n).alias(c) for c, n in zip(cols, last)]))


def align_ffill(calendar: DataFrame, df: DataFrame, cols: list[str], blocks: int | None = None) -> DataFrame:
    """cols of df at the dates of calendar (symbol, ts), gaps filled from before. df: ts and cols, one row per ts.

    Only rows whose ts stands in the calendar count; a value between two dates is dropped, not carried on.
    """
    joined = calendar.select("symbol", "ts").join(df.select("ts", *cols), "ts", "left")
    return forward_fill(joined, cols, blocks)


def ret_n(bars: DataFrame, n: int, name: str = "ret", blocks: int | None = None) -> DataFrame:
    """Return over n bars of a symbol's own."""
    if blocks:
        return over_ranges(bars, lambda df: ret_n(df, n, name), blocks, back=n)
    return bars.withColumn(name, ratio(F.col("close"), F.lag("close", n).over(bars_in_order())) - 1)


def slope_n(bars: DataFrame, n: int = 5, name: str = "slope", blocks: int | None = None) -> DataFrame:
    """Change over n bars of a symbol's own, as a share of the close (of 1e-8 where that is 0)."""
    if blocks:
        return over_ranges(bars, lambda df: slope_n(df, n, name), blocks, back=n)
    price = F.when(F.col("close") == 0, 1e-8).otherwise(F.col("close"))
    return bars.withColumn(name, (F.col("close") - F.lag("close", n).over(bars_in_order())) / price)


def trailing_rank_pct(df: DataFrame, col: str, window: int = 252, min_periods: int = 60, name: str = "rank_pct", blocks: int | None = None) -> DataFrame:
    """Rank of col among the non-null values of the last rows, ties averaged, divided by their number.

    Null where col is, or where fewer than min_periods values are not. An ordered window travels along each sorted series, so a row
    costs the logarithm of the window, and no row carries the window's values.
    """
    return over_ranges(df, lambda d: trailing_ranks(d, col, window, min_periods, name), blocks, back=window - 1)


def diff_n(df: DataFrame, col: str, n: int = 5, name: str = "diff", blocks: int | None = None) -> DataFrame:
    """Change of col over n rows; 0 where either is missing."""
    if blocks:
        return over_ranges(df, lambda d: diff_n(d, col, n, name), blocks, back=n)
    return df.withColumn(name, F.coalesce(F.col(col) - F.lag(col, n).over(bars_in_order()), F.lit(0.0)))


def sector_breadth(
    bars: DataFrame, calendar: DataFrame, sectors: tuple[str, ...], length: int = 50, min_bars: int = 60, usable: tuple[str, ...] | None = None
) -> DataFrame:
    """symbol, ts, breadth on calendar: the share of sectors that stand above their own mean, among those that have begun.

    Sectors with fewer than min_bars bars are left out, unless ``usable`` already names those that stay; without any sector
    left breadth is one half.
    """
    if usable is None:
        counts = bars.where(F.col("symbol").isin(list(sectors))).groupBy("symbol").count().where(F.col("count") >= min_bars)
        usable = tuple(sorted(r["symbol"] for r in counts.collect()))  # a fixed few
    if not usable:
        return calendar.select("symbol", "ts", F.lit(0.5).alias("breadth"))
    own = bars.where(F.col("symbol").isin(list(usable))).select("symbol", "ts", "close")
    above = recursive_means(own, [Mean("close", span(length), "mean")])
    above = above.select(F.col("symbol").alias("sector"), "ts", (F.col("close") > F.col("mean")).cast("double").alias("above"))
    cols = [f"_s{i}" for i in range(len(usable))]  # a fixed few, so one column each
    wide = above.groupBy("ts").agg(*[F.max(F.when(F.col("sector") == s, F.col("above"))).alias(c) for s, c in zip(usable, cols)])
    at = align_ffill(calendar, wide, cols)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    begun = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return at.select("symbol", "ts", ratio(total, begun.cast("double")).alias("breadth"))


def market_frame(bars: DataFrame, universe: Universe) -> DataFrame:
    """One row per ts with what the features need of every part but the target and the sectors, on each symbol's own calendar."""
    u = universe
    others = bars.where(F.col("symbol").isin(u.symbols()))
    own = slope_n(ret_n(others, 21, "ret21"), 5, "slope5")
    of = lambda symbol, value: F.max(F.when(F.col("symbol") == symbol, F.col(value)))
    parts = {
        "vix": (u.vol_index, "close"), "growth": (u.growth, "ret21"), "hyg": (u.high_yield, "ret21"), "ief": (u.mid_duration, "ret21"),
        "tlt": (u.long_duration, "ret21"), "gold": (u.gold, "ret21"), "copper": (u.copper, "ret21"), "irx": (u.short_rate, "slope5"),
    }
    wide = own.groupBy("ts").agg(*[of(s, v).alias(k) for k, (s, v) in parts.items()], of(u.long_rate, "close").alias("_long"), of(u.short_rate, "close").alias("_short"))
    return wide.withColumn("curve", F.col("_long") - F.col("_short")).drop("_long", "_short")


def feature_matrix(bars: DataFrame, universe: Universe, warmup: int = 252, targets: tuple[str, ...] | None = None, keep: bool = True) -> DataFrame:
    """symbol, ts and the 18 features of each target's bars after its first ``warmup``, rows with any null left out.

    targets: symbols that the features are computed for, the universe's target if not given. What they share, the market frame and
    each sector's standing, is computed once and met by every target's own dates; all windows are by target. Terms of other symbols
    are computed on their own bars, then put on the target's dates and filled forward. A missing part gives 0; a missing target or
    vol_index is an error. keep: compute the bars once and keep them, unless the caller has done so.
    """
    targets = tuple(dict.fromkeys(targets or (universe.target,)))
    wanted = sorted({*targets, *(s for s in universe.symbols() if s != universe.target)})
    bars = bars.where(F.col("symbol").isin(wanted)).select("symbol", "ts", "close")
    bars = kept(bars) if keep else bars  # read for four purposes
    counts = {r["symbol"]: r["count"] for r in bars.groupBy("symbol").count().collect()}  # a row per target and part of the universe
    for part in (*targets, universe.vol_index):
        if part not in counts:
            raise ValueError(f"no bars for {part}")
    usable = tuple(s for s in universe.sectors if counts.get(s, 0) >= 60)
    target = bars.where(F.col("symbol").isin(list(targets)))
    calendar = target.select("symbol", "ts")
    w, c = bars_in_order(), F.col("close")
    means = recursive_means(target.select("symbol", "ts", "close"), [Mean("close", span(n), f"m{n}") for n in (21, 50, 200)])
    names = ["vix", "growth", "hyg", "ief", "tlt", "gold", "copper", "irx", "curve"]
    df = means.join(align_ffill(calendar, market_frame(bars, universe), names), ["symbol", "ts"])
    df = df.join(sector_breadth(bars, calendar, universe.sectors, usable=usable), ["symbol", "ts"])
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    own = lambda n: zero(ratio(c, F.lag("close", n).over(w)) - 1)
    df = df.select("symbol", "ts", "close", "m21", "m50", "m200", "vix", "breadth", *[zero(F.col(n)).alias(n) for n in names[1:]])
    df = df.withColumns(
        {
            "spy_ema21_spread": ratio(c - F.col("m21"), F.col("m21")),
            "spy_ema50_spread": ratio(c - F.col("m50"), F.col("m50")),
            "spy_ema200_spread": ratio(c - F.col("m200"), F.col("m200")),
            "qqq_spy_rel_21d": F.col("growth") - own(21),
            "vix_slope_10d": ratio(F.col("vix") - F.lag("vix", 10).over(w), 10 * F.col("vix")),
            "breadth_ema50": F.col("breadth"),
            "spy_return_126d": own(126),
            "credit_spread_21d": F.col("hyg") - F.col("ief"),
            "tlt_return_21d": F.col("tlt"),
            "copper_gold_21d": F.col("copper") - F.col("gold"),
            "tsy_3m_yield_slope": F.col("irx"),
            "fed_funds_futures_slope": F.lit(0.0),
            "yield_curve_slope_10y2y": F.col("curve"),
            "recession_probability_nyfed": F.lit(0.0),
            "_n": F.row_number().over(w),
        }
    )
    for source, name in (("vix_slope_10d", "vix_accel_5d"), ("credit_spread_21d", "credit_spread_momentum"), ("breadth_ema50", "breadth_acceleration")):
        df = diff_n(df, source, 5, name)
    df = trailing_rank_pct(df, "vix", 252, 60, "vix_pctl_252d")  # last, as windows after it would shuffle again
    return df.where(F.col("_n") > warmup).select("symbol", "ts", *FEATURE_NAMES).dropna("any")
