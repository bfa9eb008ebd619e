"""Indicators: each function adds columns to bars, computed along ts within each symbol.

By default a symbol is one task's work. Where one symbol may hold more rows than a task should, ``blocks`` cuts all series into that
many ranges of time; results are the same (see ``functions.ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.directional import directional_means
from ..functions.ewm import Mean, recursive_means, span, wilder
from ..functions.expressions import bars_in_order, last_rows, log_price, ratio, when_full
from ..functions.ranges import HALO, RANGE, dealt, over_ranges


def ema(bars: DataFrame, length: int, col: str = "close", name: str | None = None, blocks: int | None = None) -> DataFrame:
    """Exponential mean of weight 2 / (length + 1), seeded by the first value."""
    means = [Mean(col, span(length), name or f"ema_{length}")]
    return over_ranges(bars, lambda df: recursive_means(df, means), blocks)


def emas(bars: DataFrame, short: int = 21, mid: int = 50, long: int = 200, col: str = "close", blocks: int | None = None) -> DataFrame:
    """ema_short, ema_mid, ema_long in one pass."""
    means = [Mean(col, span(n), name) for n, name in ((short, "ema_short"), (mid, "ema_mid"), (long, "ema_long"))]
    return over_ranges(bars, lambda df: recursive_means(df, means), blocks)


def ema_slope(df: DataFrame, col: str, lookback: int = 20, blocks: int | None = None) -> DataFrame:
    """Change of col per bar over lookback bars."""
    if blocks:
        return over_ranges(df, lambda d: ema_slope(d, col, lookback), blocks, back=lookback)
    return df.withColumn("ema_slope", (F.col(col) - F.lag(col, lookback).over(bars_in_order())) / lookback)


def true_range(bars: DataFrame, blocks: int | None = None) -> DataFrame:
    """The widest of high - low and either's distance from the close before; what is missing is left out."""
    if blocks:
        return over_ranges(bars, true_range, blocks, back=1)
    before = F.lag("close").over(bars_in_order())
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, length: int = 14, method: str = "wilder", name: str = "atr", blocks: int | None = None) -> DataFrame:
    """Mean true range: recursive with weight 1 / length from the first range on, or of the last length bars."""
    if method not in ("wilder", "sma"):
        raise ValueError(f"unknown method {method}")
    if blocks:
        return over_ranges(bars, lambda df: atr(df, length, method, name), blocks, back=1 if method == "wilder" else length)
    ranged = true_range(bars)
    if method == "wilder":
        return recursive_means(ranged, [Mean("true_range", wilder(length), name)])
    frame = last_rows(length)
    return ranged.withColumn(name, when_full(length, F.col("true_range"), F.avg("true_range").over(frame), frame))


def directional_moves(bars: DataFrame, blocks: int | None = None) -> DataFrame:
    """plus_dm and minus_dm: the larger of the two moves if it is positive, else 0; the first bar has 0."""
    if blocks:
        return over_ranges(bars, directional_moves, blocks, back=1)
    w = bars_in_order()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    return bars.withColumn("_up", up).withColumn("_down", down).select(
        *bars.columns,
        F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0).alias("plus_dm"),
        F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0).alias("minus_dm"),
    )


def with_dx(df: DataFrame) -> DataFrame:
    """plus_di, minus_di and dx from columns that already hold the means tr_mean, plus_mean and minus_mean."""
    base = F.nullif(F.col("tr_mean"), F.lit(0.0))
    df = df.withColumn("plus_di", 100 * ratio(F.col("plus_mean"), base)).withColumn("minus_di", 100 * ratio(F.col("minus_mean"), base))
    total = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    return df.withColumn("dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), total))


def with_adx(df: DataFrame, length: int = 14) -> DataFrame:
    """adx, plus_di, minus_di from columns that already hold the means tr_mean, plus_mean and minus_mean."""
    return recursive_means(with_dx(df), [Mean("dx", wilder(length), "adx")])


def adx_full(bars: DataFrame, length: int = 14, blocks: int | None = None) -> DataFrame:
    """Directional index adx with plus_di and minus_di; the index's mean starts at the first bar that has one.

    bars may be a dealt frame (see ``functions.ranges``), which stays one.
    """
    if blocks:
        return adx_full(dealt(bars, blocks), length).drop(RANGE)
    if RANGE in bars.columns:
        return with_dx(directional_means(bars, wilder(length))).select(*bars.columns, "adx", "plus_di", "minus_di")
    moved = directional_moves(true_range(bars))
    w = wilder(length)
    means = recursive_means(moved, [Mean("true_range", w, "tr_mean"), Mean("plus_dm", w, "plus_mean"), Mean("minus_dm", w, "minus_mean")])
    return with_adx(means, length).select(*[c for c in bars.columns if c != HALO], "adx", "plus_di", "minus_di")


def adx(bars: DataFrame, length: int = 14, blocks: int | None = None) -> DataFrame:
    return adx_full(bars, length, blocks).drop("plus_di", "minus_di")


def bollinger(bars: DataFrame, length: int = 20, num_std: float = 2.0, blocks: int | None = None) -> DataFrame:
    """bb_middle, bb_upper, bb_lower, bb_bandwidth and bb_percent (within 0 and 1); sample deviation."""
    if blocks:
        return over_ranges(bars, lambda df: bollinger(df, length, num_std), blocks, back=length - 1)
    frame = last_rows(length)
    close = F.col("close")
    df = bars.withColumn("bb_middle", when_full(length, close, F.avg("close").over(frame), frame))
    df = df.withColumn("_s", num_std * when_full(length, close, F.stddev_samp("close").over(frame), frame))
    df = df.withColumn("bb_upper", F.col("bb_middle") + F.col("_s")).withColumn("bb_lower", F.col("bb_middle") - F.col("_s"))
    share = ratio(close - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))
    return df.withColumn("bb_bandwidth", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle"))).withColumn(
        "bb_percent", F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    ).drop("_s")


def keltner(bars: DataFrame, ma_length: int = 20, atr_length: int = 20, atr_mult: float = 2.0, ma_type: str = "ema", blocks: int | None = None) -> DataFrame:
    """kc_middle, kc_upper, kc_lower, kc_width and kc_bandwidth around a mean of the close, by recursive mean true range."""
    if ma_type not in ("ema", "sma"):
        raise ValueError(f"unknown ma_type {ma_type}")
    if blocks:
        return over_ranges(bars, lambda df: keltner(df, ma_length, atr_length, atr_mult, ma_type), blocks, back=1 if ma_type == "ema" else max(1, ma_length - 1))
    ranged, means = true_range(bars), [Mean("true_range", wilder(atr_length), "_atr")]
    if ma_type == "ema":
        means.append(Mean("close", span(ma_length), "kc_middle"))
    else:
        frame = last_rows(ma_length)
        ranged = ranged.withColumn("kc_middle", when_full(ma_length, F.col("close"), F.avg("close").over(frame), frame))
    df = recursive_means(ranged, means)
    off = atr_mult * F.col("_atr")
    df = df.withColumn("kc_upper", F.col("kc_middle") + off).withColumn("kc_lower", F.col("kc_middle") - off)
    df = df.withColumn("kc_width", F.col("kc_upper") - F.col("kc_lower"))
    return df.withColumn("kc_bandwidth", ratio(F.col("kc_width"), F.col("kc_middle"))).drop("_atr", "true_range")


def _fitted(df: DataFrame, y: Column, length: int) -> DataFrame:
    """Columns _y, _mean, _b (slope), _sxx and _syy (sums of squares) of the least-squares line over the last length bars."""
    frame = last_rows(length)
    df = df.withColumn("_y", y).withColumn("_i", F.row_number().over(bars_in_order()).cast("double"))
    full = lambda e: when_full(length, F.col("_y"), e, frame)
    sxx = length * (length * length - 1) / 12.0
    df = df.withColumn("_mean", full(F.avg("_y").over(frame))).withColumn("_cov", full(F.covar_pop("_y", "_i").over(frame)))
    df = df.withColumn("_syy", full(F.var_pop("_y").over(frame)) * length).withColumn("_sxx", F.lit(sxx))
    return df.withColumn("_b", F.col("_cov") * length / F.col("_sxx"))


_SCRATCH = ("_y", "_i", "_mean", "_cov", "_syy", "_sxx", "_b")


def reg_slope_r2(df: DataFrame, col: str = "close", length: int = 50, use_log: bool = False, normalize: bool = True, blocks: int | None = None) -> DataFrame:
    """reg_slope and reg_r2 of the line over the last length values.

    A normalised slope is divided by the mean's absolute value; reg_r2 is taken with that slope as well, so it differs
    from the textbook's and may be negative. Constant values have no reg_r2.
    """
    if blocks:
        return over_ranges(df, lambda d: reg_slope_r2(d, col, length, use_log, normalize), blocks, back=length - 1)
    fitted = _fitted(df, log_price(F.col(col)) if use_log else F.col(col), length)
    size = F.abs(F.col("_mean"))
    slope = F.when(size != 0, F.col("_b") / size).otherwise(F.col("_b")) if normalize else F.col("_b")
    fitted = fitted.withColumn("reg_slope", slope)
    explained = 2 * F.col("reg_slope") * F.col("_b") * F.col("_sxx") - F.col("reg_slope") * F.col("reg_slope") * F.col("_sxx")
    return fitted.withColumn("reg_r2", ratio(explained, F.col("_syy"))).drop(*_SCRATCH)


def reg_slope(df: DataFrame, col: str = "close", length: int = 50, use_log: bool = False, normalize: bool = True, blocks: int | None = None) -> DataFrame:
    return reg_slope_r2(df, col, length, use_log, normalize, blocks).drop("reg_r2")


def rolling_ols_forecast(df: DataFrame, col: str = "close", length: int = 50, project_at: float | None = None, blocks: int | None = None) -> DataFrame:
    """ols_forecast: the line over the last length values at x = project_at (0 is the oldest); ols_std: its residuals' deviation."""
    if blocks:
        return over_ranges(df, lambda d: rolling_ols_forecast(d, col, length, project_at), blocks, back=length - 1)
    at = float(length if project_at is None else project_at)
    fitted = _fitted(df, F.col(col), length)
    left = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"))
    return fitted.withColumn("ols_forecast", F.col("_mean") + F.col("_b") * (at - (length - 1) / 2.0)).withColumn(
        "ols_std", F.when(F.col("_syy").isNotNull(), F.sqrt(left / length))
    ).drop(*_SCRATCH)
