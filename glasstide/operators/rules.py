"""The rule engine: trend, volatility and chop labels as expressions, one row per bar or one per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChopSettings, RuleSettings, TrendSettings, VolSettings
from ..functions.ewm import Mean, recursive_means, span, wilder
from ..functions.expressions import bars_in_order, last_rows, ratio
from ..functions.ranges import HALO, in_ranges, is_ranged, over_ranges, whole, with_halo
from ..functions.ranks import trailing_ranks
from ..functions.storage import kept
from ..sources.bars import slice_window
from .indicators import bollinger, directional_moves, ema_slope, reg_slope_r2, true_range, with_adx


def stack_label(short: Column, mid: Column, long: Column, price: Column, tolerance: float) -> Column:
    tol = price * tolerance
    bull, bear = (short > mid + tol) & (mid > long + tol), (short < mid - tol) & (mid < long - tol)
    return F.when(bull, "bull").when(bear, "bear").otherwise("mixed")


def ema_stack(df: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """Whether the three means of df (ema_short, ema_mid, ema_long) stand apart in order."""
    return df.withColumn("ema_stack", stack_label(F.col("ema_short"), F.col("ema_mid"), F.col("ema_long"), F.col("close"), cfg.trend.ema_tolerance))


def trend_of(stack: Column, slope: Column, r2: Column, t: TrendSettings) -> Column:
    weak = (F.abs(slope) < t.slope_min) | (r2 < t.r2_min)
    return (
        F.when((stack == "bull") & (slope >= 0), "up").when((stack == "bear") & (slope <= 0), "down")
        .when(weak, "flat").when(slope > 0, "up").when(slope < 0, "down").otherwise("flat")
    )


def trend_label(df: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """up, down or flat from ema_stack, reg_slope and reg_r2."""
    return df.withColumn("trend", trend_of(F.col("ema_stack"), F.col("reg_slope"), F.col("reg_r2"), cfg.trend))


def trend_label_simple(bars: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """up, down or flat from the slope of the middle mean, in price points per bar; null until there is a slope."""
    df = recursive_means(in_ranges(bars, blocks) if blocks else bars, [Mean("close", span(cfg.trend.ema_mid), "_mid")])
    return _own(_simple_trend(_seen(df, cfg.trend.slope_lookback), "_mid", cfg.trend)).drop("_mid")


def _seen(df: DataFrame, back: int) -> DataFrame:
    """df, with copies of the rows before each piece if it is a ranged frame."""
    return with_halo(kept(df), back) if is_ranged(df) else df


def _own(df: DataFrame) -> DataFrame:
    return whole(df) if is_ranged(df) else df


def _simple_trend(df: DataFrame, mid: str, t: TrendSettings) -> DataFrame:
    sloped = ema_slope(df, mid, t.slope_lookback)
    s, least = F.col("ema_slope"), t.slope_min
    label = F.when(s > least, "up").when(s < -least, "down").when(s.isNotNull(), "flat")
    return sloped.withColumn("trend_simple", label).drop("ema_slope")


def vol_of(atr_percent: Column, v: VolSettings) -> Column:
    return F.when(atr_percent < v.atr_low, "low").when(atr_percent < v.atr_high, "normal").when(atr_percent < v.atr_extreme, "high").otherwise("extreme")


def vol_label(df: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """atr_percent and vol from atr and close; a missing value counts as extreme."""
    df = df.withColumn("atr_percent", 100 * ratio(F.col("atr"), F.col("close")))
    return df.withColumn("vol", vol_of(F.col("atr_percent"), cfg.vol))


def vol_label_pctl(bars: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """atr_percent and vol_pctl: where atr_percent ranks among the last non-null ones; nothing to rank is normal."""
    v = cfg.vol
    df = over_ranges(bars, lambda d: recursive_means(true_range(d), [Mean("true_range", wilder(v.atr_lookback), "_atr")]), blocks, back=1)
    df = df.withColumn("atr_percent", 100 * ratio(F.col("_atr"), F.col("close"))).drop("_atr", "true_range")
    if blocks:  # rows without a value would push others out of reach
        df = kept(df)
        known = over_ranges(df.where("atr_percent is not null"), lambda d: trailing_ranks(d, "atr_percent", v.pctl_lookback, 1, "_share"), blocks, back=v.pctl_lookback - 1)
        df = known.unionByName(df.where("atr_percent is null").withColumn("_share", F.lit(None).cast("double")))
    else:
        df = trailing_ranks(df, "atr_percent", v.pctl_lookback, 1, "_share", skip_nulls=True)
    share = 100 * F.col("_share")
    return df.withColumn("vol_pctl", F.when(share >= v.pctl_high, "high").when(share <= v.pctl_low, "low").otherwise("normal")).drop("_share")


def _bollinger_width(df: DataFrame, v: VolSettings) -> DataFrame:
    """bb_width as a share of the close."""
    banded = bollinger(df, v.bb_length, v.bb_std)
    return banded.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("close"))).select(*df.columns, "bb_width")


def _keltner_width(df: DataFrame, v: VolSettings) -> DataFrame:
    """kc_width as a share of the close, from bars that hold _kc_atr."""
    return df.withColumn("kc_width", ratio(2 * v.kc_atr_mult * F.col("_kc_atr"), F.col("close")))


def band_widths(bars: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """bb_width and kc_width: the bands' widths as shares of the close."""
    if blocks:
        return over_ranges(bars, lambda df: band_widths(df, cfg), blocks, back=max(1, cfg.vol.bb_length - 1))
    df = recursive_means(_bollinger_width(true_range(bars), cfg.vol), [Mean("true_range", wilder(cfg.vol.kc_length), "_kc_atr")])
    return _keltner_width(df, cfg.vol).drop("_kc_atr", "true_range")


def squeeze_state(df: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """compressed, expanding or normal from bb_width and kc_width."""
    v = cfg.vol
    if blocks:
        return over_ranges(df, lambda d: squeeze_state(d, cfg), blocks, back=v.expansion_lookback - 1)
    share = ratio(F.col("bb_width"), F.col("kc_width"))
    least = F.min("bb_width").over(last_rows(v.expansion_lookback))
    grows = (share > v.squeeze_out) & (F.col("bb_width") > least)
    label = F.when(F.col("kc_width") <= 0, "normal").when(share < v.squeeze_in, "compressed").when(grows, "expanding").otherwise("normal")
    return df.withColumn("squeeze", label)


def chop_label(df: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """trending or choppy from adx; a missing adx is choppy."""
    return df.withColumn("chop", F.when(F.col("adx") >= cfg.chop.adx_trend, "trending").otherwise("choppy"))


def structure_of(adx: Column, change: Column, c: ChopSettings) -> Column:
    rising = change > 0
    return F.when((adx >= c.adx_trend) & rising, "trending").when((adx < c.adx_trend) & rising, "coil").otherwise("choppy")


def chop_structure(df: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """structure: trending, coil or choppy from adx and its change over the last three values; null before the first adx.

    adx is null at a series' beginning only, so with fewer than three values the first one stands in.
    """
    if blocks:
        return over_ranges(df, lambda d: chop_structure(d, cfg), blocks, back=2)
    w = bars_in_order()
    first = F.first("adx", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    change = F.col("adx") - F.coalesce(F.lag("adx", 2).over(w), first)
    df = df.withColumn("_change", change)
    return df.withColumn("structure", F.when(F.col("adx").isNotNull(), structure_of(F.col("adx"), F.col("_change"), cfg.chop))).drop("_change")


def regime_of(trend: Column, stack: Column, vol: Column, chop: Column) -> Column:
    wild = vol.isin("high", "extreme")
    up, down = (trend == "up") | (stack == "bull"), (trend == "down") | (stack == "bear")
    return (
        F.when(up & wild, "bull_high_vol").when(up, "bull").when(down & wild, "bear_high_vol").when(down, "bear")
        .when(wild & (chop == "trending"), "high_vol").otherwise("range")
    )


def composite_regime(df: DataFrame) -> DataFrame:
    """regime from trend, ema_stack, vol and chop."""
    return df.withColumn("regime", regime_of(F.col("trend"), F.col("ema_stack"), F.col("vol"), F.col("chop")))


#: What a label adds to the confidence.
VOL_SCORE = {"low": 0.4, "normal": 0.7, "high": 0.9, "extreme": 0.8}
CHOP_SCORE = {"trending": 1.0, "coil": 0.8, "choppy": 0.4}
OTHER_SCORE = 0.6


def _scored(label: Column, scores: dict[str, float]) -> Column:
    out = F
    for name, score in scores.items():
        out = out.when(label == name, score)
    return out.otherwise(OTHER_SCORE)


def confidence_of(slope: Column, r2: Column, vol: Column, chop: Column, cfg: RuleSettings) -> Column:
    t = cfg.trend
    strength = F.least(F.lit(1.0), F.abs(slope) / (2.0 * max(t.slope_min, 1e-9)))
    fit = F.when(r2 <= t.r2_min, 0.0).otherwise(F.least(F.lit(1.0), (r2 - t.r2_min) / (1.0 - t.r2_min)))
    mean = (0.6 * strength + 0.4 * fit + _scored(vol, VOL_SCORE) + _scored(chop, CHOP_SCORE)) / 3.0
    return F.when(slope.isNotNull() & r2.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def confidence(df: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """confidence (0 to 1) from reg_slope, reg_r2, vol and chop."""
    return df.withColumn("confidence", confidence_of(F.col("reg_slope"), F.col("reg_r2"), F.col("vol"), F.col("chop"), cfg))


def label_windows(bars: DataFrame, cfg: RuleSettings) -> DataFrame:
    """bars with what labels need of a bounded number of rows before: ranges, moves, regression, the inner bands' width."""
    fitted = reg_slope_r2(directional_moves(true_range(bars)), "close", cfg.trend.reg_length, use_log=True, normalize=True)
    return _bollinger_width(fitted, cfg.vol)


def label_means(cfg: RuleSettings) -> list[Mean]:
    """The recursive means that labels need; that of the directional index follows from the last three."""
    t, v, w = cfg.trend, cfg.vol, wilder(cfg.chop.adx_lookback)
    return [
        Mean("close", span(t.ema_short), "ema_short"), Mean("close", span(t.ema_mid), "ema_mid"), Mean("close", span(t.ema_long), "ema_long"),
        Mean("true_range", wilder(v.atr_lookback), "atr"), Mean("true_range", wilder(v.kc_length), "_kc_atr"),
        Mean("true_range", w, "tr_mean"), Mean("plus_dm", w, "plus_mean"), Mean("minus_dm", w, "minus_mean"),
    ]


def label_reach(cfg: RuleSettings) -> int:
    """How many rows before its own a label looks at, besides what recursive means carry."""
    t, v = cfg.trend, cfg.vol
    return max(2, t.reg_length - 1, v.bb_length + v.expansion_lookback - 2, t.slope_lookback)


_SCRATCH = ("true_range", "plus_dm", "minus_dm", "tr_mean", "plus_mean", "minus_mean", "plus_di", "minus_di", "dx", "_kc_atr")


def diagnosed(bars: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """bars with everything that labels need: means, atr, adx, regression and band widths; two streamed passes."""
    means = recursive_means(label_windows(bars, cfg), label_means(cfg))
    return _keltner_width(with_adx(means, cfg.chop.adx_lookback), cfg.vol).drop(*_SCRATCH)


def shaped(df: DataFrame, cfg: RuleSettings) -> DataFrame:
    """diagnosed() with squeeze, structure and trend_simple, which look a few rows back at means and widths."""
    return _simple_trend(chop_structure(squeeze_state(df, cfg), cfg), "ema_mid", cfg.trend)


def named(df: DataFrame, cfg: RuleSettings) -> DataFrame:
    """shaped() with all labels, which look at their own row only."""
    return confidence(composite_regime(chop_label(vol_label(trend_label(ema_stack(df, cfg), cfg), cfg), cfg)), cfg)


def _structured(bars: DataFrame, cfg: RuleSettings, blocks: int | None) -> DataFrame:
    """diagnosed() with squeeze, structure and trend_simple; with blocks still a ranged frame, without copies."""
    t, v = cfg.trend, cfg.vol
    if blocks:
        bars = with_halo(in_ranges(bars, blocks), max(1, t.reg_length - 1, v.bb_length - 1))
    df = shaped(_seen(diagnosed(bars, cfg), max(2, v.expansion_lookback - 1, t.slope_lookback)), cfg)
    return df.where(f"not {HALO}").drop(HALO) if HALO in df.columns else df


def labelled(bars: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """Every bar's labels, confidence included, also where too little came before it for a regime."""
    return named(_own(_structured(bars, cfg, blocks)).drop("trend_simple"), cfg)


def rule_history(bars: DataFrame, cfg: RuleSettings = RuleSettings(), blocks: int | None = None) -> DataFrame:
    """symbol, ts, regime of every bar that has a slope, an r2 and a long mean."""
    return labelled(bars, cfg, blocks).where("reg_slope is not null and reg_r2 is not null and ema_long is not null").select("symbol", "ts", "regime")


def regime_snapshot(bars: DataFrame, cfg: RuleSettings = RuleSettings(), timeframe: str = "1d", start=None, end=None, blocks: int | None = None) -> DataFrame:
    """One row per symbol: its labels as of the last bar.

    Means, atr, adx and the pair of slope and r2 take their last non-null value, price and widths those of the last bar.
    Symbols with too few bars for a regression fall back on the simple trend with slope and r2 of 0; with too few for
    that as well they have no row.
    """
    df = _own(_structured(slice_window(bars, start, end), cfg, blocks))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    fit = F.when(F.col("reg_slope").isNotNull() & F.col("reg_r2").isNotNull(), F.col("ts"))
    rows = df.groupBy("symbol").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max_by("close", "ts").alias("close"), F.max_by("squeeze", "ts").alias("squeeze"),
        F.max_by("bb_width", "ts").alias("bb_width"), F.max_by("kc_width", "ts").alias("kc_width"), F.max_by("trend_simple", "ts").alias("trend_simple"),
        last("ema_short"), last("ema_mid"), last("ema_long"), last("atr"), last("adx"), last("structure"),
        F.max_by("reg_slope", fit).alias("reg_slope"), F.max_by("reg_r2", fit).alias("reg_r2"),
    ).where("trend_simple is not null")
    fitted = F.col("reg_slope").isNotNull()
    stack = F.when(fitted, stack_label(F.col("ema_short"), F.col("ema_mid"), F.col("ema_long"), F.col("close"), cfg.trend.ema_tolerance)).otherwise("mixed")
    atr_percent = F.when(F.col("close") == 0, 0.0).otherwise(100 * ratio(F.col("atr"), F.col("close")))
    rows = rows.withColumn("ema_stack", stack).withColumn("atr_percent", F.coalesce(atr_percent, F.lit(0.0)))
    rows = rows.withColumn("vol", F.when(F.col("atr").isNull(), "normal").otherwise(vol_of(F.col("atr_percent"), cfg.vol)))
    rows = rows.withColumn("trend", F.when(fitted, trend_of(F.col("ema_stack"), F.col("reg_slope"), F.col("reg_r2"), cfg.trend)).otherwise(F.col("trend_simple")))
    rows = rows.withColumn("reg_slope", F.coalesce("reg_slope", F.lit(0.0))).withColumn("reg_r2", F.coalesce("reg_r2", F.lit(0.0)))
    rows = chop_label(rows, cfg).withColumn("adx", F.coalesce("adx", F.lit(0.0))).withColumn("timeframe", F.lit(timeframe))
    return confidence(composite_regime(rows), cfg).select(
        "symbol", "timeframe", "start", "end", "regime", "confidence", "trend", F.col("reg_slope").alias("trend_slope"), F.col("reg_r2").alias("trend_r2"),
        "ema_stack", "vol", "atr_percent", "squeeze", "chop", "adx", "structure",
    )


DIAGNOSTICS = ("trend", "trend_slope", "trend_r2", "ema_stack", "vol", "atr_percent", "squeeze", "chop", "adx", "structure")


def get_regime(bars: DataFrame, cfg: RuleSettings = RuleSettings(), **window) -> DataFrame:
    """symbol, regime, confidence and all diagnostics as one struct."""
    return regime_snapshot(bars, cfg, **window).select("symbol", "regime", "confidence", F.struct(*DIAGNOSTICS).alias("diagnostics"))


#: Fixed value: the summary's format.
SUMMARY = "%s %s %s \u2192 %s | Regime: %s (conf=%.2f) | Trend=%s (slope=%.4f, r2=%.2f), Vol=%s, Chop=%s"


def summary_line(snapshot: DataFrame) -> DataFrame:
    """symbol and one line of text that sums up its snapshot."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.format_string(
        SUMMARY, "symbol", "timeframe", day("start"), day("end"), "regime", "confidence", "trend", "trend_slope", "trend_r2", "vol", "chop",
    )
    return snapshot.select("symbol", text.alias("summary"))
