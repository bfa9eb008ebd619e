"""Series cut into ranges give what whole series give, wherever the cuts fall."""

import math
import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glasstide.functions.ranges import HALO, _copies, in_ranges, whole, with_halo
from glasstide.operators import features, indicators, rules, timeline, validation

START = datetime(2020, 1, 1)


def panel(spark):
    """One symbol with most rows and gaps in its highs, some small ones, one without name; equal prices at the hot one's beginning."""
    rows = []
    for symbol, n in (("hot", 420), ("a", 3), ("b", 70), ("zz", 40), (None, 25)):
        for i in range(n):
            close = 50.0 if symbol == "hot" and i < 12 else 100 + 10 * math.sin(i / 7) + (i * 7919 % 13) / 3
            wide = 0.0 if symbol == "hot" and i < 12 else 1 + i % 3
            rows.append((symbol, START + timedelta(days=i), close, None if symbol == "hot" and 100 < i < 160 else close + wide, close - wide, close, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


CASES = {
    "ema": lambda b, k: indicators.ema(b, 21, blocks=k),
    "emas": lambda b, k: indicators.emas(b, blocks=k),
    "ema_slope": lambda b, k: indicators.ema_slope(b, "close", 20, blocks=k),
    "true_range": lambda b, k: indicators.true_range(b, blocks=k),
    "atr": lambda b, k: indicators.atr(b, blocks=k),
    "atr_sma": lambda b, k: indicators.atr(b, method="sma", blocks=k),
    "directional_moves": lambda b, k: indicators.directional_moves(b, blocks=k),
    "adx_full": lambda b, k: indicators.adx_full(b, blocks=k),
    "bollinger": lambda b, k: indicators.bollinger(b, blocks=k),
    "keltner": lambda b, k: indicators.keltner(b, blocks=k),
    "keltner_sma": lambda b, k: indicators.keltner(b, ma_type="sma", blocks=k),
    "reg_slope_r2": lambda b, k: indicators.reg_slope_r2(b, length=30, use_log=True, blocks=k),
    "ols": lambda b, k: indicators.rolling_ols_forecast(b, blocks=k),
    "forward_return": lambda b, k: validation.forward_return(b, blocks=k),
    "ret_n": lambda b, k: features.ret_n(b, 126, blocks=k),
    "slope_n": lambda b, k: features.slope_n(b, blocks=k),
    "diff_n": lambda b, k: features.diff_n(b, "close", blocks=k),
    "rank": lambda b, k: features.trailing_rank_pct(b, "high", 252, 60, blocks=k),
    "forward_fill": lambda b, k: features.forward_fill(b, ["high", "low"], blocks=k),
    "trend_label_simple": lambda b, k: rules.trend_label_simple(b, blocks=k),
    "vol_label_pctl": lambda b, k: rules.vol_label_pctl(b, blocks=k),
    "band_widths": lambda b, k: rules.band_widths(b, blocks=k),
    "labelled": lambda b, k: rules.labelled(b, blocks=k),
    "snapshot": lambda b, k: rules.regime_snapshot(b, blocks=k),
    "timeline": lambda b, k: timeline.label_timeline(b, b.where("dayofmonth(ts) = 3").withColumn("regime", F.col("low").cast("string")), blocks=k),
    "runs": lambda b, k: timeline.regime_runs(b.withColumn("regime", F.when(F.col("high").isNull(), None).when(F.col("close") > 100, "bull").otherwise("bear")), blocks=k),
}


def sorted_rows(df):
    order = [c for c in ("symbol", "ts", "run") if c in df.columns]
    return df.toPandas().sort_values(order, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", CASES)
def test_pieces_give_the_whole(spark, name):
    bars = panel(spark)
    want = sorted_rows(CASES[name](bars, None))
    for blocks in (1, 9, 60) if name in ("adx_full", "forward_return", "runs", "forward_fill") else (23,):
        got = sorted_rows(CASES[name](bars, blocks))
        pd.testing.assert_frame_equal(got, want, rtol=1e-9, check_dtype=False)
    assert CASES[name](bars.limit(0), 5).count() == 0


def test_ranges_share_a_hot_series(spark):
    n = 16
    bars = spark.range(20_000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), F.lit(1.0).alias("close"))
    sizes = [r["count"] for r in in_ranges(bars, n).groupBy("symbol.range").count().collect()]
    assert len(sizes) == n and max(sizes) < 2 * sum(sizes) / n


def test_halo_of_pieces_shorter_than_it():
    pieces = [(0, 0, 2), (1, 10, 10), (2, 20, 24)]
    assert _copies(pieces, 3, 0) == [(0, 1, 0, 2), (1, 2, 10, 10), (0, 2, 1, 2)]
    assert _copies(pieces, 0, 2) == [(1, 0, 10, 10), (2, 0, 20, 20), (2, 1, 20, 21)]


def test_halo_rows_are_marked_and_leave_again(spark):
    bars = panel(spark)
    frame = with_halo(in_ranges(bars, 9), 5, 2)
    assert frame.where(HALO).count() > 0
    assert whole(frame).count() == bars.count()
    assert whole(frame).columns == bars.columns


def odd_panel(spark):
    """Symbols that cross ranges, one without name, with null, NaN and infinite prices, equal moves up and down, and a column besides."""
    rows = []
    for symbol, n in (("hot", 300), ("a", 1), ("b", 90), (None, 60)):
        for i in range(n):
            close = 100 + 10 * math.sin(i / 7) + (i * 7919 % 13) / 3
            high, low = (close + i % 4, close - i % 4) if i % 50 > 5 else (100.5 + i % 50 / 8, 99.5 - i % 50 / 8)
            high = {17: None, 41: math.nan, 88: math.inf}.get(i % 97, high)
            rows.append((symbol, i, f"{symbol} {i}", high, None if i % 31 == 30 else low, None if i % 23 == 22 else math.nan if i == 200 else close))
    return spark.createDataFrame(rows, "symbol string, ts int, note string, high double, low double, close double")


@pytest.mark.parametrize("kind", ("double", "float", "decimal(12,4)", "decimal(38,4)", "int"))
def test_index_of_a_dealt_frame_is_the_whole_series(spark, kind):
    bars = odd_panel(spark)
    if kind not in ("double", "float"):
        bars = bars.replace([math.nan, math.inf], None)
    bars = bars.withColumns({c: F.col(c).cast(kind) for c in ("high", "low", "close")})
    want = sorted_rows(indicators.adx_full(bars))
    assert want["adx"].notna().any()
    for blocks in (1, 7, 450) if kind == "double" else (40,):
        got = sorted_rows(indicators.adx_full(bars, blocks=blocks))
        assert list(got.columns) == list(want.columns)
        pd.testing.assert_frame_equal(got, want, rtol=1e-9, check_dtype=False)


def test_index_of_a_dealt_frame_with_a_struct_as_time(spark):
    bars = odd_panel(spark).withColumn("ts", F.struct((F.col("ts") / 10).cast("int").alias("tens"), F.col("ts").alias("at")))
    want = indicators.adx_full(bars).selectExpr("symbol", "ts.at", "adx", "plus_di").toPandas()
    got = indicators.adx_full(bars, blocks=20).selectExpr("symbol", "ts.at", "adx", "plus_di").toPandas()
    by = ["symbol", "at"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), want.sort_values(by).reset_index(drop=True), rtol=1e-9)


def test_ties_in_time_have_one_order_for_all_passes(spark):
    bars = odd_panel(spark).where("symbol = 'hot'").withColumn("ts", (F.col("ts") / 40).cast("int"))
    once, again = (indicators.adx_full(b, blocks=5).orderBy("note").toPandas() for b in (bars, bars.orderBy(F.desc("note")).repartition(3)))
    pd.testing.assert_frame_equal(once, again)


def on_disk(spark) -> dict[str, int]:
    """Sizes of all shuffle and checkpoint files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = {f.getPath(): f.length() for f in (files.apply(i) for i in range(files.size()))}
    for folder, _, names in os.walk((spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")):
        found |= {f"{folder}/{n}": os.path.getsize(f"{folder}/{n}") for n in names}
    return found


def test_index_in_ranges_writes_its_rows_once(spark):
    n = 60_000
    close = 100 + F.rand(1)
    bars = spark.range(n).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), close.alias("close")).selectExpr("*", "close + rand(2) high", "close - rand(3) low")
    before = on_disk(spark)
    found = indicators.adx_full(bars, blocks=12)
    found.write.format("noop").mode("overwrite").save()
    written = sum(size for f, size in on_disk(spark).items() if f not in before)
    assert n * 20 < written < n * 100  # three shuffles and three checkpoints took some 400 bytes a row
