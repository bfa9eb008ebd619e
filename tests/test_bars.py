"""Edge cases made by hand: upserts, warm-ups, ties, label maps, fallbacks."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasstide.config import Universe
from glasstide.operators import features, indicators, rules, state_model, timeline, validation
from glasstide.plans.demo import demo_model
from glasstide.sources import bars as sources
from glasstide.streaming.upsert import stream_into

START = datetime(2020, 1, 1)
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def series(spark, closes, symbol="A", spread=1.0):
    rows = [(symbol, START + timedelta(days=i), c, None if c is None else c + spread, None if c is None else c - spread, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def wave(n, level=100.0):
    return [level + 10 * math.sin(i / 9) + i * 0.05 for i in range(n)]


def test_last_duplicate_wins_and_may_remove_its_bar(spark):
    raw = spark.createDataFrame(
        [("A", START, 1.0, 1), ("A", START, 2.0, 2), ("B", START, 1.0, 1), ("B", START, None, 2), ("C", START, float("nan"), 1)], "symbol string, ts timestamp, Close double, at int"
    )
    assert [(r.symbol, r.close, r.high) for r in sources.normalize_bars(raw, "at").collect()] == [("A", 2.0, None)]


def test_incoming_bars_win(spark):
    old, new = series(spark, [1.0, 2.0]), series(spark, [9.0])
    assert [r.close for r in sources.merge_bars(old, new).orderBy("ts").collect()] == [9.0, 2.0]
    assert sources.merge_bars(old, new.limit(0)).count() == 2


def test_streamed_upsert(spark, tmp_path):
    import shutil

    path, incoming = str(tmp_path / "bars"), str(tmp_path / "in")
    series(spark, [1.0, 2.0]).write.parquet(path)
    series(spark, [5.0, 6.0, 7.0]).write.parquet(incoming)

    def swap(new, old):
        shutil.rmtree(old)
        shutil.move(new, old)

    stream = spark.readStream.schema(SCHEMA).parquet(incoming)
    query = stream_into(stream, path, str(tmp_path / "checkpoint"), swap).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.close for r in sources.read_bars(spark, path).orderBy("ts").collect()] == [5.0, 6.0, 7.0]


def test_equal_prices_have_no_index_and_no_fit(spark):
    df = series(spark, [50.0] * 60, spread=0.0)
    last = lambda d: d.orderBy(F.desc("ts")).first()
    assert last(indicators.adx(df)).adx is None
    assert last(indicators.reg_slope_r2(df, length=30)).reg_r2 is None
    assert last(indicators.bollinger(df)).bb_percent is None
    assert last(rules.squeeze_state(rules.band_widths(df))).squeeze == "normal"


def test_rank_ties(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, None, 2.0])], "symbol string, ts long, v double")
    got = [r.rank_pct for r in features.trailing_rank_pct(df, "v", 4, 2).orderBy("ts").collect()]
    assert got[0] is None and got[4] is None
    np.testing.assert_allclose([got[i] for i in (1, 2, 3, 5)], [0.5, 2 / 3, 0.625, 2 / 3])


@pytest.mark.parametrize("n,rows,fitted", [(20, 0, False), (21, 1, False), (29, 1, False), (30, 1, True), (60, 1, True)])
def test_short_series_fall_back(spark, n, rows, fitted):
    got = rules.regime_snapshot(series(spark, wave(n))).collect()
    assert len(got) == rows
    if rows:
        assert (got[0].trend_r2 != 0) == fitted
        assert got[0].ema_stack == "mixed" or fitted


def test_history_ends_where_the_snapshot_stands(spark):
    df = series(spark, wave(300)).unionByName(series(spark, wave(280, 20.0), "B", 0.2))
    history = validation.latest_per_symbol(rules.rule_history(df))
    snapshot = rules.regime_snapshot(df)
    assert {(r.symbol, r.regime) for r in history.collect()} == {(r.symbol, r.regime) for r in snapshot.collect()}
    assert rules.rule_history(df).groupBy("symbol").count().collect()[0]["count"] in (271, 251)
    assert all(0 <= r.confidence <= 1 for r in snapshot.collect())


def test_methods_and_types_are_checked(spark):
    df = series(spark, [1.0])
    with pytest.raises(ValueError):
        indicators.atr(df, method="x")
    with pytest.raises(ValueError):
        indicators.keltner(df, ma_type="x")
    with pytest.raises(ValueError):
        sources.load_universe(df, Universe("missing", "A"))


def test_alignment_drops_other_dates(spark):
    calendar = series(spark, [1.0] * 5).where(F.dayofmonth("ts") != 2)
    other = series(spark, [10.0, 20.0, 30.0, 40.0, 50.0], "X").where(F.dayofmonth("ts").isin(2, 3))
    got = features.align_ffill(calendar, other, ["close"]).orderBy("ts").collect()
    assert [r.close for r in got] == [None, 30.0, 30.0, 30.0]


def test_features_begin_after_the_warm_up(spark):
    u = Universe("T", "V", ("S1", "S2"))
    df = series(spark, wave(260), "T").unionByName(series(spark, wave(260, 20.0), "V")).unionByName(series(spark, wave(260, 30.0), "S1")).unionByName(series(spark, wave(59, 30.0), "S2"))
    got = features.feature_matrix(df, u)
    assert got.columns == ["symbol", "ts", *features.FEATURE_NAMES] and got.count() == 8
    assert features.FEATURE_NAMES[0] == "spy_ema21_spread" and features.FEATURE_NAMES[6] == "breadth_ema50"
    scores = state_model.score_history(got, demo_model()).collect()
    for r in scores:
        assert abs(r.risk_on_pct + r.risk_on_retreat_pct + r.risk_off_pct + r.risk_off_stable_pct - 100) <= 0.5
        assert r.transition_risk in {"Low", "Moderate", "Elevated"}


def test_breadth_without_usable_sectors(spark):
    target = series(spark, wave(5), "T")
    assert {r.breadth for r in features.sector_breadth(target, target, ("S",)).collect()} == {0.5}


def test_unknown_state_labels_and_ties(spark):
    model = demo_model()
    for s, label in zip(model.states, ("Strong Risk-On", "Late Risk-Off", "Other", None)):
        s.label = label
    df = spark.createDataFrame([("A", START, 0.4, 0.4, 0.1, 0.1)], "symbol string, ts timestamp, p0 double, p1 double, p2 double, p3 double")
    r = state_model.bucketed(df, model).first()
    assert (r.risk_on_pct, r.risk_off_pct, r.risk_on_retreat_pct, r.risk_off_stable_pct) == (40.0, 40.0, 5.0, 5.0)
    assert r.regime == "Risk-On" and r.transition_risk == "Elevated" and r.confidence == 0.4


def test_model_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "model.json")
    state_model.save_model(demo_model(), path)
    assert state_model.load_model(path) == demo_model()


def test_runs_and_gaps(spark):
    labels = [None, "range", None, "bull", "bull_high_vol", "bear", "bull"]
    rows = [("A", START + timedelta(days=i), x) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, regime string")
    line = timeline.label_timeline(df, df.where("regime is not null"))
    runs = timeline.regime_runs(line).orderBy("run").collect()
    assert [(r.colour, r.bars) for r in runs] == [("neutral", 2), ("risk-on", 2), ("risk-off", 1), ("risk-on", 1)]


def test_reports_refuse_non_finite_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf"))], "a int, b double")
    with pytest.raises(ValueError):
        sources.write_json_report(df, str(tmp_path / "x"))
    sources.write_json_report(df.select("a"), str(tmp_path / "y"))
    assert spark.read.json(str(tmp_path / "y")).count() == 1


def test_later_horizons_have_fewer_returns(spark):
    df = series(spark, wave(200))
    stats = validation.forward_stats(rules.rule_history(df).withColumn("engine", F.lit("rules")), df)
    n = {r.horizon: r.n for r in stats.groupBy("horizon").agg(F.sum("n").alias("n")).collect()}
    assert n[5] > n[21] > n[63]
    assert n[5] == 200 - 29 - 5


def test_close_goes_by_several_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`Adj Close` double, CLOSE double")
    assert df.select(sources.close_column(df)).first()["close"] == 2.0
    assert df.select(sources.close_column(df.select("Adj Close").withColumnRenamed("Adj Close", "other"))).first()["close"] is None


def test_freshness(spark):
    u = Universe("A", "B")
    got = validation.freshness(series(spark, [1.0, 2.0]).unionByName(series(spark, [1.0], "X")), u, "2020-01-07").first()
    assert (got.age_days, got.symbols, got.stale) == (5, 1, True)


def test_partition_count_changes_nothing(spark):
    df = series(spark, wave(120)).unionByName(series(spark, wave(90, 40.0), "B"))
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, rules.rule_history(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_nearness_of_plans(spark):
    """Labels cost three shuffles by symbol at most per streamed pass; no other key is shuffled."""
    plan = rules.rule_history(series(spark, wave(40)))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(symbol" in line for line in exchanges) and len(exchanges) <= 5


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_exact_medians(spark, accuracy):
    """Groups of one to many values, with ties, extremes and nulls; the coarse sketch brackets the middle of the large ones."""
    draw = np.random.default_rng(3)
    groups = {"one": [4.0], "two": [1.0, 4.0], "tied": [2.0] * 50 + [3.0], "halves": [1.0] * 30 + [9.0] * 30, "odd": list(draw.normal(size=3001)), "even": list(draw.exponential(size=4000)), "round": list(draw.integers(0, 9, 5000).astype(float))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    got = {r.g: r.median for r in validation.exact_medians(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", accuracy).collect()}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()}, rel=1e-14)


@pytest.mark.parametrize("cuts", ["beyond", "below", "useless"])
def test_medians_when_the_sketch_misses(spark, monkeypatch, cuts):
    """Cuts on the wrong side, or around everything: counts tell, and the bracket is cut again. One group has no key."""
    wrong = {"beyond": (F.max("v") + 1, F.max("v") + 2), "below": (F.min("v") - 2, F.min("v") - 1), "useless": (F.min("v"), F.max("v"))}[cuts]
    monkeypatch.setattr(validation, "_cuts", lambda met, accuracy: met.groupBy("target").agg(wrong[0].alias("c1"), wrong[1].alias("c2")))
    draw = np.random.default_rng(4)
    groups = {"normal": list(draw.normal(size=901)), "tied": [2.0] * 500 + [3.0] * 500, None: list(draw.exponential(size=300) * 1e9)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    got = {r.g: r.median for r in validation.exact_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", met=100).collect()}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()}, rel=1e-14)


@pytest.mark.parametrize(
    "text,wall",
    [
        ("2020-01-01T10:00:00+05:00", "2020-01-01 10:00:00"), ("2020-01-01 10:00:00-0330", "2020-01-01 10:00:00"), ("2020-01-01T10:00:00Z", "2020-01-01 10:00:00"),
        ("2020-01-01 10:00 UTC", "2020-01-01 10:00:00"), ("2020-01-01T10:00:00.5+01", "2020-01-01 10:00:00.5"), ("2020-01-01", "2020-01-01 00:00:00"), (" 2020-12-31 23:59:59 ", "2020-12-31 23:59:59"),
    ],
)
def test_times_keep_their_wall_time(spark, text, wall):
    raw = spark.createDataFrame([("A", text, 1.0)], "symbol string, TS string, close double")
    assert sources.normalize_bars(raw).select(F.col("ts").cast("string")).first()[0] == wall


def test_a_panel_of_targets_is_as_its_single_ones(spark):
    u = Universe("T", "V", ("S1", "S2"), growth="G")
    df = series(spark, wave(270), "T").unionByName(series(spark, wave(280, 20.0), "V")).unionByName(series(spark, wave(260, 30.0), "S1")).unionByName(series(spark, wave(265, 55.0), "G"))
    panel = features.feature_matrix(df, u, targets=("T", "S1", "G"))
    scans = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans(panel) == scans(features.feature_matrix(df, u))
    got = sorted(map(tuple, panel.collect()))
    single = [r for t in ("T", "S1", "G") for r in map(tuple, features.feature_matrix(df, Universe(t, "V", ("S1", "S2"), growth="G")).collect())]
    assert got == sorted(single) and len({r[0] for r in got}) == 3
    with pytest.raises(ValueError, match="no bars for X"):
        features.feature_matrix(df, u, targets=("T", "X"))


def test_a_fit_needs_rows(spark):
    names = ("a", "b")
    few = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    with pytest.raises(ValueError, match="too few"):
        state_model.fit_state_model(few, k=4, components=2, names=names)


def test_a_fitted_model_is_one(spark):
    """What any fit must be: whole shares, covariances that are, and no less likely than one state for all."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(m, 1, size=(80, 3)) for m in (-6, 0, 6)])
    df = spark.createDataFrame([("A", START + timedelta(days=i), *map(float, v)) for i, v in enumerate(x)], "symbol string, ts timestamp, a double, b double, c double")
    fit = lambda k: state_model.fit_state_model(df, k=k, components=3, names=("a", "b", "c"))

    def likelihood(model):
        log = np.column_stack([c - 0.5 * ((x @ a.T + b) ** 2).sum(axis=1) for a, b, c in model.folded()])
        return float(np.log(np.exp(log - log.max(axis=1, keepdims=True)).mean(axis=1)).sum() + log.max(axis=1).sum())

    model = fit(3)
    p = state_model.posterior(df, model).select("p0", "p1", "p2").toPandas().to_numpy()
    np.testing.assert_allclose(p.sum(axis=1), 1)
    assert all(np.linalg.eigvalsh(np.array(s.cov)).min() > 0 for s in model.states)
    assert likelihood(model) > likelihood(fit(2)) - 5.0  # a fit ends at a local best; three clouds are told no worse by three states
