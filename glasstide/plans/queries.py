"""The registered queries of the bar library and their DuckDB SQL. All numbers are rounded alike on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import log_price, rule_coarse, rule_direction
from ..functions.ranges import RANGE, dealt
from ..functions.storage import kept, shared_folder
from ..operators import features, indicators, rules, state_model, timeline, validation
from ..sources import bars as sources
from ..sources import versions
from ..streaming import labels as label_state
from . import documents, reports
from .demo import BRANDS, UNIVERSE, brand_bars, demo_model, event_bars, flag_bars

NOW = "2002-01-01"
SQL_DAY = "strftime(ts, '%Y-%m-%d %H') AS day"

# ---- SQL building blocks -------------------------------------------------------------------------------------------

_PRICE = "CAST(l_extendedprice / l_quantity AS DOUBLE)"


def _item_bars(symbol: str, source: str = "lineitem") -> str:
    return f"""items AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, {_PRICE} AS p, CAST(l_quantity AS DOUBLE) AS q,
    row_number() OVER (PARTITION BY {symbol}, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o
  FROM {source}
), bars AS (SELECT symbol, ts, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q) AS volume FROM items GROUP BY symbol, ts)"""


FLAG_BARS = _item_bars("l_returnflag || l_linestatus")
BRAND_BARS = _item_bars("p_brand", "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)")
EVENT_BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, o) AS open, max(value) AS high, min(value) AS low, arg_max(value, o) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM events) GROUP BY event_type, date_trunc('hour', ts))"""

_W = "OVER (PARTITION BY symbol ORDER BY ts"


def _step(name: str, source: str, alpha: float) -> str:
    return f"r.{name} * {1 - alpha!r}::DOUBLE + n.{source} * {alpha!r}::DOUBLE"


_MEANS = {"e21": ("close", 2 / 22), "e50": ("close", 2 / 51), "e200": ("close", 2 / 201), "a14": ("tr", 1 / 14), "a20": ("tr", 1 / 20), "p14": ("pdm", 1 / 14), "m14": ("mdm", 1 / 14), "k20": ("close", 2 / 21)}
#: Everything by bar, in steps; what a query does not name is not computed.
STEPS = f""", num AS (
  SELECT *, row_number() {_W}) AS i, lag(close) {_W}) AS pc, high - lag(high) {_W}) AS up, lag(low) {_W}) - low AS dn FROM bars
), moved AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm,
    CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END AS mdm, CASE WHEN close > 0 THEN ln(close) END AS lc FROM num
), rec AS (
  SELECT symbol, i, {", ".join(f"{s} AS {n}" for n, (s, _) in _MEANS.items())} FROM moved WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, {", ".join(_step(n, s, a) for n, (s, a) in _MEANS.items())} FROM rec r JOIN moved n ON n.symbol = r.symbol AND n.i = r.i + 1
), di AS (
  SELECT m.*, e21, e50, e200, a14, a20, k20, 100 * p14 / nullif(a14, 0) AS pdi, 100 * m14 / nullif(a14, 0) AS mdi FROM moved m JOIN rec USING (symbol, i)
), dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di),
rec2 AS (
  SELECT symbol, i, dx AS adx FROM dx WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, CASE WHEN r.adx IS NULL THEN n.dx WHEN n.dx IS NULL THEN r.adx ELSE r.adx * {1 - 1 / 14!r}::DOUBLE + n.dx * {1 / 14!r}::DOUBLE END
  FROM rec2 r JOIN dx n ON n.symbol = r.symbol AND n.i = r.i + 1
), ind AS (SELECT d.*, adx FROM dx d JOIN rec2 USING (symbol, i)),
lines AS (
  SELECT *, CASE WHEN i >= 30 THEN regr_slope(lc, i) {_W} ROWS 29 PRECEDING) END AS b30, CASE WHEN i >= 30 THEN avg(lc) {_W} ROWS 29 PRECEDING) END AS m30,
    CASE WHEN i >= 30 THEN var_pop(lc) {_W} ROWS 29 PRECEDING) * 30 END AS y30,
    CASE WHEN i >= 20 THEN avg(close) {_W} ROWS 19 PRECEDING) END AS bm, CASE WHEN i >= 20 THEN 2 * stddev_samp(close) {_W} ROWS 19 PRECEDING) END AS bs
  FROM ind
), sloped AS (SELECT *, CASE WHEN abs(m30) <> 0 THEN b30 / abs(m30) ELSE b30 END AS slope, 2 * bs / nullif(close, 0) AS bbw, 3.0::DOUBLE * a20 / nullif(close, 0) AS kcw, 100 * a14 / nullif(close, 0) AS atrp FROM lines),
fit AS (
  SELECT *, (2 * slope * b30 * 2247.5 - slope * slope * 2247.5) / nullif(y30, 0) AS r2, (e50 - lag(e50, 20) {_W})) / 20 AS s50,
    CASE WHEN e21 > e50 + close * 0.0015 AND e50 > e200 + close * 0.0015 THEN 'bull' WHEN e21 < e50 - close * 0.0015 AND e50 < e200 - close * 0.0015 THEN 'bear' ELSE 'mixed' END AS stack,
    CASE WHEN atrp < 0.8 THEN 'low' WHEN atrp < 2 THEN 'normal' WHEN atrp < 4 THEN 'high' ELSE 'extreme' END AS vol,
    CASE WHEN adx >= 20 THEN 'trending' ELSE 'choppy' END AS chop, min(bbw) {_W} ROWS 4 PRECEDING) AS bbmin,
    adx - coalesce(lag(adx, 2) {_W}), first_value(adx IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING)) AS adxd
  FROM sloped
), said AS (
  SELECT *, CASE WHEN stack = 'bull' AND slope >= 0 THEN 'up' WHEN stack = 'bear' AND slope <= 0 THEN 'down' WHEN abs(slope) < 0.00015 OR r2 < 0.12 THEN 'flat' WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS trend,
    CASE WHEN s50 > 0.00015 THEN 'up' WHEN s50 < -0.00015 THEN 'down' WHEN s50 IS NOT NULL THEN 'flat' END AS simple,
    CASE WHEN kcw <= 0 THEN 'normal' WHEN bbw / nullif(kcw, 0) < 0.9 THEN 'compressed' WHEN bbw / nullif(kcw, 0) > 1.1 AND bbw > bbmin THEN 'expanding' ELSE 'normal' END AS squeeze,
    CASE WHEN adx IS NULL THEN NULL WHEN adx >= 20 AND adxd > 0 THEN 'trending' WHEN adx < 20 AND adxd > 0 THEN 'coil' ELSE 'choppy' END AS structure
  FROM fit
), named AS (
  SELECT *, CASE WHEN (trend = 'up' OR stack = 'bull') AND vol IN ('high', 'extreme') THEN 'bull_high_vol' WHEN trend = 'up' OR stack = 'bull' THEN 'bull'
      WHEN (trend = 'down' OR stack = 'bear') AND vol IN ('high', 'extreme') THEN 'bear_high_vol' WHEN trend = 'down' OR stack = 'bear' THEN 'bear'
      WHEN vol IN ('high', 'extreme') AND chop = 'trending' THEN 'high_vol' ELSE 'range' END AS regime,
    greatest(0, least(1, (0.6 * least(1, abs(slope) / 0.0003) + 0.4 * CASE WHEN r2 <= 0.12 THEN 0 ELSE least(1, (r2 - 0.12) / 0.88) END
      + CASE vol WHEN 'low' THEN 0.4 WHEN 'normal' THEN 0.7 WHEN 'high' THEN 0.9 ELSE 0.8 END + CASE chop WHEN 'trending' THEN 1.0 ELSE 0.4 END) / 3)) AS conf
  FROM said
), history AS (SELECT symbol, ts, close, i, regime FROM named WHERE slope IS NOT NULL AND r2 IS NOT NULL)"""


def _sql(select: str, bars: str = FLAG_BARS, more: str = "") -> str:
    return f"WITH RECURSIVE {bars}{STEPS}{more} {select}"


def _r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _by_bar(columns: str, **kw) -> str:
    return _sql(f"SELECT symbol, {SQL_DAY}, {columns} FROM named", **kw)


def _out(df: DataFrame, *plain: str, **rounded: int) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd HH").alias("day")
    return df.select("symbol", day, *plain, *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in rounded.items()])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _on_flags(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, sql)(lambda spark, sf_dir: f(flag_bars(spark, sf_dir)))


# ---- indicators ----------------------------------------------------------------------------------------------------

_on_flags("ema", _by_bar(_r("e21", 2, "ema_21")), lambda b: _out(indicators.ema(b, 21), ema_21=2))
_on_flags("emas", _by_bar(", ".join((_r("e21", 2, "ema_short"), _r("e50", 2, "ema_mid"), _r("e200", 2, "ema_long")))), lambda b: _out(indicators.emas(b), ema_short=2, ema_mid=2, ema_long=2))
_on_flags("ema_slope", _by_bar(_r("s50", 4, "ema_slope")), lambda b: _out(indicators.ema_slope(indicators.ema(b, 50), "ema_50", 20), ema_slope=4))
_on_flags("true_range", _by_bar("tr AS true_range"), lambda b: _out(indicators.true_range(b), "true_range"))
_on_flags("atr_wilder", _by_bar(_r("a14", 2, "atr")), lambda b: _out(indicators.atr(b), atr=2))
_on_flags("atr_sma", _by_bar(_r(f"CASE WHEN i >= 14 THEN avg(tr) {_W} ROWS 13 PRECEDING) END", 2, "atr")), lambda b: _out(indicators.atr(b, method="sma"), atr=2))
_on_flags("directional_moves", _by_bar("pdm AS plus_dm, mdm AS minus_dm"), lambda b: _out(indicators.directional_moves(b), "plus_dm", "minus_dm"))
_on_flags("adx", _by_bar(_r("adx", 6, "adx")), lambda b: _out(indicators.adx(b), adx=6))
_on_flags("adx_full", _by_bar(f"{_r('adx', 6, 'adx')}, {_r('pdi', 6, 'plus_di')}, {_r('mdi', 6, 'minus_di')}"), lambda b: _out(indicators.adx_full(b), adx=6, plus_di=6, minus_di=6))
_on_flags(
    "bollinger",
    _by_bar(f"{_r('bm', 2, 'bb_middle')}, {_r('bm + bs', 2, 'bb_upper')}, {_r('bm - bs', 2, 'bb_lower')}, {_r('2 * bs / nullif(bm, 0)', 6, 'bb_bandwidth')}, {_r('CASE WHEN bs <> 0 THEN least(greatest((close - bm + bs) / (2 * bs), 0), 1) END', 6, 'bb_percent')}"),
    lambda b: _out(indicators.bollinger(b), bb_middle=2, bb_upper=2, bb_lower=2, bb_bandwidth=6, bb_percent=6),
)
_on_flags(
    "keltner",
    _by_bar(f"{_r('k20', 2, 'kc_middle')}, {_r('k20 + 2 * a20', 2, 'kc_upper')}, {_r('k20 - 2 * a20', 2, 'kc_lower')}, {_r('4 * a20', 2, 'kc_width')}, {_r('4 * a20 / nullif(k20, 0)', 6, 'kc_bandwidth')}"),
    lambda b: _out(indicators.keltner(b), kc_middle=2, kc_upper=2, kc_lower=2, kc_width=2, kc_bandwidth=6),
)
_on_flags(
    "keltner_sma",
    _by_bar(f"{_r('bm', 2, 'kc_middle')}, {_r('bm + 2 * a20', 2, 'kc_upper')}, {_r('bm - 2 * a20', 2, 'kc_lower')}, {_r('CASE WHEN bm IS NOT NULL THEN 4 * a20 END', 2, 'kc_width')}, {_r('4 * a20 / nullif(bm, 0)', 6, 'kc_bandwidth')}"),
    lambda b: _out(indicators.keltner(b, ma_type="sma"), kc_middle=2, kc_upper=2, kc_lower=2, kc_width=2, kc_bandwidth=6),
)
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _one_series_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as the bars of one symbol, in the order of their keys; label: a regime by return flag."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    label = F.when(F.col("l_returnflag") == "A", "bull").when(F.col("l_returnflag") == "R", "bear").otherwise("range")
    return items.select(
        F.lit("all").alias("symbol"), F.struct(*_KEYS).alias("ts"), price.alias("close"), (price * (1 + F.col("l_discount"))).alias("high"),
        (price * (1 - F.col("l_tax"))).alias("low"), label.alias("regime"),
    )


def _one_series_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, high, low and close of _one_series_bars as a dealt frame. What prices come from is dealt, since it packs better than they do."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    frame = dealt(items.select(*_KEYS, "l_quantity", "l_discount", "l_tax"), _blocks(spark), by=_KEYS)
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    return frame.select(RANGE, F.lit(0).alias("symbol"), *_KEYS, price.alias("close"), (price * (1 + F.col("l_discount"))).alias("high"), (price * (1 - F.col("l_tax"))).alias("low"))


def _blocks(spark: SparkSession) -> int:
    """Ranges that a series is cut into: some for each partition, so that hashing evens them out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _by_item(df: DataFrame, *plain: str, **rounded: int) -> DataFrame:
    return df.select(*[F.col(f"ts.{k}").alias(k) for k in _KEYS], *plain, *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in rounded.items()])


_ORDER_OF_ITEMS = ", ".join(_KEYS)
#: One series in SQL. Recursive means are sums of the last 400 values by weight: those before weigh too little to tell.
_ONE_SERIES = f"""s AS (
  SELECT {_ORDER_OF_ITEMS}, row_number() OVER (ORDER BY {_ORDER_OF_ITEMS}) AS i, {_PRICE} AS close, {_PRICE} * (1 + l_discount) AS high, {_PRICE} * (1 - l_tax) AS low,
    CASE l_returnflag WHEN 'A' THEN 'bull' WHEN 'R' THEN 'bear' ELSE 'range' END AS regime FROM lineitem
), m AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END AS mdm
  FROM (SELECT *, lag(close) OVER (ORDER BY i) AS pc, high - lag(high) OVER (ORDER BY i) AS up, lag(low) OVER (ORDER BY i) - low AS dn FROM s)
)"""


def _weighed(values: str, alpha: float) -> str:
    return f"list_sum(list_transform({values}, lambda v, k: v * power({1 - alpha!r}::DOUBLE, len({values}) - k) * CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END))"


def _listed(**columns: str) -> str:
    return ", ".join(f"list({c}) FILTER (WHERE {c} IS NOT NULL) OVER (ORDER BY i ROWS 399 PRECEDING) AS {n}" for n, c in columns.items())


@_register(
    "ema_one_series",
    f"""WITH {_ONE_SERIES} SELECT {_ORDER_OF_ITEMS}, {_r(_weighed('l', 2 / 22), 2, 'ema_21')} FROM (SELECT *, {_listed(l='close')} FROM s)""",
)
def _ema_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_item(indicators.ema(_one_series_bars(spark, sf_dir), 21, blocks=_blocks(spark)), ema_21=2)


@_register(
    "adx_one_series",
    f"""WITH {_ONE_SERIES}, w AS (SELECT *, {_weighed('lt', 1 / 14)} AS t14, {_weighed('lp', 1 / 14)} AS p14, {_weighed('lm', 1 / 14)} AS m14 FROM (SELECT *, {_listed(lt='tr', lp='pdm', lm='mdm')} FROM m)),
    di AS (SELECT *, 100 * p14 / nullif(t14, 0) AS pdi, 100 * m14 / nullif(t14, 0) AS mdi FROM w), dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)
    SELECT {_ORDER_OF_ITEMS}, {_r(_weighed('ld', 1 / 14), 4, 'adx')}, {_r('pdi', 4, 'plus_di')}, {_r('mdi', 4, 'minus_di')} FROM (SELECT *, {_listed(ld='dx')} FROM dx)""",
)
def _adx_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.adx_full(_one_series_dealt(spark, sf_dir))
    return _by_item(found.withColumn("ts", F.struct(*_KEYS)), adx=4, plus_di=4, minus_di=4)


@_register(
    "keltner_one_series",
    f"""WITH {_ONE_SERIES}, w AS (SELECT *, {_weighed('lt', 1 / 10)} AS a, {_weighed('lc', 2 / 21)} AS k FROM (SELECT *, {_listed(lt='tr', lc='close')} FROM m))
    SELECT {_ORDER_OF_ITEMS}, {_r('k', 2, 'kc_middle')}, {_r('k + 2 * a', 2, 'kc_upper')}, {_r('k - 2 * a', 2, 'kc_lower')}, {_r('4 * a', 2, 'kc_width')}, {_r('4 * a / nullif(k, 0)', 6, 'kc_bandwidth')} FROM w""",
)
def _keltner_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_item(indicators.keltner(_one_series_bars(spark, sf_dir), atr_length=10, blocks=_blocks(spark)), kc_middle=2, kc_upper=2, kc_lower=2, kc_width=2, kc_bandwidth=6)


_OVER30 = "OVER (ORDER BY i ROWS 29 PRECEDING)"


@_register(
    "reg_slope_one_series",
    f"""WITH {_ONE_SERIES}, f AS (SELECT *, CASE WHEN i >= 30 THEN regr_slope(ln(close), i) {_OVER30} END AS b, CASE WHEN i >= 30 THEN abs(avg(ln(close)) {_OVER30}) END AS m, CASE WHEN i >= 30 THEN var_pop(ln(close)) {_OVER30} * 30 END AS y FROM s)
    SELECT {_ORDER_OF_ITEMS}, {_r('b / m', 8, 'reg_slope')}, {_r('(2 * b / m * b - b / m * b / m) * 2247.5 / nullif(y, 0)', 6, 'reg_r2')} FROM f""",
)
def _reg_slope_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_item(indicators.reg_slope_r2(_one_series_bars(spark, sf_dir), length=30, use_log=True, blocks=_blocks(spark)), reg_slope=8, reg_r2=6)


@_register(
    "forward_return_one_series",
    f"""WITH {_ONE_SERIES} SELECT {_ORDER_OF_ITEMS}, {", ".join(_r(f"lead(close, {h}) OVER (ORDER BY i) / nullif(close, 0) - 1", 6, f"fwd_{h}") for h in validation.HORIZONS)} FROM s""",
)
def _forward_return_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_item(validation.forward_return(_one_series_bars(spark, sf_dir), blocks=_blocks(spark)), **{f"fwd_{h}": 6 for h in validation.HORIZONS})


@_register(
    "rank_one_series",
    f"""WITH {_ONE_SERIES}, r AS (SELECT *, list(close) OVER (ORDER BY i ROWS 251 PRECEDING) AS l FROM s)
    SELECT {_ORDER_OF_ITEMS}, {_r("CASE WHEN len(l) >= 60 THEN (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2) / len(l) END", 6, "rank_pct")} FROM r""",
)
def _rank_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_item(features.trailing_rank_pct(_one_series_bars(spark, sf_dir), "close", blocks=_blocks(spark)), rank_pct=6)


@_register(
    "fill_one_series",
    f"""WITH {_ONE_SERIES} SELECT {_ORDER_OF_ITEMS}, last_value(CASE WHEN l_linenumber = 2 THEN regime END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS regime FROM s""",
)
def _fill_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _one_series_bars(spark, sf_dir)
    return _by_item(timeline.label_timeline(bars, bars.where("ts.l_linenumber = 2"), blocks=_blocks(spark)), "regime")


@_register(
    "runs_one_series",
    f"""WITH {_ONE_SERIES}, n AS (SELECT *, CASE WHEN i > 1 AND regime = lag(regime) OVER (ORDER BY i) THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (ORDER BY i) AS run FROM n)
    SELECT CAST(run AS BIGINT) AS run, CASE regime WHEN 'bull' THEN 'risk-on' WHEN 'bear' THEN 'risk-off' ELSE 'neutral' END AS colour, count(*) AS bars,
      arg_min(l_orderkey, i) AS first_order, arg_min(l_linenumber, i) AS first_line, arg_max(l_orderkey, i) AS last_order, arg_max(l_linenumber, i) AS last_line FROM r GROUP BY run, regime""",
)
def _runs_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = timeline.regime_runs(_one_series_bars(spark, sf_dir), blocks=_blocks(spark))
    ends = [F.col(f"{end}.{key}").alias(f"{name}_{what}") for end, name in (("start", "first"), ("end", "last")) for key, what in (("l_orderkey", "order"), ("l_linenumber", "line"))]
    return runs.select("run", "colour", "bars", *ends)


_REG = f"regr_slope(close, i) {_W} ROWS 49 PRECEDING)"
_MEAN50, _VAR50 = f"avg(close) {_W} ROWS 49 PRECEDING)", f"var_pop(close) {_W} ROWS 49 PRECEDING)"
_FIT50 = f", fifty AS (SELECT *, CASE WHEN i >= 50 THEN {_REG} END AS b, CASE WHEN i >= 50 THEN {_MEAN50} END AS m, CASE WHEN i >= 50 THEN {_VAR50} * 50 END AS yy FROM named)"
_on_flags("reg_slope", _sql(f"SELECT symbol, {SQL_DAY}, {_r('b / abs(m)', 6, 'reg_slope')} FROM fifty", more=_FIT50), lambda b: _out(indicators.reg_slope(b), reg_slope=6))
_on_flags(
    "reg_slope_r2",
    _by_bar(f"{_r('slope', 8, 'reg_slope')}, {_r('r2', 6, 'reg_r2')}"),
    lambda b: _out(indicators.reg_slope_r2(b, length=30, use_log=True), reg_slope=8, reg_r2=6),
)
_on_flags(
    "rolling_ols_forecast",
    _sql(f"SELECT symbol, {SQL_DAY}, {_r('m + b * 25.5', 2, 'ols_forecast')}, {_r('CASE WHEN yy IS NOT NULL THEN sqrt(greatest(0, (yy - b * b * 10412.5) / 50)) END', 2, 'ols_std')} FROM fifty", more=_FIT50),
    lambda b: _out(indicators.rolling_ols_forecast(b, length=50), ols_forecast=2, ols_std=2),
)
_on_flags("log_price", _by_bar(_r("lc", 6, "log_close")), lambda b: _out(b.withColumn("log_close", log_price(F.col("close"))), log_close=6))

# ---- rules ---------------------------------------------------------------------------------------------------------

_on_flags("ema_stack", _by_bar("stack AS ema_stack"), lambda b: _out(rules.ema_stack(indicators.emas(b)), "ema_stack"))
_on_flags("trend_label", _by_bar("trend"), lambda b: _out(rules.trend_label(rules.ema_stack(rules.diagnosed(b))), "trend"))
_on_flags("trend_label_simple", _by_bar("simple AS trend_simple"), lambda b: _out(rules.trend_label_simple(b), "trend_simple"))
_on_flags("vol_label", _by_bar(f"{_r('atrp', 6, 'atr_percent')}, vol"), lambda b: _out(rules.vol_label(indicators.atr(b)), "vol", atr_percent=6))
_on_flags(
    "vol_label_pctl",
    _sql(
        f"""SELECT symbol, {SQL_DAY}, {_r("atrp", 6, "atr_percent")}, CASE WHEN share >= 65 THEN 'high' WHEN share <= 25 THEN 'low' ELSE 'normal' END AS vol_pctl
        FROM (SELECT *, 100 * (len(list_filter(l, lambda x: x < atrp)) + (len(list_filter(l, lambda x: x = atrp)) + 1) / 2) / len(l) AS share FROM ranked)""",
        more=f", ranked AS (SELECT *, list(atrp) FILTER (WHERE atrp IS NOT NULL) {_W} ROWS 59 PRECEDING) AS l FROM named)",
    ),
    lambda b: _out(rules.vol_label_pctl(b), "vol_pctl", atr_percent=6),
)
_on_flags("band_widths", _by_bar(f"{_r('bbw', 6, 'bb_width')}, {_r('kcw', 6, 'kc_width')}"), lambda b: _out(rules.band_widths(b), bb_width=6, kc_width=6))
_on_flags("squeeze_state", _by_bar("squeeze"), lambda b: _out(rules.squeeze_state(rules.band_widths(b)), "squeeze"))
_on_flags("chop_label", _by_bar("chop"), lambda b: _out(rules.chop_label(indicators.adx(b)), "chop"))
_on_flags("chop_structure", _by_bar("structure"), lambda b: _out(rules.chop_structure(indicators.adx(b)), "structure"))
_on_flags("composite_regime", _by_bar("regime"), lambda b: _out(rules.labelled(b), "regime"))
_on_flags("confidence", _by_bar(_r("CASE WHEN slope IS NOT NULL AND r2 IS NOT NULL THEN conf END", 6, "confidence")), lambda b: _out(rules.labelled(b), confidence=6))
_on_flags("rule_history", _sql(f"SELECT symbol, {SQL_DAY}, regime FROM history"), lambda b: _out(rules.rule_history(b), "regime"))
_SNAPSHOT = f""", counted AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, min(ts) OVER (PARTITION BY symbol) AS first_ts FROM named),
snap AS (SELECT symbol, strftime(first_ts, '%Y-%m-%d') AS "start", strftime(ts, '%Y-%m-%d') AS "end", regime, conf, trend, slope, r2, stack, vol, atrp, squeeze, chop, adx, structure FROM counted WHERE back = 1)"""
_on_flags(
    "regime_snapshot",
    _sql(f"""SELECT symbol, '1d' AS timeframe, "start", "end", regime, {_r("conf", 6, "confidence")}, trend, {_r("slope", 8, "trend_slope")}, {_r("r2", 6, "trend_r2")}, stack AS ema_stack, vol, {_r("atrp", 6, "atr_percent")}, squeeze, chop, {_r("adx", 6, "adx")}, structure FROM snap""", more=_SNAPSHOT),
    lambda b: rules.regime_snapshot(b).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")} | {c: F.round(c, d) for c, d in (("confidence", 6), ("trend_slope", 8), ("trend_r2", 6), ("atr_percent", 6), ("adx", 6))}),
)
_SHOWN = {"trend_slope": 8, "trend_r2": 6, "atr_percent": 6, "adx": 6}
_on_flags(
    "get_regime",
    _sql(f"""SELECT symbol, regime, {_r("conf", 6, "confidence")}, trend, {_r("slope", 8, "trend_slope")}, {_r("r2", 6, "trend_r2")}, stack AS ema_stack, vol, {_r("atrp", 6, "atr_percent")}, squeeze, chop, {_r("adx", 6, "adx")}, structure FROM snap""", more=_SNAPSHOT),
    lambda b: rules.get_regime(b).select("symbol", "regime", F.round("confidence", 6).alias("confidence"), *[F.round(f"diagnostics.{d}", _SHOWN[d]).alias(d) if d in _SHOWN else F.col(f"diagnostics.{d}") for d in rules.DIAGNOSTICS]),
)
# 25 bars are too few for a regression: trend and stack fall back, slope and r2 are 0.
_SHORT = """, short AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM named), fallen AS (
  SELECT *, CASE WHEN simple = 'up' AND vol IN ('high', 'extreme') THEN 'bull_high_vol' WHEN simple = 'up' THEN 'bull' WHEN simple = 'down' AND vol IN ('high', 'extreme') THEN 'bear_high_vol' WHEN simple = 'down' THEN 'bear'
    WHEN vol IN ('high', 'extreme') AND chop = 'trending' THEN 'high_vol' ELSE 'range' END AS label, (CASE vol WHEN 'low' THEN 0.4 WHEN 'normal' THEN 0.7 WHEN 'high' THEN 0.9 ELSE 0.8 END + CASE chop WHEN 'trending' THEN 1.0 ELSE 0.4 END) / 3 AS c
  FROM short WHERE back = 1)"""
_on_flags(
    "regime_snapshot_short",
    _sql(f"SELECT symbol, label AS regime, {_r('c', 6, 'confidence')}, simple AS trend, 0.0::DOUBLE AS trend_slope, 0.0::DOUBLE AS trend_r2, 'mixed' AS ema_stack, vol, {_r('atrp', 6, 'atr_percent')}, squeeze, chop, {_r('adx', 6, 'adx')}, structure FROM fallen", more=_SHORT,
         bars=FLAG_BARS.replace("bars AS", "all_bars AS") + ", bars AS (SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM all_bars) WHERE n <= 25)"),
    lambda b: rules.regime_snapshot(validation.tail_n(b, 25)).select("symbol", "regime", F.round("confidence", 6).alias("confidence"), *[F.round(d, _SHOWN[d]).alias(d) if d in _SHOWN else F.col(d) for d in rules.DIAGNOSTICS]),
)
_on_flags(
    "summary_line",
    _sql("""SELECT symbol, format('{} 1d {} → {} | Regime: {} (conf={:.2f}) | Trend={} (slope={:.4f}, r2={:.2f}), Vol={}, Chop={}', symbol, "start", "end", regime, conf, trend, slope, r2, vol, chop) AS summary FROM snap""", more=_SNAPSHOT),
    lambda b: rules.summary_line(rules.regime_snapshot(b)),
)
_on_flags(
    "label_maps",
    _sql(f"SELECT symbol, {SQL_DAY}, CASE regime WHEN 'bull' THEN 'Risk-On' WHEN 'bull_high_vol' THEN 'Risk-On (high vol)' WHEN 'bear' THEN 'Risk-Off' WHEN 'bear_high_vol' THEN 'Risk-Off (high vol)' WHEN 'high_vol' THEN 'High Volatility' ELSE 'Range / Neutral' END AS direction, CASE WHEN regime LIKE 'bull%' THEN 'on' WHEN regime LIKE 'bear%' THEN 'off' ELSE 'neutral' END AS reading FROM history"),
    lambda b: _out(rules.rule_history(b).select("symbol", "ts", rule_direction(F.col("regime")).alias("direction"), rule_coarse(F.col("regime")).alias("reading")), "direction", "reading"),
)
_on_flags(
    "slice_window",
    _sql(f"SELECT symbol, {SQL_DAY}, {_r('e21', 2, 'ema_21')} FROM named", bars=FLAG_BARS.replace("bars AS", "all_bars AS") + ", bars AS (SELECT * FROM all_bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31')"),
    lambda b: _out(indicators.ema(sources.slice_window(b, "1997-01-01", "1998-12-31"), 21), ema_21=2),
)

# ---- bars, upserts, windows ----------------------------------------------------------------------------------------

# Prices that are only picked or doubled are the same number on both sides and stay unrounded.
_BARS_OUT = f"SELECT symbol, {SQL_DAY}, open, high, low, close, volume FROM"
_bars_out = lambda df: _out(df, "open", "high", "low", "close", "volume")
_on_flags("item_bars", f"WITH {FLAG_BARS} {_BARS_OUT} bars", _bars_out)
_register("event_bars", f"WITH {EVENT_BARS} {_BARS_OUT} bars")(lambda spark, sf_dir: _bars_out(event_bars(spark, sf_dir)))
_register("brand_bars", f"WITH {BRAND_BARS} {_BARS_OUT} bars")(lambda spark, sf_dir: _bars_out(brand_bars(spark, sf_dir)))


@_register(
    "normalize_bars",
    f"""WITH raw AS (
      SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 5 <> 0 THEN value END AS close, value AS high, event_id AS seq FROM events
    ), last AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS n FROM raw)
    SELECT symbol, {SQL_DAY}, high, close FROM last WHERE n = 1 AND close IS NOT NULL""",
)
def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = events.select(F.col("event_type").alias("Symbol"), F.date_trunc("hour", "ts").alias("TS"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("Close"), F.col("value").alias("HIGH"), "event_id")
    return _out(sources.normalize_bars(raw, "event_id"), "high", "close")


@_register(
    "normalize_offsets",
    f"""WITH raw AS (
      SELECT event_type AS symbol, date_trunc('second', ts) AS ts, value AS close, event_id AS seq FROM events
    ), last AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS n FROM raw)
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, close FROM last WHERE n = 1 AND close IS NOT NULL""",
)
def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text with all kinds of offsets and zones behind them: bars keep the wall time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    behind = F.element_at(F.array(*[F.lit(x) for x in ("", "Z", "+05:00", "-0330", " +01", " UTC", ".000-11:00")]), (F.col("event_id") % 7 + 1).cast("int"))
    between = F.when(F.col("event_id") % 2 == 0, "T").otherwise(" ")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd"), between, F.date_format("ts", "HH:mm:ss"), behind)
    bars = sources.normalize_bars(events.select(F.col("event_type").alias("symbol"), text.alias("ts"), F.col("value").alias("close"), "event_id"), "event_id")
    return bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "close")


_on_flags(
    "merge_bars",
    f"WITH {FLAG_BARS}, later AS (SELECT symbol, ts, open, high, low, close * 2 AS close, volume FROM bars WHERE ts >= TIMESTAMP '1998-01-01'), kept AS (SELECT * FROM bars WHERE ts < TIMESTAMP '1999-01-01') {_BARS_OUT} (SELECT * FROM later UNION ALL SELECT * FROM kept WHERE ts < TIMESTAMP '1998-01-01')",
    lambda b: _bars_out(sources.merge_bars(b.where("ts < timestamp'1999-01-01'"), b.where("ts >= timestamp'1998-01-01'").withColumn("close", F.col("close") * 2))),
)


def _by_month(b: DataFrame) -> DataFrame:
    """As merge_bars, into bars that are stored by month."""
    folder = f"{shared_folder(b.sparkSession)}/months-{uuid.uuid4().hex}"
    versions.upsert_months(b.sparkSession, folder, b.where("ts < timestamp'1999-01-01'"))
    versions.upsert_months(b.sparkSession, folder, b.where("ts >= timestamp'1998-01-01'").withColumn("close", F.col("close") * 2))
    return versions.read_months(b.sparkSession, folder)


_on_flags("merge_bars_by_month", ORACLE_SQL["merge_bars"], lambda b: _bars_out(_by_month(b)))
_on_flags("load_universe", f"WITH {BRAND_BARS} SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN ({', '.join(repr(s) for s in BRANDS.symbols())}) GROUP BY symbol", lambda b: b)
QUERIES["load_universe"] = lambda spark, sf_dir: sources.load_universe(brand_bars(spark, sf_dir), BRANDS).groupBy("symbol").agg(F.count("*").alias("bars"))
_on_flags(
    "history_window",
    _sql(f"SELECT symbol, {SQL_DAY}, regime FROM history WHERE ts >= (SELECT max(ts) FROM bars WHERE symbol = 'NO') - INTERVAL 2 YEAR"),
    lambda b: _out(sources.history_window(rules.rule_history(b), b, "NO", 2), "regime"),
)
_CENTS = "CAST(CAST(close AS VARCHAR) AS DECIMAL(32, 18)) * 100"  # the number's shortest decimal digits; halves go to the even cent
_on_flags(
    "history_closes",
    f"""WITH {FLAG_BARS}, cents AS (SELECT symbol, ts, floor({_CENTS}) AS f, {_CENTS} - floor({_CENTS}) AS rest FROM bars WHERE ts >= (SELECT max(ts) FROM bars WHERE symbol = 'NO') - INTERVAL 2 YEAR)
    SELECT symbol, {SQL_DAY}, CAST(f + CASE WHEN rest > 0.5 OR (rest = 0.5 AND f % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS close FROM cents""",
    lambda b: _out(sources.history_window(b.select("symbol", "ts", "close"), b, "NO", 2), "close"),
)


def _stored(b: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    path = f"{shared_folder(b.sparkSession)}/bars-{uuid.uuid4().hex}"
    write(b, path)
    return read(b.sparkSession, path)


_on_flags("read_bars", f"WITH {FLAG_BARS} {_BARS_OUT} bars", lambda b: _bars_out(_stored(b, lambda df, path: df.write.parquet(path), sources.read_bars)))
_on_flags("write_json_report", f"WITH {FLAG_BARS} {_BARS_OUT} bars", lambda b: _bars_out(_stored(b, sources.write_json_report, lambda spark, path: spark.read.schema(b.schema).json(path))))
def _adjusted(b: DataFrame) -> DataFrame:
    """Closes of bars that have an adjusted close only: as a column pick gives them, and as cleaning does."""
    raw = b.withColumnRenamed("close", "Adj Close")
    return raw.select("symbol", "ts", sources.close_column(raw)).unionByName(sources.normalize_bars(raw).select("symbol", "ts", "close")).distinct()


_on_flags(
    "close_column",
    f"WITH {FLAG_BARS} SELECT symbol, {SQL_DAY}, close FROM bars",
    lambda b: _out(_adjusted(b), "close"),
)
_on_flags("latest_per_symbol", f"WITH {FLAG_BARS} {_BARS_OUT} (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars) WHERE n = 1", lambda b: _bars_out(validation.latest_per_symbol(b)))
_on_flags("tail_n", f"WITH {FLAG_BARS} {_BARS_OUT} (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars) WHERE n <= 60", lambda b: _bars_out(validation.tail_n(b, 60)))
_on_flags(
    "freshness",
    f"WITH {FLAG_BARS} SELECT strftime(a, '%Y-%m-%d') AS as_of, symbols, date_diff('day', a, TIMESTAMP '{NOW}') AS age_days, date_diff('day', a, TIMESTAMP '{NOW}') > 4 AS stale FROM (SELECT max(CASE WHEN symbol = 'NO' THEN ts END) AS a, count(DISTINCT symbol) AS symbols FROM bars)",
    lambda b: validation.freshness(b, UNIVERSE, NOW).withColumns({"as_of": F.date_format("as_of", "yyyy-MM-dd"), "age_days": F.col("age_days").cast("long")}),
)

# ---- panel features ------------------------------------------------------------------------------------------------

_on_flags(
    "align_ffill",
    f"WITH {FLAG_BARS} SELECT symbol, {SQL_DAY}, last_value(v IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT b.symbol, b.ts, x.close AS v FROM bars b LEFT JOIN (SELECT * FROM bars WHERE symbol = 'AF') x ON b.ts = x.ts WHERE b.symbol <> 'AF')",
    lambda b: _out(features.align_ffill(b.where("symbol <> 'AF'"), b.where("symbol = 'AF'"), ["close"]), "close"),
)
_on_flags("ret_n", _by_bar(_r(f"close / nullif(lag(close, 21) {_W}), 0) - 1", 6, "ret")), lambda b: _out(features.ret_n(b, 21), ret=6))
_on_flags("slope_n", _by_bar(_r(f"(close - lag(close, 5) {_W})) / CASE WHEN close = 0 THEN 1e-8 ELSE close END", 6, "slope")), lambda b: _out(features.slope_n(b), slope=6))
_RANK = "CASE WHEN len(l) >= 60 AND v IS NOT NULL THEN (len(list_filter(l, lambda x: x < v)) + (len(list_filter(l, lambda x: x = v)) + 1) / 2) / len(l) END"
_on_flags(
    "trailing_rank_pct",
    f"WITH {FLAG_BARS} SELECT symbol, {SQL_DAY}, {_r(_RANK, 6, 'rank_pct')} FROM (SELECT symbol, ts, close AS v, list(close) FILTER (WHERE close IS NOT NULL) {_W} ROWS 251 PRECEDING) AS l FROM bars)",
    lambda b: _out(features.trailing_rank_pct(b, "close"), rank_pct=6),
)
_on_flags("diff_n", _by_bar(f"coalesce(close - lag(close, 5) {_W}), 0) AS diff"), lambda b: _out(features.diff_n(b, "close", 5), "diff"))


def _in(names) -> str:
    return ", ".join(repr(s) for s in names)


def _breadth_sql(sectors: tuple[str, ...], *targets: str) -> str:
    return f""", above AS (
  SELECT symbol AS sector, ts, CASE WHEN close > e50 THEN 1.0 ELSE 0.0 END AS above FROM named WHERE symbol IN (SELECT symbol FROM bars WHERE symbol IN ({_in(sectors)}) GROUP BY symbol HAVING count(*) >= 60)
), grid AS (
  SELECT c.symbol, c.ts, s.sector, last_value(a.above IGNORE NULLS) OVER (PARTITION BY c.symbol, s.sector ORDER BY c.ts ROWS UNBOUNDED PRECEDING) AS above
  FROM (SELECT symbol, ts FROM bars WHERE symbol IN ({_in(targets)})) c CROSS JOIN (SELECT DISTINCT sector FROM above) s LEFT JOIN above a ON a.ts = c.ts AND a.sector = s.sector
), breadth AS (SELECT symbol, ts, avg(above) AS breadth FROM grid GROUP BY symbol, ts)"""


_on_flags(
    "sector_breadth",
    _sql(f"SELECT symbol, {SQL_DAY}, {_r('breadth', 6, 'breadth')} FROM breadth", more=_breadth_sql(UNIVERSE.sectors, "NO")),
    lambda b: _out(features.sector_breadth(b, b.where("symbol = 'NO'"), UNIVERSE.sectors), breadth=6),
)


def _feature_sql(u, more: str = "", targets: tuple[str, ...] = ()) -> str:
    """matrix: symbol, ts and the 18 features of each target."""
    targets = targets or (u.target,)
    ff = lambda e: f"last_value({e} IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING)"
    part = lambda s, v: f"max(CASE WHEN symbol = '{s}' THEN {v} END)"
    return f"""{_breadth_sql(u.sectors, *targets)}, own AS (
  SELECT symbol, ts, close, close / nullif(lag(close, 21) {_W}), 0) - 1 AS r21, (close - lag(close, 5) {_W})) / CASE WHEN close = 0 THEN 1e-8 ELSE close END AS s5 FROM bars
), wide AS (
  SELECT ts, {part(u.vol_index, "close")} AS vix, {part(u.growth, "r21")} AS growth, {part(u.high_yield, "r21")} AS hyg, {part(u.mid_duration, "r21")} AS ief, {part(u.long_duration, "r21")} AS tlt,
    {part(u.gold, "r21")} AS gold, {part(u.copper, "r21")} AS copper, {part(u.short_rate, "s5")} AS irx, {part(u.long_rate, "close")} - {part(u.short_rate, "close")} AS curve FROM own GROUP BY ts
), cal AS (
  SELECT symbol, ts, close, i, e21, e50, e200, breadth, {ff("vix")} AS vix, {", ".join(f"coalesce({ff(c)}, 0) AS {c}" for c in ("growth", "hyg", "ief", "tlt", "gold", "copper", "irx", "curve"))}
  FROM (SELECT * FROM named WHERE symbol IN ({_in(targets)})) t LEFT JOIN wide USING (ts) LEFT JOIN breadth b USING (symbol, ts)
), base AS (
  SELECT *, list(vix) FILTER (WHERE vix IS NOT NULL) {_W} ROWS 251 PRECEDING) AS l, vix AS v, coalesce(close / nullif(lag(close, 21) {_W}), 0) - 1, 0) AS t21, coalesce(close / nullif(lag(close, 126) {_W}), 0) - 1, 0) AS t126,
    (vix - lag(vix, 10) {_W})) / nullif(10 * vix, 0) AS vs, hyg - ief AS cs FROM cal
), feats AS (
  SELECT symbol, ts, i, (close - e21) / nullif(e21, 0) AS spy_ema21_spread, (close - e50) / nullif(e50, 0) AS spy_ema50_spread, (close - e200) / nullif(e200, 0) AS spy_ema200_spread, growth - t21 AS qqq_spy_rel_21d,
    {_RANK} AS vix_pctl_252d, vs AS vix_slope_10d, breadth AS breadth_ema50, t126 AS spy_return_126d, cs AS credit_spread_21d, tlt AS tlt_return_21d, copper - gold AS copper_gold_21d,
    coalesce(vs - lag(vs, 5) {_W}), 0) AS vix_accel_5d, coalesce(cs - lag(cs, 5) {_W}), 0) AS credit_spread_momentum, coalesce(breadth - lag(breadth, 5) {_W}), 0) AS breadth_acceleration,
    irx AS tsy_3m_yield_slope, 0.0::DOUBLE AS fed_funds_futures_slope, curve AS yield_curve_slope_10y2y, 0.0::DOUBLE AS recession_probability_nyfed
  FROM base
), matrix AS (SELECT * FROM feats WHERE i > 252 AND vix_pctl_252d IS NOT NULL AND vix_slope_10d IS NOT NULL AND breadth_ema50 IS NOT NULL){more}"""


_FEATURES_OUT = f"SELECT symbol, {SQL_DAY}, {', '.join(_r(c, 6, c) for c in features.FEATURE_NAMES)} FROM matrix"
_features_out = lambda df: _out(df, **dict.fromkeys(features.FEATURE_NAMES, 6))
_on_flags("feature_matrix", _sql(_FEATURES_OUT, more=_feature_sql(UNIVERSE)), lambda b: _features_out(features.feature_matrix(b, UNIVERSE)))
_register("feature_matrix_brands", _sql(_FEATURES_OUT, bars=BRAND_BARS, more=_feature_sql(BRANDS)))(lambda spark, sf_dir: _features_out(features.feature_matrix(brand_bars(spark, sf_dir), BRANDS)))

PANEL = ("NO", "AO", "RF")
_on_flags("feature_matrix_panel", _sql(_FEATURES_OUT, more=_feature_sql(UNIVERSE, targets=PANEL)), lambda b: _features_out(features.feature_matrix(b, UNIVERSE, targets=PANEL)))

# ---- state model ---------------------------------------------------------------------------------------------------


def _posterior_sql() -> str:
    model, logs = demo_model(), []
    for a, b, c in model.folded():
        squares = [f"power({' + '.join(f'({float(v)!r})::DOUBLE * {n}' for v, n in zip(row, model.feature_names))} + ({float(o)!r})::DOUBLE, 2)" for row, o in zip(np.asarray(a), b)]
        logs.append(f"({float(c)!r})::DOUBLE - 0.5 * ({' + '.join(squares)})")
    most = "greatest(l0, l1, l2, l3)"
    total = " + ".join(f"exp(l{i} - {most})" for i in range(4))
    return f""", logs AS (SELECT symbol, ts, {", ".join(f"{e} AS l{i}" for i, e in enumerate(logs))} FROM matrix),
post AS (SELECT symbol, ts, {", ".join(f"exp(l{i} - {most}) / ({total}) AS p{i}" for i in range(4))} FROM logs),
scores AS (SELECT symbol, ts, round_even(p0 * 100, 1) AS risk_on_pct, round_even(p2 * 100, 1) AS risk_on_retreat_pct, round_even(p1 * 100, 1) AS risk_off_pct, round_even(p3 * 100, 1) AS risk_off_stable_pct, greatest(p0, p1, p2, p3) AS top FROM post),
scored AS (SELECT *, round_even(risk_on_retreat_pct + risk_off_stable_pct, 1) AS neutral_pct, CASE WHEN top < 0.7 THEN 'Elevated' WHEN top < 0.9 THEN 'Moderate' ELSE 'Low' END AS transition_risk, round_even(top, 3) AS confidence,
  CASE greatest(risk_on_pct, risk_on_retreat_pct, risk_off_pct, risk_off_stable_pct) WHEN risk_on_pct THEN 'Risk-On' WHEN risk_on_retreat_pct THEN 'Risk-On-Retreat' WHEN risk_off_pct THEN 'Risk-Off' ELSE 'Risk-Off-Stable' END AS regime FROM scores)"""


_MODEL_SQL = _feature_sql(UNIVERSE, _posterior_sql())
_PCTS = "risk_on_pct, risk_on_retreat_pct, risk_off_pct, risk_off_stable_pct, neutral_pct"
_on_flags("posterior", _sql(f"SELECT symbol, {SQL_DAY}, {', '.join(_r(f'p{i}', 6, f'p{i}') for i in range(4))} FROM post", more=_MODEL_SQL), lambda b: _out(state_model.posterior(features.feature_matrix(b, UNIVERSE), demo_model()), p0=6, p1=6, p2=6, p3=6))
_scores = lambda b: state_model.score_history(features.feature_matrix(b, UNIVERSE), demo_model())
_on_flags(
    "score_history",
    _sql(f"SELECT symbol, {SQL_DAY}, regime, {_PCTS}, transition_risk, confidence FROM scored", more=_MODEL_SQL),
    lambda b: _out(_scores(b), "regime", *_PCTS.split(", "), "transition_risk", "confidence"),
)


@_register("fit_state_model")
def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = kept(features.feature_matrix(flag_bars(spark, sf_dir), UNIVERSE))
    if matrix.count() < state_model.least_rows(4, 11):  # no model, so no labels
        return _out(state_model.score_history(matrix.limit(0), demo_model()), "regime", "confidence")
    model = state_model.fit_state_model(matrix, labels={0: "Risk-On", 1: "Risk-Off", 2: "Risk-On-Retreat", 3: "Risk-Off-Stable"})
    return _out(state_model.score_history(matrix, model), "regime", "confidence")


_on_flags(
    "model_round_trip",
    _sql(f"SELECT symbol, {SQL_DAY}, regime, confidence FROM scored", more=_MODEL_SQL),
    lambda b: _out(state_model.score_history(features.feature_matrix(b, UNIVERSE), _stored_model(b.sparkSession)), "regime", "confidence"),
)


def _stored_model(spark: SparkSession) -> state_model.StateModel:
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    state_model.save_model(demo_model(), path)
    return state_model.load_model(path)


@_register(
    "fit_state_scaler",
    _sql("SELECT feature, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS deviation FROM (UNPIVOT matrix ON " + ", ".join(features.FEATURE_NAMES) + " INTO NAME feature VALUE v) GROUP BY feature", more=_feature_sql(UNIVERSE)),
)
def _fitted_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fit standardises by: the part of a fitted model that SQL can tell."""
    model = state_model.fit_state_model(kept(features.feature_matrix(flag_bars(spark, sf_dir), UNIVERSE)))
    rows = [(n, float(m), float(d)) for n, m, d in zip(model.feature_names, model.scaler_mean, model.scaler_scale)]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double").select("feature", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "deviation")])


# ---- validation and timelines --------------------------------------------------------------------------------------

_FWD = ", ".join(f"lead(close, {h}) {_W}) / nullif(close, 0) - 1 AS f{h}" for h in validation.HORIZONS)
_on_flags("forward_return", f"WITH {FLAG_BARS} SELECT symbol, {SQL_DAY}, {', '.join(_r(f'f{h}', 6, f'fwd_{h}') for h in validation.HORIZONS)} FROM (SELECT *, {_FWD} FROM bars)", lambda b: _out(validation.forward_return(b), fwd_5=6, fwd_21=6, fwd_63=6))


def _stats_sql(labels: str) -> str:
    return f""", ahead AS (SELECT symbol, ts, {_FWD} FROM bars), tagged AS ({labels}),
long AS (SELECT engine, regime, ts, h AS horizon, CASE h WHEN 5 THEN f5 WHEN 21 THEN f21 ELSE f63 END AS r FROM tagged JOIN ahead USING (symbol, ts), (VALUES (5), (21), (63)) v(h)),
stats AS (SELECT engine, horizon, regime, round_even(avg(r) * 100, 2) + 0.0 AS mean, round_even(median(r) * 100, 2) + 0.0 AS median, round_even(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * 100, 1) AS hit_rate, count(*) AS n,
  strftime(min(ts), '%Y-%m-%d') AS "first", strftime(max(ts), '%Y-%m-%d') AS "last" FROM long WHERE r IS NOT NULL GROUP BY engine, horizon, regime)"""


_RULES = "SELECT 'rules' AS engine, symbol, ts, regime FROM history"
_dated = lambda df: df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})
_on_flags("forward_stats", _sql("SELECT * FROM stats", more=_stats_sql(_RULES)), lambda b: _dated(validation.forward_stats(rules.rule_history(b).withColumn("engine", F.lit("rules")), b)))
_ORDER = "CASE regime " + " ".join(f"WHEN '{r}' THEN {i}" for o in (validation.RULE_ORDER, validation.STATE_ORDER) for i, r in enumerate(o)) + " END AS position"
_on_flags("rule_validation", _sql(f"SELECT *, {_ORDER} FROM stats", more=_stats_sql(_RULES)), lambda b: _dated(reports.rule_validation(b)))
_on_flags(
    "both_validations",
    _sql(f"SELECT *, {_ORDER} FROM stats", more=_MODEL_SQL + _stats_sql("SELECT 'rules' AS engine, symbol, ts, regime FROM history WHERE symbol = 'NO' UNION ALL SELECT 'state', symbol, ts, regime FROM scored")),
    lambda b: _dated(reports.both_validations(b, UNIVERSE, demo_model())),
)
_READ = "CASE WHEN h.regime LIKE 'bull%' THEN 'on' WHEN h.regime LIKE 'bear%' THEN 'off' ELSE 'neutral' END"
_READ2 = "CASE s.regime WHEN 'Risk-On' THEN 'on' WHEN 'Risk-Off' THEN 'off' ELSE 'neutral' END"
_on_flags(
    "engine_agreement",
    _sql(f"SELECT symbol, {SQL_DAY}, {_READ} AS rule_reading, {_READ2} AS state_reading, {_READ} = {_READ2} AS agreement FROM history h JOIN scored s USING (symbol, ts)", more=_MODEL_SQL),
    lambda b: _out(validation.engine_agreement(rules.rule_history(b), _scores(b)), "rule_reading", "state_reading", "agreement"),
)
_on_flags(
    "latest_report",
    _sql(
        f"""SELECT n.symbol, n.regime AS rule_regime, CASE n.regime WHEN 'bull' THEN 'Risk-On' WHEN 'bull_high_vol' THEN 'Risk-On (high vol)' WHEN 'bear' THEN 'Risk-Off' WHEN 'bear_high_vol' THEN 'Risk-Off (high vol)' WHEN 'high_vol' THEN 'High Volatility' ELSE 'Range / Neutral' END AS direction,
        round_even(n.conf, 3) AS rule_confidence, n.trend, n.stack AS ema_stack, n.vol, round_even(n.atrp, 2) AS atr_percent, n.chop, round_even(n.adx, 1) AS adx, s.regime AS state_regime, {_PCTS}, s.transition_risk, s.confidence, strftime(s.ts, '%Y-%m-%d') AS scored_at,
        {_READ.replace("h.", "n.")} = {_READ2} AS agreement, round_even(n.close, 2) AS close, strftime(n.ts, '%Y-%m-%d') AS as_of, (SELECT count(DISTINCT symbol) FROM bars) AS symbols, date_diff('day', n.ts, TIMESTAMP '{NOW}') AS age_days, date_diff('day', n.ts, TIMESTAMP '{NOW}') > 4 AS stale
        FROM (SELECT * FROM named WHERE symbol = 'NO' ORDER BY ts DESC LIMIT 1) n, (SELECT * FROM scored ORDER BY ts DESC LIMIT 1) s""",
        more=_MODEL_SQL,
    ),
    lambda b: reports.latest_report(b, UNIVERSE, demo_model(), NOW).withColumns({"scored_at": F.date_format("scored_at", "yyyy-MM-dd"), "as_of": F.date_format("as_of", "yyyy-MM-dd"), "age_days": F.col("age_days").cast("long")}),
)
_TIMELINE = f""", line AS (SELECT b.symbol, b.ts, last_value(h.regime IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS regime FROM bars b LEFT JOIN (SELECT * FROM history WHERE i % 7 <> 0) h ON b.symbol = h.symbol AND b.ts = h.ts),
coloured AS (SELECT *, CASE WHEN regime LIKE 'bull%' THEN 'risk-on' WHEN regime LIKE 'bear%' THEN 'risk-off' WHEN regime = 'range' THEN 'neutral' WHEN regime = 'high_vol' THEN 'volatile' END AS colour FROM line),
marked AS (SELECT *, CASE WHEN colour IS NOT DISTINCT FROM lag(colour) {_W}) AND row_number() {_W}) > 1 THEN 0 ELSE 1 END AS new FROM coloured),
runs AS (SELECT *, sum(new) {_W}) AS run FROM marked)"""


def _gappy(b: DataFrame) -> DataFrame:
    labels = rules.labelled(b).withColumn("i", F.row_number().over(indicators.bars_in_order())).where("reg_slope is not null and reg_r2 is not null and i % 7 <> 0")
    return timeline.label_timeline(b, labels)


_on_flags("label_timeline", _sql(f"SELECT symbol, {SQL_DAY}, regime FROM line", more=_TIMELINE), lambda b: _out(_gappy(b), "regime"))
_on_flags(
    "regime_runs",
    _sql("""SELECT symbol, CAST(run AS BIGINT) AS run, colour, strftime(min(ts), '%Y-%m-%d') AS "start", strftime(max(ts), '%Y-%m-%d') AS "end", count(*) AS bars FROM runs WHERE colour IS NOT NULL GROUP BY symbol, run, colour""", more=_TIMELINE),
    lambda b: timeline.regime_runs(_gappy(b)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")}),
)
_on_flags("year_marks", f"""WITH {FLAG_BARS} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, strftime(min(ts), '%Y-%m-%d') AS "first" FROM bars GROUP BY symbol, year(ts)""", lambda b: timeline.year_marks(b).withColumn("first", F.date_format("first", "yyyy-MM-dd")))
_on_flags("price_extent", f"WITH {FLAG_BARS} SELECT symbol, min(close) AS low, max(close) AS high FROM bars GROUP BY symbol", timeline.price_extent)

# ---- state between batches -----------------------------------------------------------------------------------------


def _in_batches(b: DataFrame) -> DataFrame:
    """Labels of bars that come in four batches, of which one leaves out a symbol that comes late with the next."""
    spark, folder = b.sparkSession, f"{shared_folder(b.sparkSession)}/labels-{uuid.uuid4().hex}"
    b = kept(b)
    edges = ["1900-01-01", "1995-03-01", "1996-01-01", "1998-06-15", "2100-01-01"]
    for i, (first, end) in enumerate(zip(edges, edges[1:])):
        first = F.when(F.col("symbol") == "AO", F.lit(edges[1] if i == 2 else first)).otherwise(F.lit(first))
        part = b.where((F.col("ts") >= F.to_timestamp(first)) & (F.col("ts") < F.to_timestamp(F.lit(end))))
        label_state.advance(spark, folder, part.where("symbol <> 'AO'") if i == 1 else part, str(i))
    return spark.read.parquet(f"{folder}/labels")


_on_flags(
    "labels_in_batches",
    _by_bar(f"regime, structure, squeeze, {_r('e200', 2, 'ema_long')}, {_r('adx', 6, 'adx')}, {_r('CASE WHEN slope IS NOT NULL AND r2 IS NOT NULL THEN conf END', 6, 'confidence')}"),
    lambda b: _out(_in_batches(b), "regime", "structure", "squeeze", ema_long=2, adx=6, confidence=6),
)

# ---- documents -----------------------------------------------------------------------------------------------------

MADE = "2002-01-01T00:00:00Z"


def _written(b: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A document as it is read back from its file."""
    folder, df = f"{shared_folder(b.sparkSession)}/documents-{uuid.uuid4().hex}", make(kept(b))
    documents.write_documents(folder, **{name: df})
    return b.sparkSession.read.schema(df.schema).json(f"{folder}/{name}.json")


def _latest_document(b: DataFrame) -> DataFrame:
    doc = _written(b, "latest", lambda k: documents.latest_document(reports.latest_report(k, UNIVERSE, demo_model(), NOW), MADE))
    shares = [F.col(f"hmm.probabilities.`{k}`").alias(c) for k, c in documents.PROBABILITIES.items()]
    rules_of = [F.col(f"rule_based.{k}").alias(f"rule_{k}") for k in documents.RULE_KEYS]
    return doc.select("symbol", "as_of", "generated_at", "spy_close", "data_freshness.last_bar", F.col("data_freshness.days_since_last_bar").cast("long").alias("days"), "data_freshness.tickers_loaded", *rules_of, F.col("hmm.regime").alias("state_regime"), "hmm.confidence", "hmm.transition_risk", *shares, "agreement")


_on_flags(
    "document_latest",
    f"""SELECT symbol, as_of, '{MADE}' AS generated_at, close AS spy_close, as_of AS last_bar, age_days AS days, symbols AS tickers_loaded, rule_regime, direction AS rule_direction, rule_confidence, trend AS rule_trend,
      ema_stack AS rule_ema_stack, vol AS rule_vol, atr_percent AS rule_atr_percent, chop AS rule_chop, adx AS rule_adx, state_regime, confidence, transition_risk, {", ".join(documents.PROBABILITIES.values())}, agreement FROM ({ORACLE_SQL["latest_report"]})""",
    _latest_document,
)


def _history_document(b: DataFrame) -> DataFrame:
    doc = _written(b, "history", lambda k: documents.history_document(rules.rule_history(k), _scores(k), k, "NO", MADE, 2))
    label = lambda part: doc.select("symbol", "as_of", F.lit(part).alias("part"), F.posexplode(part).alias("place", "x")).select("symbol", "as_of", "part", "place", "x.date", "x.regime", F.lit(None).cast("double").alias("close"))
    closes = doc.select("symbol", "as_of", F.posexplode("spy").alias("place", "x")).select("symbol", "as_of", F.lit("spy").alias("part"), "place", "x.date", F.lit(None).cast("string").alias("regime"), "x.close")
    return label("hmm").unionByName(label("rule_based")).unionByName(closes)


_SINCE = "ts >= (SELECT max(ts) FROM bars WHERE symbol = 'NO') - INTERVAL 2 YEAR"
_on_flags(
    "document_history",
    _sql(
        f"""SELECT 'NO' AS symbol, (SELECT strftime(max(ts), '%Y-%m-%d') FROM bars WHERE symbol = 'NO') AS as_of, part, CAST(row_number() OVER (PARTITION BY part ORDER BY ts) - 1 AS INTEGER) AS place, strftime(ts, '%Y-%m-%d') AS date, regime, close FROM (
          SELECT 'hmm' AS part, ts, regime, NULL::DOUBLE AS close FROM scored WHERE {_SINCE} UNION ALL SELECT 'rule_based', ts, regime, NULL FROM history WHERE symbol = 'NO' AND {_SINCE}
          UNION ALL SELECT 'spy', ts, NULL, CAST(f + CASE WHEN rest > 0.5 OR (rest = 0.5 AND f % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 FROM (SELECT ts, floor({_CENTS}) AS f, {_CENTS} - floor({_CENTS}) AS rest FROM bars WHERE symbol = 'NO' AND {_SINCE}))""",
        more=_MODEL_SQL,
    ),
    _history_document,
)


def _validation_document(b: DataFrame) -> DataFrame:
    doc = _written(b, "validation", lambda k: documents.validation_document(reports.both_validations(k, UNIVERSE, demo_model()), _scores(k), k, "NO", MADE))
    rows = [
        doc.select("symbol", "as_of", "range.start", "range.end", F.lit(engine).alias("engine"), F.lit(h).alias("horizon"), F.posexplode(f"{engine}.`{h}`").alias("place", "x"))
        for engine in ("hmm", "rule_based") for h in validation.HORIZONS
    ]
    return reduce(DataFrame.unionByName, rows).select("symbol", "as_of", "start", "end", "engine", "horizon", "place", "x.*")


_on_flags(
    "document_validation",
    f"""WITH told AS ({ORACLE_SQL["both_validations"]}), scored_range AS ({_sql("SELECT strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b, (SELECT strftime(max(ts), '%Y-%m-%d') FROM bars WHERE symbol = 'NO') AS as_of FROM scored", more=_MODEL_SQL)})
    SELECT 'NO' AS symbol, as_of, a AS "start", b AS "end", CASE engine WHEN 'state' THEN 'hmm' ELSE 'rule_based' END AS engine, horizon, CAST(row_number() OVER (PARTITION BY engine, horizon ORDER BY position) - 1 AS INTEGER) AS place, regime, mean, median, hit_rate, n FROM told, scored_range""",
    _validation_document,
)
