"""Scalar expressions: window frames over a symbol's bars, safe division, label maps, report rounding."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the labels of both engines mean.
RULE_DIRECTION = {
    "bull": "Risk-On",
    "bull_high_vol": "Risk-On (high vol)",
    "bear": "Risk-Off",
    "bear_high_vol": "Risk-Off (high vol)",
    "high_vol": "High Volatility",
    "range": "Range / Neutral",
}
RULE_COARSE = {"bull": "on", "bull_high_vol": "on", "bear": "off", "bear_high_vol": "off", "range": "neutral", "high_vol": "neutral"}
STATE_COARSE = {"Risk-On": "on", "Risk-Off": "off", "Risk-On-Retreat": "neutral", "Risk-Off-Stable": "neutral"}


def bars_in_order(symbol: str = "symbol", ts: str = "ts") -> WindowSpec:
    return W.partitionBy(symbol).orderBy(ts)


def last_rows(n: int, symbol: str = "symbol", ts: str = "ts") -> WindowSpec:
    """The current bar and the n - 1 before it."""
    return bars_in_order(symbol, ts).rowsBetween(-(n - 1), 0)


def when_full(n: int, counted: Column, value: Column, frame: WindowSpec) -> Column:
    """value where the frame holds n non-null values, else null."""
    return F.when(F.count(counted).over(frame) == n, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def log_price(price: Column) -> Column:
    """Natural log of a positive price, else null."""
    return F.when(price > 0, F.ln(price))


def looked_up(label: Column, names: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, label), default)


def rule_direction(label: Column) -> Column:
    """The direction text of a rule label; an unknown label stays itself."""
    return looked_up(label, RULE_DIRECTION, label)


def rule_coarse(label: Column) -> Column:
    return looked_up(label, RULE_COARSE, F.lit("neutral"))


def state_coarse(label: Column) -> Column:
    return looked_up(label, STATE_COARSE, F.lit("neutral"))


def report_round(value: Column, digits: int) -> Column:
    """Half-even rounding, as reports are rounded."""
    return F.bround(value, digits)
