"""The three report documents, nested as JSON readers expect them: the latest state, the recent history, the validation.

Everything before stays flat; nesting happens here, one row per symbol. A document's lists hold what one symbol has within its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validation import HORIZONS
from ..sources.bars import history_window, non_finite_rows

# The keys of the documents.
PROBABILITIES = {"Risk-On": "risk_on_pct", "Risk-On-Retreat": "risk_on_retreat_pct", "Risk-Off": "risk_off_pct", "Risk-Off-Stable": "risk_off_stable_pct"}
RULE_KEYS = {"regime": "rule_regime", "direction": "direction", "confidence": "rule_confidence", "trend": "trend", "ema_stack": "ema_stack", "vol": "vol", "atr_percent": "atr_percent", "chop": "chop", "adx": "adx"}


def _day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _made(generated_at: str) -> Column:
    """Time of making, as ISO text in UTC."""
    return F.lit(generated_at).alias("generated_at")


def latest_document(report: DataFrame, generated_at: str) -> DataFrame:
    """symbol and its latest state, from validation.latest_report(): close, freshness, both engines, agreement."""
    fresh = F.struct(_day("as_of").alias("last_bar"), F.col("age_days").alias("days_since_last_bar"), F.col("symbols").alias("tickers_loaded"))
    rules = F.struct(*[F.col(c).alias(k) for k, c in RULE_KEYS.items()])
    shares = F.struct(*[F.col(c).alias(k) for k, c in PROBABILITIES.items()])
    state = F.struct(F.col("state_regime").alias("regime"), F.col("confidence"), F.col("transition_risk"), shares.alias("probabilities"))
    return report.select(
        "symbol", _day("as_of").alias("as_of"), _made(generated_at), F.col("close").alias("spy_close"), fresh.alias("data_freshness"),
        rules.alias("rule_based"), state.alias("hmm"), "agreement",
    )


def _listed(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """symbol and its rows as a list of structs, oldest first."""
    rows = df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.col("ts"), F.struct(*fields).alias("x")))).alias("rows"))
    return rows.select("symbol", F.transform("rows", lambda r: r["x"]).alias(name))


def history_document(rule_labels: DataFrame, state_labels: DataFrame, bars: DataFrame, target: str, generated_at: str, years: int = 5) -> DataFrame:
    """symbol and the dates, labels of both engines and closes of the target's last ``years`` calendar years."""
    own = bars.where(F.col("symbol") == target).select("symbol", "ts", "close")
    date, regime = _day("ts").alias("date"), F.col("regime")
    recent = lambda df: history_window(df.where(F.col("symbol") == target), own, target, years)
    parts = [
        _listed(recent(state_labels.select("symbol", "ts", "regime")), "hmm", date, regime),
        _listed(recent(rule_labels.select("symbol", "ts", "regime")), "rule_based", date, regime),
        _listed(recent(own), "spy", date, F.col("close")),
    ]
    out = own.groupBy("symbol").agg(_day(F.max("ts")).alias("as_of")).withColumn("generated_at", F.lit(generated_at))
    for part in parts:
        out = out.join(part, "symbol", "left")
    empty = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("hmm", "rule_based", "spy")]
    return out.select("symbol", "as_of", "generated_at", *empty)


def validation_document(stats: DataFrame, state_labels: DataFrame, bars: DataFrame, target: str, generated_at: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """symbol and both engines' forward statistics by horizon, from validation.order_stats(); range: first and last scored date."""
    row = F.struct("position", F.struct("regime", "mean", "median", "hit_rate", "n").alias("x"))
    of = lambda engine, h: F.array_sort(F.collect_list(F.when((F.col("engine") == engine) & (F.col("horizon") == h), row)))
    by_horizon = lambda engine: F.struct(*[F.transform(of(engine, h), lambda r: r["x"]).alias(str(h)) for h in horizons])
    told = stats.groupBy().agg(by_horizon("state").alias("hmm"), by_horizon("rules").alias("rule_based"))
    ends = state_labels.where(F.col("symbol") == target).agg(F.struct(_day(F.min("ts")).alias("start"), _day(F.max("ts")).alias("end")).alias("range"))
    last = bars.where(F.col("symbol") == target).groupBy("symbol").agg(_day(F.max("ts")).alias("as_of"))
    # One row meets one row on either side.
    return last.join(ends).join(told).select("symbol", "as_of", _made(generated_at), F.array(*map(F.lit, horizons)).alias("horizons"), "range", "hmm", "rule_based")


def write_documents(folder: str, **documents: DataFrame) -> None:
    """Each document as JSON under folder/<name>.json; NaN and infinite numbers are refused at any depth, before anything is written."""
    for name, df in documents.items():
        if bad := non_finite_rows(df):
            raise ValueError(f"{bad} rows of {name} hold numbers that JSON cannot")
    for name, df in documents.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.json")
