"""Whole jobs: bars to labels, scores and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RuleSettings, Universe
from ..functions.storage import kept
from ..operators import features, rules, state_model, validation


def rule_validation(bars: DataFrame, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """Forward-return statistics of the rule labels of every symbol, in display order. Bars are computed once and kept."""
    bars = kept(bars)
    labels = rules.rule_history(bars, cfg).withColumn("engine", F.lit("rules"))
    return validation.order_stats(validation.forward_stats(labels, bars))


def both_validations(bars: DataFrame, universe: Universe, model: state_model.StateModel, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """The same for the target by both engines. Bars are computed once and kept."""
    bars = kept(bars)
    target = bars.where(F.col("symbol") == universe.target)
    ruled = rules.rule_history(target, cfg).select(F.lit("rules").alias("engine"), "symbol", "ts", "regime")
    scored = state_model.score_history(features.feature_matrix(bars, universe, keep=False), model).select(F.lit("state").alias("engine"), "symbol", "ts", "regime")
    return validation.order_stats(validation.forward_stats(ruled.unionByName(scored), target))


def latest_report(bars: DataFrame, universe: Universe, model: state_model.StateModel, now: str, cfg: RuleSettings = RuleSettings()) -> DataFrame:
    """The latest state of each symbol that both engines know. Bars are computed once and kept for the four branches that read them."""
    bars = kept(bars)
    scores = state_model.score_history(features.feature_matrix(bars, universe, keep=False), model)
    return validation.latest_report(rules.regime_snapshot(bars, cfg), scores, bars, universe, now)
