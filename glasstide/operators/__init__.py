"""Indicators, panel features, rule labels, state scoring, validation and timelines: DataFrame in, DataFrame out."""
