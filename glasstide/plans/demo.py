"""Inputs of the registered queries: bars from the given tables, a universe of their symbols, a model by rule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Universe
from ..operators.features import FEATURE_NAMES
from ..operators.state_model import State, StateModel
from ..sources.bars import bars_of_events, bars_of_items

UNIVERSE = Universe(target="NO", vol_index="AF", sectors=("AO", "NF", "RF", "RO"))
BRANDS = Universe(
    "Brand#1", "Brand#2", tuple(f"Brand#{i}" for i in range(3, 14)), "Brand#14", "Brand#15", "Brand#16", "Brand#17", "Brand#18", "Brand#19", "Brand#20", "Brand#21"
)
LABELS = {0: "Risk-On", 1: "Risk-Off", 2: "Risk-On-Retreat", 3: "Risk-Off-Stable"}


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items by return flag and line status."""
    return bars_of_items(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.concat("l_returnflag", "l_linestatus"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items by brand."""
    items, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    return bars_of_items(items.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")), F.col("p_brand"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def demo_model(components: int = 5) -> StateModel:
    """A state model whose numbers follow a rule: cosine components over roughly standardised features."""
    n = len(FEATURE_NAMES)
    pcs = [[math.sqrt(2 / n) * math.cos(math.pi * (j + 1) * (i + 0.5) / n) for i in range(n)] for j in range(components)]
    states = []
    for s in range(4):
        mean = [0.8 * math.cos(1.0 + s + 2 * j) for j in range(components)]
        cov = [[(1.0 + 0.25 * s) if i == j else 0.1 / (1 + abs(i - j)) for j in range(components)] for i in range(components)]
        states.append(State(s, LABELS[s], mean, cov))
    return StateModel(list(FEATURE_NAMES), [0.05 * (i % 3) for i in range(n)], [0.5 + 0.1 * (i % 4) for i in range(n)], states, [0.0] * n, pcs, [1.0 / (j + 1) for j in range(components)])
