"""Forward returns by label, agreement of the two engines, and the latest state of each symbol."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Universe
from ..functions.expressions import bars_in_order, ratio, rule_coarse, rule_direction, state_coarse
from ..functions.ranges import over_ranges
from ..functions.storage import kept

HORIZONS = (5, 21, 63)
# The order in which labels are shown.
RULE_ORDER = ("bull", "bull_high_vol", "range", "high_vol", "bear_high_vol", "bear")
STATE_ORDER = ("Risk-On", "Risk-On-Retreat", "Risk-Off", "Risk-Off-Stable")


def forward_return(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, blocks: int | None = None) -> DataFrame:
    """bars with fwd_<h>: the return over the next h bars, null for the last h. blocks cuts series (see ``indicators``)."""
    if blocks:
        return over_ranges(bars, lambda df: forward_return(df, horizons), blocks, ahead=max(horizons))
    w = bars_in_order()
    return bars.withColumns({f"fwd_{h}": ratio(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons})


#: Values of a group that may meet in one window, once its bracket holds no more.
MET = 10_000


def _cuts(met: DataFrame, accuracy: int) -> DataFrame:
    """target, c1, c2: a sketch's guess at values just below and above the wanted rank, of the values inside each target's bracket."""
    share = (F.col("rank") - F.col("before")) / F.col("inside")
    slack = 4.0 / accuracy  # twice what the sketch's ranks may be off on either side
    grid = [i / 1000 for i in range(1001)]
    sketch = met.groupBy("target").agg(F.percentile_approx("v", grid, accuracy).alias("q"), F.first(share).alias("s"))
    at = lambda x: F.element_at("q", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 1000).cast("int") + 1)
    return sketch.select("target", at(F.floor((F.col("s") - slack) * 1000) / 1000).alias("c1"), at(F.ceil((F.col("s") + slack) * 1000) / 1000).alias("c2"))


def exact_medians(df: DataFrame, by: list[str], value: str, accuracy: int = 10_000, met: int = MET) -> DataFrame:
    """by, median of the non-null values of each group, exactly, however large a group is.

    Each wanted rank has a bracket of values that surely holds it, at first the group's whole range. While more than ``met`` values
    lie inside, a sketch guesses two cuts around the rank, values are counted on both sides and between them, and the part whose
    count reaches the rank is the next bracket: a wrong guess costs a round, not the result. What is left is run through in order.
    df is read a few times: let it be kept. A group may have null keys; values that are all null make no group.
    """
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("v")).where("v is not null")
    keys = [f"_k{i}" for i in range(len(by))]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    asked = groups.withColumn("rank", F.explode(ranks)).withColumn("target", F.struct(*keys, "rank"))
    asked = kept(asked.select("target", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), F.lit(False).alias("stuck")))

    def inside(targets: DataFrame) -> DataFrame:
        same = reduce(operator.and_, [rows[k].eqNullSafe(F.col(f"target.{k}")) for k in keys]) if keys else F.lit(True)
        return rows.join(targets, same & F.col("v").between(F.col("lo"), F.col("hi")))

    is_open = "inside > %d and lo < hi" % met
    while asked.where(is_open).limit(1).count():
        still = asked.where(is_open)
        guess = _cuts(inside(still), accuracy)
        half = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
        cut = still.join(guess, "target", "left").withColumns({"c1": F.when(F.col("stuck"), half).otherwise(F.coalesce("c1", half)), "c2": F.when(F.col("stuck"), half).otherwise(F.coalesce("c2", half))})
        low, high = F.col("v") < F.col("c1"), F.col("v") > F.col("c2")
        told = inside(cut).groupBy("target").agg(
            F.count_if(low).alias("n1"), F.max(F.when(low, F.col("v"))).alias("hi1"), F.count_if(~low & ~high).alias("n2"),
            F.min(F.when(~low & ~high, F.col("v"))).alias("lo2"), F.max(F.when(~low & ~high, F.col("v"))).alias("hi2"), F.min(F.when(high, F.col("v"))).alias("lo3"),
        )
        left = F.col("rank") - F.col("before")
        first, second = left <= F.col("n1"), left <= F.col("n1") + F.col("n2")
        pick = lambda a, b, c: F.when(first, a).when(second, b).otherwise(c)
        new = still.withColumnRenamed("inside", "was").join(told, "target").select(
            "target", "rank", pick(F.col("lo"), F.col("lo2"), F.col("lo3")).alias("lo"), pick(F.col("hi1"), F.col("hi2"), F.col("hi")).alias("hi"),
            (F.col("before") + pick(F.lit(0), F.col("n1"), F.col("n1") + F.col("n2"))).alias("before"),
            pick(F.col("n1"), F.col("n2"), F.col("was") - F.col("n1") - F.col("n2")).alias("inside"), "was",
        )
        new = new.withColumn("stuck", F.col("inside") * 2 > F.col("was")).drop("was")  # the next cut halves the range instead
        asked = kept(asked.where(f"not ({is_open})").unionByName(new))

    place = F.row_number().over(Window.partitionBy("target").orderBy("v"))
    few = inside(asked.where("lo < hi")).withColumn("_at", place).where(F.col("_at") == F.col("rank") - F.col("before")).select("target", "v")
    found = few.unionByName(asked.where("lo = hi").select("target", F.col("lo").alias("v")))
    ends = found.groupBy(*[F.col(f"target.{k}").alias(k) for k in keys]).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def forward_stats(labels: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """engine, horizon, regime, mean, median (percent, 2 places), hit_rate (percent, 1 place), n, first, last.

    labels: engine, symbol, ts, regime. Labels without a bar are left out. The median is exact. Returns are computed on all bars
    before labels pick theirs, and kept in the shared checkpoint folder.
    """
    ahead = forward_return(bars.select("symbol", "ts", "close"), horizons)
    joined = labels.select("engine", "symbol", "ts", "regime").join(ahead, ["symbol", "ts"])
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons]))
    long = kept(joined.select("engine", "regime", "ts", pairs.alias("x")).select("engine", "regime", "ts", "x.horizon", "x.r").where("r is not null"))
    by = ["engine", "horizon", "regime"]
    plain = long.groupBy(*by).agg(
        F.bround(F.avg("r") * 100, 2).alias("mean"),
        F.bround(F.avg((F.col("r") > 0).cast("double")) * 100, 1).alias("hit_rate"),
        F.count("*").alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    medians = exact_medians(long, by, "r").select(*by, F.bround(F.col("median") * 100, 2).alias("median"))
    same = reduce(operator.and_, [plain[c].eqNullSafe(medians[c]) for c in by])
    return plain.join(medians, same).select(*[plain[c] for c in by], "mean", "median", "hit_rate", "n", "first", "last")


def order_stats(stats: DataFrame) -> DataFrame:
    """stats with position, the place of each label in its engine's fixed order, sorted by it; other labels go."""
    places = {("rules", r): i for i, r in enumerate(RULE_ORDER)} | {("state", r): i for i, r in enumerate(STATE_ORDER)}
    pairs = F.create_map(*[F.lit(x) for (e, r), i in places.items() for x in (f"{e}:{r}", i)])
    placed = stats.withColumn("position", F.try_element_at(pairs, F.concat_ws(":", "engine", "regime")))
    return placed.where("position is not null").orderBy("engine", "horizon", "position")


def engine_agreement(rule_labels: DataFrame, state_labels: DataFrame) -> DataFrame:
    """symbol, ts, both engines' coarse readings and whether they agree, for bars that both have labelled."""
    rules = rule_labels.select("symbol", "ts", rule_coarse(F.col("regime")).alias("rule_reading"))
    states = state_labels.select("symbol", "ts", state_coarse(F.col("regime")).alias("state_reading"))
    return rules.join(states, ["symbol", "ts"]).withColumn("agreement", F.col("rule_reading") == F.col("state_reading"))


def latest_per_symbol(df: DataFrame) -> DataFrame:
    """The last row of each symbol, without sorting."""
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("row")).select("symbol", "row.*")


def tail_n(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol."""
    back = bars_in_order().orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def freshness(bars: DataFrame, universe: Universe, now: str) -> DataFrame:
    """One row: the target's last bar, whole days from it to ``now``, the number of symbols with bars, and whether it is stale."""
    known = bars.where(F.col("symbol").isin(universe.symbols()))
    last = F.max(F.when(F.col("symbol") == universe.target, F.col("ts")))
    got = known.agg(last.alias("as_of"), F.count_distinct("symbol").alias("symbols"))
    days = F.datediff(F.to_date(F.lit(now)), F.to_date("as_of"))
    return got.select("as_of", "symbols", days.alias("age_days"), (days > 4).alias("stale"))


def latest_report(snapshot: DataFrame, scores: DataFrame, bars: DataFrame, universe: Universe, now: str) -> DataFrame:
    """One row per symbol that both engines know: rule label with direction and rounded diagnostics, state label and
    buckets, their agreement, and the freshness of the bars."""
    rules = snapshot.select(
        "symbol", F.col("regime").alias("rule_regime"), rule_direction(F.col("regime")).alias("direction"), F.bround("confidence", 3).alias("rule_confidence"),
        "trend", "ema_stack", "vol", F.bround("atr_percent", 2).alias("atr_percent"), "chop", F.bround("adx", 1).alias("adx"),
    )
    states = latest_per_symbol(scores).withColumnsRenamed({"regime": "state_regime", "ts": "scored_at"})
    both = rules.join(states, "symbol").withColumn("agreement", rule_coarse(F.col("rule_regime")) == state_coarse(F.col("state_regime")))
    closes = latest_per_symbol(bars.select("symbol", "ts", "close")).select("symbol", F.bround("close", 2).alias("close"))
    fresh = freshness(bars, universe, now).withColumn("symbol", F.lit(universe.target))
    return both.join(closes, "symbol").join(fresh, "symbol", "left")
