"""Rule labels of a stream of bars, from state that is kept between batches.

Of each symbol the state holds its last few bars with their recursive means and the rows since each mean's last value. A
batch puts them before its own bars: windows look back at them, means continue from them, and nothing older is read. The state lies in
parts by symbol (see ``sources.versions``); a batch rewrites the parts of its own symbols only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..config import RuleSettings
from ..functions.ewm import Mean, continued_means, gap_of, wilder
from ..functions.ranges import HALO
from ..functions.storage import kept
from ..operators.indicators import with_dx
from ..operators.rules import _SCRATCH, _keltner_width, label_means, label_reach, label_windows, named, shaped
from ..operators.validation import tail_n
from ..schema import BARS, PRICES
from ..sources.bars import normalize_bars
from ..sources.versions import latest, read_parts, write_parts

#: Parts of the state. A symbol's part never changes, so neither may this number for a given folder.
PARTS = 64


def _all_means(cfg: RuleSettings) -> tuple[list[Mean], list[Mean]]:
    return label_means(cfg), [Mean("dx", wilder(cfg.chop.adx_lookback), "adx")]


def state_schema(cfg: RuleSettings = RuleSettings()) -> T.StructType:
    """Bars with their means and gaps."""
    first, second = _all_means(cfg)
    return T.StructType([*BARS.fields, *[T.StructField(c, T.DoubleType()) for m in (*first, *second) for c in (m.name, gap_of(m.name))]])


def label_batch(bars: DataFrame, state: DataFrame, cfg: RuleSettings = RuleSettings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """labels, state, late: labels of the bars that come after those that the state knows, the state of their symbols after them,
    and the bars that do not.

    bars: clean ones (see normalize_bars). labels has the columns of rules.labelled. A late bar (no later than its symbol's last one)
    would change labels that are already out, so it is handed back: put it into the stored bars and label its symbol anew.
    """
    first, second = _all_means(cfg)
    schema = state_schema(cfg)
    bars = bars.select("symbol", "ts", *PRICES).where("symbol is not null and ts is not null")
    ends = state.groupBy("symbol").agg(F.max("ts").alias("_end"))
    met = kept(bars.join(ends, "symbol", "left"))  # read four times
    fresh = met.where("_end is null or ts > _end").drop("_end")
    late = met.where("ts <= _end").drop("_end")
    tail = state.join(fresh.select("symbol").distinct(), "symbol", "left_semi").select(*schema.names).withColumn(HALO, F.lit(True))
    empty = [F.lit(None).cast("double").alias(c) for c in schema.names[len(BARS.names) :]]
    frame = tail.unionByName(fresh.select("*", *empty, F.lit(False).alias(HALO)))
    df = continued_means(label_windows(frame, cfg), first)
    df = kept(continued_means(with_dx(df), second))  # labels and state
    after = tail_n(df.select(*schema.names), label_reach(cfg) + 1)
    gaps = [gap_of(m.name) for m in (*first, *second)]
    labels = named(shaped(_keltner_width(df, cfg.vol).drop(*_SCRATCH, *gaps), cfg).where(f"not {HALO}").drop(HALO, "trend_simple"), cfg)
    return labels, after, late


def _part(symbol: str = "symbol"):
    return F.format_string("%02d", F.pmod(F.crc32(F.col(symbol).cast("binary")), F.lit(PARTS)))


def advance(spark: SparkSession, folder: str, bars: DataFrame, batch: str, cfg: RuleSettings = RuleSettings()) -> None:
    """Labels a batch of clean bars and keeps the state: folder/labels and folder/late get a part batch=<batch>, folder/state a version.

    A batch that is repeated after a failure overwrites what it had begun; one whose state is already the last is not done again.
    """
    before = latest(spark, f"{folder}/state")
    if before.source == batch:
        return
    bars = kept(bars.withColumn("part", _part()))  # read twice
    touched = sorted(r["part"] for r in bars.where("symbol is not null").select("part").distinct().collect())  # PARTS at most
    state = read_parts(spark, f"{folder}/state", state_schema(cfg), lambda p: p in touched, before)
    labels, after, late = label_batch(bars.drop("part"), state, cfg)
    labels.write.mode("overwrite").parquet(f"{folder}/labels/batch={batch}")
    late.write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
    still = state.join(after.select("symbol").distinct(), "symbol", "left_anti")
    write_parts(after.unionByName(still).withColumn("part", _part()), f"{folder}/state", "part", touched, before, batch)


def label_stream(bars: DataFrame, folder: str, checkpoint: str, cfg: RuleSettings = RuleSettings(), clean: Callable[[DataFrame], DataFrame] = normalize_bars) -> DataStreamWriter:
    """A writer that labels a stream of raw bars batch by batch into folder; the caller starts it."""
    spark = bars.sparkSession
    return bars.writeStream.foreachBatch(lambda df, n: advance(spark, folder, clean(df), str(n), cfg)).option("checkpointLocation", checkpoint)
