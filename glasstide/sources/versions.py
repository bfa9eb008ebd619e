"""A table in parts, of which an update rewrites only those it touches.

Under a folder every update writes the parts that it changes to a new place and then, last, a version: a small Spark table that
names the place of each part. A version counts once Spark has marked it as written whole, so readers see all of an update or none of
it, and an update that is repeated after a failure overwrites what the failed one had begun. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import kept
from ..schema import BARS, PRICES
from .bars import merge_bars

_ROWS = "source string, part string, place string"


@dataclass(frozen=True)
class Version:
    """number (0: none yet), the update that wrote it, and where each part lies, relative to the folder."""

    number: int = 0
    source: str = ""
    parts: dict[str, str] = field(default_factory=dict)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reaches; none if it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def latest(spark: SparkSession, folder: str) -> Version:
    """The last version that was written whole."""
    for name in reversed(_listed(spark, f"{folder}/versions")):
        if "_SUCCESS" in _listed(spark, f"{folder}/versions/{name}"):
            rows = spark.read.schema(_ROWS).json(f"{folder}/versions/{name}").collect()  # a row for each part
            return Version(int(name), rows[0]["source"] if rows else "", {r["part"]: r["place"] for r in rows if r["part"] is not None})
    return Version()


def read_parts(spark: SparkSession, folder: str, schema: T.StructType, parts: Callable[[str], bool] | None = None, version: Version | None = None) -> DataFrame:
    """Rows of the last version, of all parts or of those that ``parts`` says; other parts' files are not looked at."""
    found = (version or latest(spark, folder)).parts
    places = [f"{folder}/{place}" for part, place in sorted(found.items()) if parts is None or parts(part)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def write_parts(rows: DataFrame, folder: str, part: str, touched: list[str], before: Version, source: str = "") -> Version:
    """A new version in which the touched parts are made of rows (by column ``part``) and the others stay. A touched part without rows goes."""
    spark, number = rows.sparkSession, before.number + 1
    place = f"parts/{number:012d}"
    dealt = rows.repartitionByRange(part, *[c for c in rows.columns if c in ("symbol", "ts")])
    dealt.write.mode("overwrite").partitionBy(part).parquet(f"{folder}/{place}")
    written = {n.split("=", 1)[1]: f"{place}/{n}" for n in _listed(spark, f"{folder}/{place}") if n.startswith(f"{part}=")}
    parts = {k: v for k, v in before.parts.items() if k not in touched} | written
    named = [(source, k, v) for k, v in sorted(parts.items())] or [(source, None, None)]
    spark.createDataFrame(named, _ROWS).coalesce(1).write.mode("overwrite").json(f"{folder}/versions/{number:012d}")
    return Version(number, source, parts)


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes all but the last ``keep`` versions and the parts that none of those names; returns what went."""
    numbers = [n for n in _listed(spark, f"{folder}/versions") if "_SUCCESS" in _listed(spark, f"{folder}/versions/{n}")]
    wanted = {r["place"] for n in numbers[-keep:] for r in spark.read.schema(_ROWS).json(f"{folder}/versions/{n}").collect()}
    lost = [f"versions/{n}" for n in _listed(spark, f"{folder}/versions") if numbers and n < numbers[-1] and n not in numbers[-keep:]]
    for update in _listed(spark, f"{folder}/parts"):
        if numbers and update <= numbers[-1]:  # a later one may be at work
            own = [f"parts/{update}/{n}" for n in _listed(spark, f"{folder}/parts/{update}")]
            stay = [p for p in own if p in wanted]
            lost += [p for p in own if p not in wanted] if stay else [f"parts/{update}"]
    for name in lost:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return lost


def month_of(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM")


def read_months(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars stored by month, of the months first to last (as 2020-01) only if these are given."""
    return read_parts(spark, folder, BARS, lambda m: (first is None or m >= first) and (last is None or m <= last))


def upsert_months(spark: SparkSession, folder: str, incoming: DataFrame, source: str = "") -> list[str]:
    """Puts clean bars into those stored by month, incoming ones win; returns the months that were rewritten.

    Only these months are read and written. No incoming bars leave all as it is. source names the update: one that the last version
    already bears is not done again. Without ts a bar has no month and is left out.
    """
    before = latest(spark, folder)
    if source and source == before.source:
        return []
    incoming = kept(incoming.select("symbol", "ts", *PRICES).where("ts is not null"))  # read twice
    months = sorted(r["m"] for r in incoming.select(month_of().alias("m")).distinct().collect())
    if months:
        stored = read_parts(spark, folder, BARS, lambda m: m in months, before)
        write_parts(merge_bars(stored, incoming).withColumn("month", month_of()), folder, "month", months, before, source)
    return months
