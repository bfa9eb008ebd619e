"""Stored parts, labels from kept state, and documents."""

import json
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from glasstide.operators import rules
from glasstide.plans import documents
from glasstide.sources import bars as sources
from glasstide.sources import versions
from glasstide.streaming import labels
from glasstide.streaming.upsert import stream_into_months
from tests.test_bars import SCHEMA, series, wave


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{folder}/parts") for f in names if f.endswith(".parquet")}


def days(spark, n, first="2020-01-01", symbol="A", close=1.0):
    start = datetime.fromisoformat(first)
    return spark.createDataFrame([(symbol, start + timedelta(days=i), None, None, None, close, None) for i in range(n)], SCHEMA)


def test_a_day_rewrites_its_month_alone(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.read_months(spark, folder).count() == 0
    assert versions.upsert_months(spark, folder, days(spark, 100)) == ["2020-01", "2020-02", "2020-03", "2020-04"]
    old = files(folder)
    assert versions.upsert_months(spark, folder, days(spark, 1, "2020-02-11", close=9.0), "u1") == ["2020-02"]
    new = {f: t for f, t in files(folder).items() if f not in old}
    assert new and all("month=2020-02" in f for f in new) and {f: files(folder)[f] for f in old} == old
    got = versions.read_months(spark, folder)
    assert (got.count(), [r.close for r in got.where("close <> 1").collect()]) == (100, [9.0])
    assert len(got.where("ts = timestamp'2020-02-11'").collect()) == 1
    # once is enough; no rows change nothing; other months are not read
    assert versions.upsert_months(spark, folder, days(spark, 1, "2020-02-12", close=9.0), "u1") == []
    assert versions.upsert_months(spark, folder, days(spark, 0), "u2") == [] and versions.latest(spark, folder).number == 2
    assert all("month=2020-02" in f for f in versions.read_months(spark, folder, "2020-02", "2020-02").inputFiles())
    versions.drop_versions(spark, folder, 1)
    assert versions.read_months(spark, folder).count() == 100 and not [f for f in files(folder) if "000001/month=2020-02" in f]


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    folder = str(tmp_path)
    versions.upsert_months(spark, folder, days(spark, 3))
    versions.upsert_months(spark, folder, days(spark, 3, close=5.0))
    os.remove(f"{folder}/versions/000000000002/_SUCCESS")
    assert {r.close for r in versions.read_months(spark, folder).collect()} == {1.0}
    versions.upsert_months(spark, folder, days(spark, 3, close=7.0))
    assert {r.close for r in versions.read_months(spark, folder).collect()} == {7.0} and versions.latest(spark, folder).number == 2


def test_streamed_months(spark, tmp_path):
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "bars")
    for i, df in enumerate((days(spark, 40), days(spark, 2, "2020-02-01", close=4.0))):
        df.coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(SCHEMA).parquet(incoming)
        stream_into_months(stream, folder, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert versions.latest(spark, folder).number == i + 1
    assert versions.read_months(spark, folder).where("close = 4").count() == 2 and versions.read_months(spark, folder).count() == 40


def test_batches_give_one_pass(spark, tmp_path):
    """Uneven batches, a symbol that skips some, missing highs across a cut, a late bar, a repeated batch."""
    bars = series(spark, wave(130)).unionByName(series(spark, wave(90, 40.0), "B")).unionByName(series(spark, [50.0] * 45, "flat", 0.0))
    bars = bars.withColumn("high", F.when((F.col("symbol") == "A") & F.dayofyear("ts").between(35, 75), None).otherwise(F.col("high")))
    folder, day = str(tmp_path), F.dayofyear("ts")
    skips = (F.col("symbol") == "B") & day.between(41, 70)
    for i, (a, b) in enumerate(((0, 1), (1, 40), (40, 42), (42, 70), (70, 400))):
        part = bars.where((day > a) & (day <= b) & ~skips) if i < 4 else bars.where((day > a) | skips)
        labels.advance(spark, folder, part, str(i))
    got = spark.read.parquet(f"{folder}/labels").drop("batch")
    want = rules.labelled(bars)
    assert sorted(plain_rows(got, want.columns)) == sorted(plain_rows(want, want.columns))
    number = versions.latest(spark, f"{folder}/state").number
    labels.advance(spark, folder, bars, "4")
    assert versions.latest(spark, f"{folder}/state").number == number
    labels.advance(spark, folder, bars.where((F.col("symbol") == "A") & (day == 50)), "5")
    assert spark.read.parquet(f"{folder}/late/batch=5").count() == 1 and spark.read.parquet(f"{folder}/labels/batch=5").count() == 0
    state = versions.read_parts(spark, f"{folder}/state", labels.state_schema())
    assert {r["symbol"]: r["count"] for r in state.groupBy("symbol").count().collect()} == dict.fromkeys(("A", "B", "flat"), 30)


def plain_rows(df, columns):
    return [tuple(f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect()]


def test_labels_of_a_stream(spark, tmp_path):
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "out")
    bars = series(spark, wave(60))
    for part in (bars.where("dayofyear(ts) <= 35"), bars.where("dayofyear(ts) > 35")):
        part.coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(SCHEMA).parquet(incoming)
        labels.label_stream(stream, folder, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/labels").select("ts", "regime").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rules.labelled(bars).select("ts", "regime").collect()))


def test_documents_are_strict_json(spark, tmp_path):
    doc = spark.createDataFrame([("A", [(1, 2.0), (2, None)])], "symbol string, rows array<struct<n: int, x: double>>")
    documents.write_documents(str(tmp_path), good=doc)
    text = "".join((tmp_path / "good.json" / f).read_text() for f in os.listdir(tmp_path / "good.json") if f.endswith(".json"))
    assert json.loads(text)["rows"][0] == {"n": 1, "x": 2.0}
    assert duckdb.sql(f"SELECT len(rows) FROM read_json('{tmp_path}/good.json/*.json')").fetchall() == [(2,)]
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            documents.write_documents(str(tmp_path), bad=spark.createDataFrame([("A", [(1, bad)])], doc.schema))
    nested = spark.createDataFrame([({"k": [1.0, float("-inf")]},), ({"k": [1.0, None]},), (None,)], "m map<string, array<double>>")
    assert sources.non_finite_rows(nested) == 1 and not os.path.exists(tmp_path / "bad.json")


def test_document_without_labels(spark):
    bars = series(spark, wave(10), "T")
    empty = spark.createDataFrame([], "symbol string, ts timestamp, regime string")
    doc = documents.history_document(empty, empty, bars, "T", "now", 1).first()
    assert (doc.hmm, doc.rule_based, len(doc.spy), doc.as_of) == ([], [], 10, "2020-01-10")
