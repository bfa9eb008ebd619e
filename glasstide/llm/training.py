"""Labelled training rows for the classifiers, all or a bounded, documented sample; never a held-out row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, is_small

#: Labelled rows that a sampled classifier is fitted on, at most; they are chosen by hash, alike at every size.
SAMPLE_ROWS = 20_000
#: Bits (as a power of 2) of the filter of labelled documents, which takes 8 MB at any size of the tables.
FILTER_BITS = 26


def _likely(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """documents without most of those that chosen does not name, by one bit for each hash of a doc_id; those that it names all stay."""
    place: Column = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << FILTER_BITS))
    words = chosen.select(place.alias("place")).groupBy(F.expr("cast(shiftright(place, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def is_set(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return documents.where(is_set(place))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, modulus: int = 3, rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """text, y of the labelled documents outside the held-out fold: of at most ``rows`` of them, or of all if rows is None.

    Labels other than 0 and 1 and rows without doc_id are left out; of several labels of one document the largest counts.
    Labels are broadcast where they are few, by this bound or by their size; otherwise they are shuffled, with the documents that
    a filter of fixed size takes for labelled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus))
    if rows is None:
        chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        learned = documents.select("doc_id", "text").where(~held_out("doc_id", modulus))
        joined = learned.join(F.broadcast(chosen), "doc_id") if is_small(chosen) else _likely(learned, chosen).join(chosen, "doc_id")
        return joined.select("text", "y")
    # A cut by hash first, so that partitions offer about as many rows as are wanted in all.
    share = min(1.0, 1.3 * rows / max(1, known.count()) + 0.01)
    chosen = (
        known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id")
        .limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
