"""Hard-negative mining by vertical scans (branch and bound on decomposed data).

A block of vectors lies in memory by dimension. An anchor reads dimensions in descending order of its own components' size. After each
few of them every candidate's score is known to lie between what it has so far and what the block's least and greatest values can
still add; candidates that cannot come into an open window any more, or that enough certain ones surpass, leave the candidate
bitmap, and later dimensions are read for what is left. When all dimensions are read, scores are exact.

The same scan answers both questions: the positives are the best rows of one window without ends, the negatives the best
rows of one window for each positive. Anchors meet all rows in blocks: a task holds one block of rows and one block of anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 3, 50, 95
#: What components are multiplied by before they are cut to integers.
FINENESS = 256
#: Dimensions read between two looks at the bounds; rows of a block at most, and at least where there are enough; anchors of a block.
STEP, BLOCK_ROWS, LEAST_ROWS, BLOCK_ANCHORS = 16, 65_536, 1024, 16_384


class Block:
    """Rows by dimension: x (dimensions x rows), ids, labels, and each dimension's least and greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self.x = np.ascontiguousarray(x.T)
        self.least, self.most = self.x.min(axis=1), self.x.max(axis=1)


def best_in_windows(vector: np.ndarray, block: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window low..high the k first of the rows alive with a score inside: their places and scores, by score, then id."""
    order = np.argsort(-np.abs(vector), kind="stable")
    ends = np.sort(vector[order, None] * np.stack([block.least, block.most], axis=1)[order], axis=1)
    rest = np.concatenate([np.cumsum(ends[::-1], axis=0)[::-1], np.zeros((1, 2), ends.dtype)])
    score = np.zeros(len(alive), block.x.dtype)
    for a in range(0, len(order), STEP):
        dims = order[a : a + STEP]
        score = score + vector[dims] @ block.x[np.ix_(dims, alive)]
        least, most = rest[min(a + STEP, len(order))]
        if not len(alive):
            break
        at_least, at_most = score + least, score + most
        keep = np.zeros(len(alive), bool)
        for lo, hi in zip(low, high):
            sure = at_least[(at_least >= lo) & (at_most <= hi)]
            bar = max(lo, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else lo
            keep |= (at_most >= bar) & (at_least <= hi)
        if not keep.all():
            alive, score = alive[keep], score[keep]
    found = []
    for lo, hi in zip(low, high):
        inside = np.flatnonzero((score >= lo) & (score <= hi))
        first = inside[np.lexsort((block.ids[alive[inside]], -score[inside]))[:k]]
        found.append((alive[first], score[first]))
    return found


def _answers(block: Block, anchors: list[tuple], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """anchor_id, positive_id, vec_id, positive_score, score: what one block has for each anchor's windows."""
    rows: list[tuple] = []
    for anchor, label, vector, windows in anchors:
        alive = np.flatnonzero(((block.labels == label) == same) & (block.ids != anchor))
        if not len(alive) or not len(windows):
            continue
        if same:
            low, high = np.array([-np.inf]), np.array([np.inf])
        else:
            scores = np.array([w["score"] for w in windows], np.int64)
            low, high = -(-scores * LOWEST // 100), scores * HIGHEST // 100
        for w, (at, score) in zip(windows, best_in_windows(vector, block, alive, low, high, k)):
            rows += [(anchor, w["positive_id"], int(i), w["score"], int(s)) for i, s in zip(block.ids[at], score)]
    if rows:
        names = ("anchor_id", "positive_id", "vec_id", "positive_score", "score")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(names))


def _answered(batches: Iterator[pa.RecordBatch], kind: type, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """_answers for each group of rows sorted by (row_block, anchor_block)."""
    group, held, anchors = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(c) for c in zip(*held)]
        if anchors and len(rows[0]):  # anchors may meet a block without rows
            yield from _answers(Block(*rows), anchors, same, k)

    for batch in batches:
        if not batch.num_rows:
            continue
        row_block, anchor_block, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
        windows = batch.column(5)
        cut = np.flatnonzero((row_block[1:] != row_block[:-1]) | (anchor_block[1:] != anchor_block[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            if (row_block[a], anchor_block[a]) != group:
                yield from done()
                group, held, anchors = (row_block[a], anchor_block[a]), [], []
            asks = windows.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)
            held.append((ids[a:b][~asks], label[a:b][~asks], x[a:b][~asks]))
            anchors += [(int(ids[i]), label[i], x[i], windows[i].as_py()) for i in (a + np.flatnonzero(asks)).tolist()]
    yield from done()


def _scanned(rows: DataFrame, anchors: DataFrame, n: int, asked: int, kind: type, same: bool, k: int) -> DataFrame:
    """anchor_id, positive_id, vec_id, positive_score, score: the k first rows of all blocks for each window of each anchor."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks, anchor_blocks = max(min(partitions, math.ceil(n / LEAST_ROWS)), math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked / BLOCK_ANCHORS))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    own = ("vec_id", "label", "v")
    kind_of_windows = "array<struct<positive_id: bigint, score: bigint>>"
    left = rows.select(place(row_blocks).alias("row_block"), numbers(anchor_blocks).alias("anchor_block"), *own, F.lit(None).cast(kind_of_windows).alias("windows"))
    right = anchors.select(numbers(row_blocks).alias("row_block"), place(anchor_blocks).alias("anchor_block"), *own, F.col("windows").cast(kind_of_windows).alias("windows"))
    dealt = left.unionByName(right).repartition(max(partitions, row_blocks * anchor_blocks), "row_block", "anchor_block").sortWithinPartitions("row_block", "anchor_block")
    found = dealt.mapInArrow(lambda it: _answered(it, kind, same, k), "anchor_id long, positive_id long, vec_id long, positive_score long, score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding, and any other columns, which are ignored. A row's score is the inner product of its
    components with the anchor's, each floor(256 x); higher scores come first, ties by smaller vec_id. An anchor's positives are its
    first other rows of the same label; for each, the negatives are the first rows of another label whose score is 50 to 95 hundredths
    of the positive's, both ends included.

    Rows without vec_id, label or vector, and with null or non-finite components take no part; zero vectors do. Of rows that share a
    vec_id the one that sorts first by label and vector takes part, so repeated rows count once. Vectors meet those of their own
    length. An anchor without positives and a positive without negatives have no rows; an empty table gives none. Components so large
    that scores would leave 64 bits are refused.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    cut = F.transform(x, lambda c: F.floor(c * FINENESS))
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), cut.alias("v"), is_anchor.alias("asked")).alias("r"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*"))
    size = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(size).alias("size")).orderBy("d").collect()
    parts = []
    for r in lengths:
        if not r["asked"] or not r["d"]:
            continue
        largest = r["d"] * int(r["size"]) ** 2
        if largest * 100 >= 1 << 63:
            raise ValueError(f"components up to {r['size']} of {r['d']} make scores beyond 64 bits")
        kind = np.float64 if largest < 1 << 53 else np.int64  # floats hold such integers exactly, and multiply faster
        own = rows.where(F.size("v") == r["d"]).select("vec_id", "label", "v", "asked")
        anchors = own.where("asked")
        ask = F.array(F.struct(F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("score")))
        found = _scanned(own, anchors.withColumn("windows", ask), r["n"], r["asked"], kind, True, positives)
        windows = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), F.col("score"))).alias("windows"))  # a fixed few
        asking = stored(anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", "windows"))
        parts.append(_scanned(own, asking, r["n"], r["asked"], kind, False, negatives))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
