"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned by iterative quantisation on a bounded sample. A code is split
into substrings and every substring is indexed by its value. By the pigeonhole principle a code within the radius agrees with
the query's in some substring up to that substring's share of the radius: rows are read from those buckets, their codes checked
against the whole radius, and what is left is ranked by the exact cosine of the original vectors. Floats are multiplied for these
alone. Where a batch's buckets list more rows than the block holds, its codes are scanned instead, which finds the same rows.

The stated queries meet all rows in blocks: each task indexes one block of rows and answers one block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ragged

#: Rows that rotations and radius are fitted on, at most; every row is indexed.
SAMPLE_ROWS = 4096
#: Bits of a code and of a substring; rounds of rotation learning.
BITS, SUBSTRING, ROUNDS = 256, 16, 15
#: Share of the sample's true neighbours that the radius takes in.
COVERED = 0.995
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 16_384
#: Queries that a task compares with its rows at a time, and pairs of vectors that it multiplies at a time.
QUERY_BATCH, PAIR_BATCH = 64, 1 << 15


def usable(vector: Column) -> Column:
    """True for vectors with components, none of them null or non-finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


class Codes:
    """Rotations (bits x dimensions) and the Hamming radius."""

    def __init__(self, rotation: np.ndarray, radius: int):
        self.rotation, self.radius = rotation, radius

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings: rows x substrings."""
        signs = (x @ self.rotation.T) > 0
        return np.packbits(signs, axis=1).view(np.uint16)


def _quantised(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A rotation that brings x near the corners of the cube, by alternating signs and Procrustes steps."""
    r = start
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return r


def fit_codes(x: np.ndarray, k: int, bits: int = BITS) -> Codes:
    """Codes for unit vectors x, which are the bounded sample."""
    d = x.shape[1]
    draw, parts = np.random.default_rng(9), []
    for _ in range(math.ceil(bits / d)):
        start, _ = np.linalg.qr(draw.normal(size=(d, d)))
        parts.append(_quantised(x, start).T)
    codes = Codes(np.concatenate(parts)[:bits], bits)
    if len(x) > k + 1:
        queries = x[:: max(1, len(x) // 256)]
        cosine = queries @ x.T
        cosine[np.arange(len(queries)), np.arange(0, len(x), max(1, len(x) // 256))] = -2
        near = np.argpartition(-cosine, k, axis=1)[:, :k]
        code = codes.encode(x)
        own = codes.encode(queries)
        distance = np.bitwise_count(own[:, None, :] ^ code[near]).sum(axis=2)
        codes.radius = int(np.quantile(distance, COVERED, method="higher"))
    return codes


class Index:
    """A block of codes: by substring, each distinct value's rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64) if codes.shape[1] % 4 == 0 else codes
        self.buckets = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, size = np.unique(codes[:, s], return_counts=True)
            self.buckets.append((values, np.cumsum(size) - size, size, order))

    def shares(self, radius: int) -> list[int]:
        """Distances of which one substring must keep its own if the whole is within the radius: they sum to radius - substrings + 1."""
        n = len(self.buckets)
        each, more = divmod(radius + 1, n)
        return [each if s < more else each - 1 for s in range(n)]

    def near(self, queries: np.ndarray, radius: int) -> list[np.ndarray]:
        """By substring, queries x values: whether the value is within the substring's share."""
        return [np.bitwise_count(queries[:, s, None] ^ b[0][None, :]) <= share for s, (b, share) in enumerate(zip(self.buckets, self.shares(radius)))]

    def listed(self, near: list[np.ndarray]) -> int:
        """Rows in all probed buckets of all queries."""
        return int(sum((n @ b[2].astype(np.float64)).sum() for n, b in zip(near, self.buckets)))

    def distance(self, queries: np.ndarray) -> np.ndarray:
        """Hamming distances, queries x rows."""
        own = np.ascontiguousarray(queries).view(self.words.dtype)
        out = np.zeros((len(own), len(self.words)), np.uint16)
        for w in range(own.shape[1]):
            out += np.bitwise_count(own[:, w, None] ^ self.words[None, :, w])
        return out

    def probed(self, queries: np.ndarray, near: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """query, row of all codes within the radius, read from the buckets."""
        found = []
        for hit, (_, first, size, order) in zip(near, self.buckets):
            q, v = np.nonzero(hit)
            found.append(np.repeat(q, size[v]) * len(self.codes) + order[ragged(first[v], size[v])])
        q, row = np.divmod(np.unique(np.concatenate(found)), len(self.codes))
        own = np.ascontiguousarray(queries).view(self.words.dtype)
        keep = np.bitwise_count(own[q] ^ self.words[row]).sum(axis=1) <= radius
        return q[keep], row[keep]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """query, row of all codes within the radius, from the buckets, or by a scan where the buckets list more rows; a scan's distances."""
        if min(self.shares(radius)) < self.codes.itemsize * 8 // 4:
            near = self.near(queries, radius)
            if self.listed(near) < len(queries) * len(self.codes) // 4:
                return *self.probed(queries, near, radius), None
        distance = self.distance(queries)
        return *np.nonzero(distance <= radius), distance


def _answers(qid: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score: the k nearest rows of one block for each query of one block."""
    if not len(qid) or not len(ids):
        return
    unit = lambda v: v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    index = Index(codes.encode(unit(x)))
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    for a in range(0, len(qid), QUERY_BATCH):
        q, own = queries[a : a + QUERY_BATCH], qid[a : a + QUERY_BATCH]
        code = codes.encode(unit(q))
        i, j, distance = index.within(code, codes.radius)
        other = own[i] != ids[j]
        i, j = i[other], j[other]
        few = np.flatnonzero(np.bincount(i, minlength=len(own)) < min(k, len(ids)))
        if len(few):  # too few within the radius: it grows to the k-th nearest code's distance in this block, all ties included
            far = (index.distance(code[few]) if distance is None else distance[few]).astype(np.int64)
            far[own[few][:, None] == ids[None, :]] = 1 << 30
            last = min(k, len(ids)) - 1
            most = np.partition(far, last, axis=1)[:, last]
            wide, row = np.nonzero(far <= np.minimum(most, (1 << 30) - 1)[:, None])
            stay = ~np.isin(i, few)
            i, j = np.concatenate([i[stay], few[wide]]), np.concatenate([j[stay], row])
        score = np.empty(len(i))
        for b in range(0, len(i), PAIR_BATCH):
            ib, jb = i[b : b + PAIR_BATCH], j[b : b + PAIR_BATCH]
            score[b : b + PAIR_BATCH] = np.einsum("ij,ij->i", q[ib], x[jb]) / (np.sqrt(np.einsum("ij,ij->i", q, q))[ib] * norms[jb])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(own)))
        top = np.arange(len(i)) - first[i] < k
        yield pa.RecordBatch.from_arrays([pa.array(own[i[top]]), pa.array(ids[j[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"])


def _answered(batches: Iterator[pa.RecordBatch], codes: Codes, k: int) -> Iterator[pa.RecordBatch]:
    """_answers for each group of rows sorted by (row_block, query_block)."""
    group, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            is_query, ids, x = (np.concatenate(c) for c in zip(*held))
            yield from _answers(ids[is_query], x[is_query], ids[~is_query], x[~is_query], codes, k)

    for batch in batches:
        if not batch.num_rows:
            continue
        row_block, query_block, is_query, ids = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(4))
        x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        cut = np.flatnonzero((row_block[1:] != row_block[:-1]) | (query_block[1:] != query_block[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(ids)]):
            if (row_block[a], query_block[a]) != group:
                yield from done()
                group, held = (row_block[a], query_block[a]), []
            held.append((is_query[a:b].astype(bool), ids[a:b], x[a:b]))
    yield from done()


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, by cosine; ties to the smaller vec_id.

    vectors: vec_id, embedding, and any other columns, which are ignored. Rows that usable() refuses and rows without vec_id take
    no part; vectors meet those of their own length. Equal vectors are candidates through their k + 1 smallest ids, which loses no
    answer, and repeated rows count once. A row is no candidate of its own id; repeated query ids are answered once, for the vector
    that sorts first. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asked"))
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("queries")).orderBy("d").collect()
    parts = [_nearest_of_length(good.where(F.size("embedding") == r["d"]), r["n"], r["queries"], k, bits) for r in lengths if r["queries"]]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(good: DataFrame, n: int, asked: int, k: int, bits: int) -> DataFrame:
    """query_id, vec_id, score: of vectors of one length, each block's k nearest rows for each query."""
    sample = np.array([r["embedding"] for r in good.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE_ROWS).collect()])
    codes = fit_codes(sample / np.linalg.norm(sample, axis=1, keepdims=True), k, bits)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    plain = good.select("vec_id", "embedding").distinct()
    candidates = plain.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    queries = good.where("asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    partitions = int(good.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks, query_blocks = max(partitions, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = candidates.select(F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("row_block"), numbers(query_blocks).alias("query_block"), F.lit(False).alias("q"), "vec_id", "embedding")
    right = queries.select(numbers(row_blocks).alias("row_block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), F.lit(True).alias("q"), "vec_id", "embedding")
    dealt = left.unionByName(right).repartition(max(partitions, row_blocks * query_blocks), "row_block", "query_block").sortWithinPartitions("row_block", "query_block")
    return dealt.mapInArrow(lambda it: _answered(it, codes, k), "query_id long, vec_id long, score double")
