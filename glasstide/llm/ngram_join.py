"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set comparison decides.

Every document is a set of word shingles; documents with one set form a class and travel as one row. A class's signature
is cut into trees. A tree is a prefix trie kept as its sorted paths. Paths that share the prefix with which two sets at the threshold
meet in some tree with the target recall are one group, whole on one task; only a group of more than a fixed number of paths is dealt in
pieces, and every two pieces meet. In a group each path meets its sorted neighbours, the one next to it first: matched prefixes only
get shorter, down to the group's own. Two paths that hang together already need not meet; all others do, and are tied
unless their signatures refute a similarity at the threshold, which they do for strangers. So what a group holds together does
not depend on how paths are dealt, and no pair at the threshold is left apart for the number of strangers between. What hangs
together by ties is compared exactly, in blocks of bounded size. Inside such a cluster every pair is compared, however the forest
found it, and only sums per class leave a task: neither groups nor clusters are ever spelt out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, binaries, chunks, mix, random_numbers, text_buffers, whole_windows, window_hashes
from .common import bounded_broadcast, cut, spare
from .components import components

#: Words of a shingle, least similarity, trees of the forest, length of a tree's full path, target recall.
SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 32, 10, 0.9999
#: Standard deviations that the estimate of a pair at the threshold may fall short by before the pair is refuted.
DOUBT = 4.5
#: Paths of a group that one task takes; sorted neighbours met for all groups at a time, before open groups are gone through one by one.
PIECE, LAGS = 50_000, 64
#: Shingles and classes of a block of exact comparison.
BLOCK_SHINGLES, BLOCK_CLASSES = 400_000, 250


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix under which two sets at the threshold meet in some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their numbers. Fewer words make one shingle."""
    words = Words(raw, offsets)
    hashed, n = words.hashes(), len(offsets) - 1
    doc = words.doc()
    grams = window_hashes(hashed, size)
    keep = np.flatnonzero(whole_windows(words.first, size)[: len(grams)])
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    whole = np.zeros(len(short), np.uint64)
    with np.errstate(over="ignore"):
        for i, d in enumerate(short):
            for w in hashed[words.first[d] : words.first[d + 1]]:
                whole[i] = mix(whole[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + w)[0]
    d, g = np.concatenate([doc[keep], short]), np.concatenate([grams[keep], whole])
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
    return g[new], np.bincount(d[new], minlength=n)


def signatures(sets: np.ndarray, count: np.ndarray, symbols: int) -> np.ndarray:
    """The low 16 bits of the least hash of each set under each of ``symbols`` hash functions; empty sets get zeros."""
    out = np.zeros((len(count), symbols), np.uint16)
    has = count > 0
    if not has.any():
        return out
    small = (sets >> np.uint64(20)).astype(np.uint32)
    starts = (np.cumsum(count) - count)[has]
    by, plus = random_numbers(symbols, 31).astype(np.uint32) | np.uint32(1), random_numbers(symbols, 32).astype(np.uint32)
    with np.errstate(over="ignore"):
        for j in range(symbols):
            hashed = small * by[j]
            hashed += plus[j]
            hashed ^= hashed >> np.uint32(15)
            out[has, j] = np.minimum.reduceat(hashed, starts)
    return out


def judged_bits(signed: np.ndarray) -> np.ndarray:
    """Two bits of each symbol, in whole 64-bit words: rows x bytes."""
    wide = np.zeros((len(signed), -(-signed.shape[1] // 32) * 32), np.uint8)
    wide[:, : signed.shape[1]] = signed.astype(np.uint8) & 3
    return wide[:, 0::4] | wide[:, 1::4] << 2 | wide[:, 2::4] << 4 | wide[:, 3::4] << 6


def most_unequal(threshold: float, symbols: int) -> int:
    """How many of the two-bit symbols of two sets at the threshold may differ: DOUBT deviations more than they do on average."""
    equal = threshold + (1 - threshold) / 4
    return math.floor(symbols * (1 - equal) + DOUBT * math.sqrt(symbols * equal * (1 - equal)))


def _signed(batches: Iterator[pa.RecordBatch], size: int, symbols: int) -> Iterator[pa.RecordBatch]:
    """doc_id, at, mark, a, b (128 bits that stand for the set), n, signature, bits (two of each symbol)."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(3))
        for first, last, part, at in chunks(raw, offsets):
            sets, count = shingles(part, at, size)
            ends = np.cumsum(count)
            with np.errstate(over="ignore"):
                total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(k)))]) for k in (1, 2)]
                a, b = (np.where(count > 0, t[ends] - t[ends - count], 0).astype(np.uint64).view(np.int64) for t in total)
            signed = signatures(sets, count, symbols)
            kept = [binaries(x.ravel(), np.full(len(count), x.shape[1])) for x in (signed.byteswap(), judged_bits(signed))]  # paths sort by their bytes
            columns = [*(batch.column(k).slice(first, last - first) for k in (0, 1, 2)), pa.array(a), pa.array(b), pa.array(count.astype(np.int32)), *kept]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "mark", "a", "b", "n", "signature", "bits"])


def _unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many two-bit symbols rows differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1)


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least row that it hangs together with) after the rows a and b are tied."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def held_together(group: np.ndarray, bits: np.ndarray, most: int, lags: int = LAGS) -> np.ndarray:
    """For rows sorted by group and path the least row that each hangs together with, over all pairs of a group that are not refuted."""
    label = np.arange(len(group))
    rows = label
    for lag in range(1, lags + 1):
        rows = rows[rows >= lag]
        rows = rows[group[rows] == group[rows - lag]]
        if not len(rows):
            return label
        apart = rows[label[rows] != label[rows - lag]]
        near = apart[_unequal(bits[apart], bits[apart - lag]) <= most]
        label = _united(label, near, near - lag)
    for g in np.unique(group[rows]):  # long groups: what is not in the largest part meets all that it does not hang together with
        first, last = np.searchsorted(group, [g, g + 1])
        own = label[first:last]
        parts, size = np.unique(own, return_counts=True)
        for r in first + np.flatnonzero(own != parts[np.argmax(size)]) if len(parts) > 1 else ():
            others = first + np.flatnonzero(label[first:last] != label[r])
            near = others[_unequal(bits[others], bits[r]) <= most]
            if len(near):
                label = _united(label, near, np.full(len(near), r))
    return label


def _tied(batches: Iterator[pa.RecordBatch], prefix: int, most: int) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) of rows (lower, upper, path, node, bits) sorted so: each row of a group to the least node that it hangs together with."""
    held: list[tuple] = []

    def told(rows: tuple) -> pa.RecordBatch:
        key, node, bits = rows
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        label = held_together(group, bits, most)
        low = node.copy()
        np.minimum.at(low, label, node)
        low = low[label]
        return pa.RecordBatch.from_arrays([pa.array(low[low != node]), pa.array(node[low != node])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        paths, bits = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 4))
        pieces = np.stack([batch.column(k).to_numpy().astype(np.int32) for k in (0, 1)], axis=1).view(np.uint8)
        key = np.ascontiguousarray(np.concatenate([pieces, paths[:, :prefix]], axis=1)).view(f"V{8 + prefix}").ravel()
        held.append((key, batch.column(3).to_numpy(), np.ascontiguousarray(bits).view(np.uint64)))
        if key[0] == key[-1] and (len(held) == 1 or held[-2][0][-1] == key[0]):
            continue  # one group goes on
        rows = tuple(np.concatenate(x) for x in zip(*held))
        whole = int(np.flatnonzero(rows[0] != rows[0][-1:])[-1]) + 1
        yield told(tuple(x[:whole] for x in rows))
        held = [tuple(x[whole:] for x in rows)]
    if held:
        yield told(tuple(np.concatenate(x) for x in zip(*held)))


def _spelt(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """a, b, copies, cluster, blocks, block, sets: the shingles of the class's text; other texts found at its place are left out."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(6))
        a, b = (np.asarray(batch.column(k).to_numpy()) for k in (0, 1))
        for first, last, part, at in chunks(raw, offsets):
            sets, count = shingles(part, at, size)
            ends = np.cumsum(count)
            with np.errstate(over="ignore"):
                total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(k)))]) for k in (1, 2)]
                same = [(t[ends] - t[ends - count]).view(np.int64) == own[first:last] for t, own in zip(total, (a, b))]
            keep = pa.array(same[0] & same[1])
            columns = [*(batch.column(k).slice(first, last - first) for k in range(6)), binaries(sets, count)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "copies", "cluster", "blocks", "block", "sets"])


def overlaps(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, given end to end."""
    n = len(count)
    owner = np.repeat(np.arange(n), count)
    _, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, column = owner[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, min(4096, 8_000_000 // max(1, n)))
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[i:j], column[i:j] - lo] = 1
        out += dense @ dense.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component, by a symmetric matrix of links."""
    label = np.arange(len(linked))
    i, j = np.nonzero(linked)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compare(rows: list[tuple], threshold: float) -> pa.RecordBatch:
    """node, links, root of the classes of one pair of blocks: rows (node, copies, lower, upper, block, sets)."""
    rows = sorted(rows, key=lambda r: r[0])
    node, copies, block = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 4))
    values = [np.frombuffer(r[5], np.uint64) for r in rows]
    count = np.array([len(v) for v in values])
    both = overlaps(np.concatenate(values), count)
    linked = both >= threshold * (count[:, None] + count[None, :] - both) - 1e-3
    np.fill_diagonal(linked, False)
    if rows[0][2] != rows[0][3]:
        linked &= block[:, None] != block[None, :]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ copies), pa.array(node[_roots(linked)])], names=["node", "links", "root"])


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """_compare for each group of rows sorted by (cluster, lower, upper)."""
    group, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns)):
                if r[:3] != group:
                    if len(rows) > 1:
                        yield _compare(rows, threshold)
                    group, rows = r[:3], []
                rows.append((r[3], r[4], r[1], r[2], r[5], r[6]))
    if len(rows) > 1:
        yield _compare(rows, threshold)


def similar_documents(
    documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """doc_id, class_id, n_links of every row of documents (doc_id, text; other columns are ignored).

    Two documents are linked if the Jaccard similarity of their sets of word shingles is at least ``threshold``. Words are
    the runs without white space, unchanged; a text of fewer words has one shingle, of all of them. class_id is the least
    doc_id of those that hang together by links, n_links the number of other rows linked. Null, empty and blank texts
    have no shingles and no links and are their own class; a very long text is read whole; an empty table gives no rows. A row
    without doc_id counts as a link of others but has no id of its own to give: its class is that of its links, or null. Repeated
    rows, and different texts under one doc_id, each count and each get a row.
    """
    signed, of_class = _classed(documents, F.lit(0), threshold, shingle, trees, depth, recall)
    rows = signed.select("doc_id", "a", "b", "n")
    joined = rows.where("n > 0").join(of_class, ["a", "b"]).select("doc_id", "class_id", "n_links")
    return joined.unionByName(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(
    documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """documents' rows without all but one row of each group that hangs together by links (see similar_documents).

    The row with the least doc_id stays; a row without doc_id only where no row of the group has one, and among equals the choice
    is by hash of the whole row. Rows whose text has no words have no links and all stay. All columns stay as they are.
    """
    columns = documents.columns
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    signed, of_class = _classed(documents, mark, threshold, shingle, trees, depth, recall)
    rows = signed.where("n > 0").join(of_class.select("a", "b", "grp"), ["a", "b"])
    first = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b", "mark")).alias("m"))
    own, other, there = (spare(c, columns) for c in ("_mark", "_first", "_id"))
    stay = first.select(F.col("m.mark").alias(other), F.col("m.doc_id").alias(there))
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = documents.where(wordy).withColumn(own, mark)
    kept = marked.join(stay, (marked[own] == stay[other]) & marked["doc_id"].cast("long").eqNullSafe(stay[there])).dropDuplicates([own, "doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in columns]).unionByName(documents.where(~wordy))


def _classed(documents: DataFrame, mark: Column, threshold: float, shingle: int, trees: int, depth: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, mark, a, b, n (n 0: no words) of all documents; a, b, class_id, n_links, grp of all classes."""
    symbols, length = trees * depth, prefix_length(threshold, trees, depth, recall)
    if trees > 256:
        raise ValueError("a forest has 256 trees at most")
    known_id = F.col("doc_id").cast("long")
    # Where a class's text is found again: at its least doc_id, or, without any, at a hash of the text.
    plain = documents.select(known_id.alias("doc_id"), F.coalesce(known_id, F.xxhash64("text")).alias("at"), mark.cast("long").alias("mark"), "text")
    signed = cut(plain.mapInArrow(lambda it: _signed(it, shingle, symbols), "doc_id long, at long, mark long, a long, b long, n int, signature binary, bits binary"))
    classes = cut(
        signed.where("n > 0").groupBy("a", "b")
        .agg(F.min("doc_id").alias("rep"), F.coalesce(F.min("doc_id"), F.min("at")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bits").alias("bits"))
    )
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = F.concat(F.substr(F.lit(bytes(range(256))), F.col("tree") + 1, F.lit(1)), F.substr("signature", F.col("tree") * (2 * depth) + 1, F.lit(2 * depth)))
    trie = classes.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature", "bits").select("node", path.alias("path"), "bits")
    trie = trie.withColumn("prefix", F.substring("path", 1, 1 + 2 * length))
    large = cut(trie.groupBy("prefix").count().where(F.col("count") > PIECE).select("prefix", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")))
    parted = trie.join(bounded_broadcast(large), "prefix", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    met = parted.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("with"))
    met = met.select(F.least("own", "with").alias("lower"), F.greatest("own", "with").alias("upper"), "path", "node", "bits", "prefix")
    sorted_trie = met.repartition(n, "prefix", "lower", "upper").sortWithinPartitions("lower", "upper", "path", "node").select("lower", "upper", "path", "node", "bits")
    most = most_unequal(threshold, symbols)
    ties = sorted_trie.mapInArrow(lambda it: _tied(it, 1 + 2 * length, most), "a long, b long")
    clusters = cut(components(ties.distinct()))
    members = clusters.select(F.col("node").alias("a"), F.col("label").alias("cluster")).join(classes.drop("signature", "bits"), "a")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    texts = placed.join(plain.select("at", "text"), "at").select("a", "b", "copies", "cluster", "blocks", "block", "text")
    spelt = texts.mapInArrow(lambda it: _spelt(it, shingle), "a long, b long, copies long, cluster long, blocks int, block int, sets binary")
    spelt = spelt.dropDuplicates(["a", "b"])  # repeated rows of the text would count twice
    paired = spelt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "cluster", F.least("block", "with").alias("lower"), F.greatest("block", "with").alias("upper"), F.col("a").alias("node"), "copies", "block", "sets"
    )
    dealt = paired.repartition(n, "cluster", "lower", "upper").sortWithinPartitions("cluster", "lower", "upper")
    compared = cut(dealt.mapInArrow(lambda it: _compared(it, threshold), "node long, links long, root long"))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = cut(components(compared.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    linked = found.join(classes.select(F.col("a").alias("node"), "rep"), "node")
    named = found.join(linked.groupBy("label").agg(F.min("rep").alias("least")), "label").select(F.col("node").alias("a"), "least", "label")
    of_class = (
        classes.select("a", "b", "rep", "copies").join(links.withColumnRenamed("node", "a"), "a", "left").join(named, "a", "left")
        .select("a", "b", F.coalesce("least", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "a").alias("grp"))
    )
    return signed, of_class
