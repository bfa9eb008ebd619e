"""Substring dedup: words covered by a window of words that also starts in an earlier document are removed.

The method is a prefix-partitioned suffix tree, kept sparse. Of all suffixes only those are indexed that begin with an anchor: the
least-hashed run of a few words inside some window. Equal windows hold their anchor at the same place, so what the indexed
suffixes share to the right, and their texts share to the left, are all repeats of a window's length.

1. Candidates. Texts are dealt into lots of bounded size. Each lot sends its windows' hashes, cut short, to the part of the
   hash range they lie in, and learns which of them other lots hold too. Chance matches only cost work.
2. Trees. Candidate suffixes travel with their words, grouped by a prefix of variable length: the anchor, or, where an anchor has
   more distinct windows than fit a group (by a grouped count of all texts), the whole window's hash in as many parts as are
   needed. A group's suffixes are refined word by word into nodes, to the right and to the left; the nodes a whole window deep
   that two documents share are the repeats.
3. Removal. Every lot meets the repeats found in its documents.

Sizes stay bounded without any cap: windows that a smaller document of the same lot has are settled there (by 128 bits of hash) and
never shuffled, so a passage that fills a third of the corpus sends one row per lot; a group is read as a stream sorted by
document, of which only the rows that are the first to hold some window stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import Words, binaries, chunks, mix, ragged, text_buffers, whole_windows, window_hashes
from .common import cut, spare, without_dots

#: Words of a window, and of the anchor inside it.
WINDOW, ANCHOR = 13, 5
#: Bytes of text of a lot, and windows of a part of the hash range, about.
LOT_BYTES, PART_WINDOWS = 3 << 20, 2_000_000
#: Distinct windows over which an anchor's group is split, anchors that are listed for that at most, and the step of their counts.
GROUP_WINDOWS, LISTED, COUNT_STEP = 20_000, 100_000, 256
#: Rows of suffixes that are refined into nodes together.
TREE_ROWS = 20_000
#: Leading bits of a cut hash that are sent as counts instead of digits.
COUNTED_BITS = 16


@dataclass(frozen=True)
class Prefixes:
    """How anchors are lengthened: each into base groups, those of the sorted keys into as many groups as parts says."""

    base: int
    keys: np.ndarray
    parts: np.ndarray

    def groups(self, key: np.ndarray, full: np.ndarray) -> np.ndarray:
        """The group of each window: its anchor's hash, lengthened by the window's own where one group would be too large."""
        parts = np.full(len(key), self.base, np.uint64)
        if len(self.keys) and len(key):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            parts[found] = self.parts[at[found]]
        with np.errstate(over="ignore"):
            return np.where(parts > 1, mix(key + np.uint64(1) + mix(full) % np.maximum(parts, np.uint64(1))), key)


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """By the window's first word: position and hash of the leftmost least-hashed anchor inside the window."""
    small = window_hashes(words, anchor, seed=11)
    n = max(0, len(words) - window + 1)
    best, least = np.zeros(n, np.int8), small[:n].copy()
    for k in range(1, window - anchor + 1):
        other = small[k : k + n]
        lower = other < least
        best[lower] = k
        least[lower] = other[lower]
    return np.arange(n) + best, least


def _measured(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """key, n: distinct windows of the anchors in a chunk of documents; without key, the chunk's bytes.

    A count n under COUNT_STEP is sent as COUNT_STEP in n of COUNT_STEP cases, by hash, and else left out: sums stay true on average.
    """
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for _, _, part, at in chunks(raw, offsets):
            words = Words(part, at)
            hashed = words.hashes()
            full = window_hashes(hashed, window)
            whole = np.flatnonzero(whole_windows(words.first, window)[: len(full)])
            distinct, where = np.unique(full[whole], return_index=True)
            key, n = np.unique(anchors(hashed, window, anchor)[1][whole[where]], return_counts=True)
            with np.errstate(over="ignore"):
                chunk = distinct[:1].sum(dtype=np.uint64)
                keep = mix(key + chunk) % np.uint64(COUNT_STEP) < n.astype(np.uint64)
            keys = pa.concat_arrays([pa.array(key[keep].view(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(np.maximum(n[keep], COUNT_STEP), len(part)).astype(np.int64))], names=["key", "n"])


def measure(documents: DataFrame, window: int, anchor: int) -> tuple[int, Prefixes]:
    """Bytes of all texts, and how anchors are lengthened so that groups have about GROUP_WINDOWS distinct windows at most.

    No more than about LISTED anchors are listed: beyond what that leaves over, all anchors are lengthened alike.
    """
    counted = cut(documents.select("text").mapInArrow(lambda b: _measured(b, window, anchor), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    size = sum(r["n"] for r in counted.where("key is null").collect())
    most = max(GROUP_WINDOWS, size // 6 // LISTED)
    rows = counted.where(F.col("key").isNotNull() & (F.col("n") > most)).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    parts = np.array([-(-r["n"] // GROUP_WINDOWS) for r in rows], np.uint64)
    order = np.argsort(keys)
    return size, Prefixes(-(-most // GROUP_WINDOWS), keys[order], parts[order])


class Lot:
    """The documents of a lot, by document id, as words; of each whole window its start and hash; and the windows' order by hash."""

    def __init__(self, table: pa.Table, text: int, doc_id: int, row: int, window: int):
        ids, rows = table.column(doc_id), np.asarray(table.column(row))
        known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
        by = np.lexsort((rows, ids))
        self.table = table.take(by).combine_chunks()
        self.known, self.ids, self.rows = known[by], ids[by], rows[by]
        self.raw, self.offsets = text_buffers(self.table.column(text).chunk(0) if len(by) else pa.array([], pa.string()))
        self.words = Words(self.raw, self.offsets)
        self.hashed = self.words.hashes()
        self.window = window
        full = window_hashes(self.hashed, window)
        doc = self.words.doc()
        start = np.flatnonzero(whole_windows(self.words.first, window)[: len(full)])
        self.start = start[self.known[doc[start]]]
        self.full, self.doc = full[self.start], doc[self.start]
        self.order = np.argsort(self.full, kind="stable")  # among equals, by document id
        self.sorted = self.full[self.order]

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By window: a number for its words, whether a smaller document id of this lot has it too, whether it is the lot's first of its kind."""
        f, d = self.sorted, self.ids[self.doc[self.order]]
        o = window_hashes(self.hashed, self.window, seed=8)[self.start][self.order] if len(self.start) else f
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
        least = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
        kind, repeated, first = np.empty(len(f), np.int64), np.empty(len(f), bool), np.empty(len(f), bool)
        kind[self.order], repeated[self.order], first[self.order] = np.cumsum(new) - 1, d > least, new
        return kind, repeated, first

    def cut(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The leading bits of the windows' hashes, distinct and sorted, and by sorted window the place of its own."""
        values = self.sorted >> np.uint64(64 - bits)
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        return values[new], np.cumsum(new) - 1


def _hash_bits(size: int) -> int:
    """Bits under which a window meets another by chance in about one case of a thousand, in whole bytes; a word takes about six bytes."""
    return min(64, max(24, -(-((size // 6).bit_length() + 10) // 8) * 8))


def _packed(values: np.ndarray, bits: int, low: int) -> bytes:
    """Sorted distinct numbers of ``bits`` bits between two multiples of 2^low: how many there are of each beginning, then all endings."""
    rest = bits - COUNTED_BITS
    beginning = (values >> np.uint64(rest)).astype(np.int64) - ((int(values[0]) >> low) << low >> rest)
    counts = np.bincount(beginning, minlength=1 << max(0, low - rest))
    kind = np.uint16 if counts.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes() + values.view(np.uint8).reshape(-1, 8)[:, : rest // 8].tobytes()


def _unpacked(data: bytes, part: int, bits: int, low: int) -> np.ndarray:
    rest = bits - COUNTED_BITS
    n = 1 << max(0, low - rest)
    counts = np.frombuffer(data, f"u{data[0]}", n, 1)
    endings = np.frombuffer(data, np.uint8, offset=1 + data[0] * n).reshape(-1, rest // 8)
    out = np.zeros((len(endings), 8), np.uint8)
    out[:, : rest // 8] = endings
    beginning = np.repeat(np.arange(n, dtype=np.uint64) + np.uint64(part << low >> rest), counts)
    return out.view(np.uint64).ravel() | (beginning << np.uint64(rest))


def _held(lot: Lot, number: int, bits: int, parts_bits: int) -> pa.Table:
    """part, lot, hashes: the lot's cut hashes by the part of the range."""
    (values, _), low = lot.cut(bits), bits - parts_bits
    part = (values >> np.uint64(low)).astype(np.int32) if parts_bits else np.zeros(len(values), np.int32)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    data = [_packed(values[a:b], bits, low) for a, b in zip(edges, np.append(edges[1:], len(values)))]
    return pa.table([pa.array(part[edges]), pa.array(np.full(len(edges), number)), pa.array(data, pa.binary())], names=["part", "lot", "hashes"])


def _shared(rows: pa.Table, bits: int, parts_bits: int) -> pa.Table:
    """lot, part, mask: which of the hashes that a lot sent to this part another lot sent too; lots without any are left out."""
    part, lots = rows.column(0)[0].as_py() if rows.num_rows else 0, rows.column(1).to_pylist()
    lists = [_unpacked(d, part, bits, bits - parts_bits) for d in rows.column(2).to_pylist()]
    values = np.concatenate([*lists, np.zeros(0, np.uint64)])
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    out, at = [], 0
    for lot, own in zip(lots, lists):
        if shared[at : at + len(own)].any():
            out.append((lot, np.packbits(shared[at : at + len(own)]).tobytes()))
        at += len(own)
    return pa.table(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())],
        names=["lot", "part", "mask"],
    )


def _candidates(lot: Lot, answers: pa.Table, bits: int, parts_bits: int) -> np.ndarray:
    """By window: whether other lots hold its cut hash."""
    (values, place), low = lot.cut(bits), np.uint64(bits - parts_bits)
    part = values >> low if parts_bits else np.zeros(len(values), np.uint64)
    shared = np.zeros(len(values), bool)
    for p, mask in zip(answers.column("part").to_pylist(), answers.column("mask").to_pylist()):
        a, b = np.searchsorted(part, [p, p + 1])
        shared[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a)
    out = np.empty(len(place), bool)
    out[lot.order] = shared[place]
    return out


SUFFIX = "key long, doc_id long, row long, first int, at int, words binary"


def _suffixes(lot: Lot, asked: np.ndarray, anchor: int, prefixes: Prefixes) -> pa.Table:
    """Rows SUFFIX: of each anchor the words of the asked windows around it, their first word's index, the anchor's byte in them."""
    place, key = anchors(lot.hashed, lot.window, anchor)
    s, d = lot.start[asked], lot.doc[asked]
    w, k = place[s], prefixes.groups(key[s], lot.full[asked])
    # Windows of one anchor are neighbours: starts differ by one while the anchor stays the same.
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1) | (k[1:] != k[:-1])]))
    last = np.append(new[1:], len(s))[: len(new)] - 1
    s, d, w, k, end = s[new], d[new], w[new], k[new], s[last]
    lo, hi = lot.words.starts[s], lot.words.ends[end + lot.window - 1]
    columns = [k.view(np.int64), lot.ids[d], lot.rows[d], (s - lot.words.first[d]).astype(np.int32), (lot.words.starts[w] - lo).astype(np.int32)]
    return pa.table([*map(pa.array, columns), binaries(lot.raw[ragged(lo, hi - lo)], hi - lo)], names=["key", "doc_id", "row", "first", "at", "words"])


def _nodes(parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Dense numbers of the children: one for each parent and symbol."""
    order = np.lexsort((symbol, parent))
    p, s = parent[order], symbol[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Suffixes:
    """Rows SUFFIX of some groups, sorted by key and document id, refined into nodes."""

    def __init__(self, rows: pa.Table, window: int, anchor: int):
        rows = rows.combine_chunks()
        self.key, self.doc, self.row, self.first, at = (np.asarray(rows.column(k)) for k in range(5))
        raw, offsets = text_buffers(rows.column(5).chunk(0).view(pa.string()))
        words = Words(raw, offsets)
        hashed = words.hashes()
        side = window - anchor
        self.place = np.searchsorted(words.starts, offsets[:-1] + at) - words.first[:-1]  # the anchor's word
        self.windows = words.count - window + 1
        padded = np.concatenate([np.zeros(side, np.uint64), hashed, np.zeros(side + 1, np.uint64)])
        begin = words.first[:-1] + self.place + side
        right = [_nodes(_nodes(np.zeros(len(begin), np.int64), self.key), window_hashes(hashed, anchor, seed=12)[begin - side])]
        left = [right[0]]
        for d in range(1, side + 1):
            right.append(_nodes(right[-1], padded[begin + anchor + d - 1]))
            left.append(_nodes(left[-1], padded[begin - d]))
        self.right, self.left, self.side = right, left, side

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row number, window's index in the row of every window that a smaller document has too; rows first to hold some window."""
        found, firsts = [], np.zeros(len(self.key), bool)
        for before in range(self.side + 1):  # words of the window that stand before the anchor
            index = self.place - before
            at = np.flatnonzero((index >= 0) & (index < self.windows))
            if not len(at):
                continue
            node = _nodes(self.right[self.side - before][at], self.left[before][at])
            order = np.lexsort((at, self.doc[at], node))
            n, d = node[order], self.doc[at][order]
            new = np.ones(len(order), bool)
            new[1:] = n[1:] != n[:-1]
            least = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
            hit = at[order[d > least]]
            found.append((hit, index[hit]))
            firsts[at[order[new]]] = True
        rows = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        return rows, np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)]), firsts


def _repeats(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """doc_id, row, starts: first words of repeated windows as runs, from rows SUFFIX sorted by key and document id."""
    held: list[pa.RecordBatch] = []  # of the open group: rows that were the first to hold some window, judged already
    waiting: list[pa.RecordBatch] = []
    old = count = 0

    def judged(rows: pa.Table, old: int) -> tuple[pa.RecordBatch, np.ndarray]:
        tree = Suffixes(rows, window, anchor)
        at, index, firsts = tree.repeats()
        new = at >= old
        doc, row, start = tree.doc[at[new]], tree.row[at[new]], tree.first[at[new]] + index[new]
        order = np.lexsort((start, row, doc))
        return _run_rows(doc[order], row[order], start[order]), firsts

    for batch in batches:
        for at in range(0, batch.num_rows, TREE_ROWS):
            waiting.append(batch.slice(at, TREE_ROWS))
            count += waiting[-1].num_rows
            if count < TREE_ROWS:
                continue
            rows = pa.Table.from_batches([*held, *waiting]).combine_chunks()
            found, firsts = judged(rows, old)
            yield found
            key = np.asarray(rows.column(0))
            keep = rows.filter(pa.array(firsts & (key == key[-1])))
            held, old, waiting, count = keep.to_batches(), keep.num_rows, [], 0
    if count:
        yield judged(pa.Table.from_batches([*held, *waiting]), old)[0]


def _run_rows(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """doc_id, row, starts: runs of neighbouring starts (first and length, 32 bits each) of each stretch of one row."""
    fresh = np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])])
    new = np.flatnonzero(fresh | np.concatenate([np.ones(min(1, len(row)), bool), start[1:] != start[:-1] + 1]))
    pairs = np.stack([start[new], np.diff(np.append(new, len(start)))], axis=1).astype(np.uint32)
    at = np.flatnonzero(fresh[new])
    columns = [pa.array(doc[new][at]), pa.array(row[new][at]), binaries(pairs.ravel(), 2 * np.diff(np.append(at, len(new))))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "starts"])


def _found_starts(lot: Lot, found: pa.Table) -> np.ndarray:
    """Words of the lot at which a found window starts; identical rows of the input share what was found for them."""
    kept = found.column("starts").to_pylist()
    runs = np.frombuffer(b"".join(kept), np.uint32).astype(np.int64).reshape(-1, 2)
    sizes = np.array([len(b) // 8 for b in kept], np.int64)
    row, doc = (np.repeat(np.asarray(found.column(c)), sizes) for c in ("row", "doc_id"))
    order = np.argsort(lot.rows, kind="stable")
    lo, hi = (np.searchsorted(lot.rows[order], row, side=side) for side in ("left", "right"))
    at = order[ragged(lo, hi - lo)]
    first, n, doc = (np.repeat(x, hi - lo) for x in (runs[:, 0], runs[:, 1], doc))
    same = lot.known[at] & (lot.ids[at] == doc)
    return ragged((first + lot.words.first[at])[same], n[same])


def _removed(lot: Lot, found: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, n_removed, kept of the lot's documents: the words that neither settled nor found windows cover, joined by one space."""
    words, window = lot.words, lot.window
    kind, repeated, _ = lot.settled()
    told = np.zeros(len(kind) + 1, bool)  # only the lot's first window of a kind was asked for; the answer holds for all of them
    told[kind[np.searchsorted(lot.start, _found_starts(lot, found))]] = True
    p = lot.start[repeated | told[kind]]
    covered = np.zeros(len(words.starts) + 1, np.int64)
    covered[p] += 1
    covered[p + window] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    left = np.concatenate([[0], np.cumsum(~gone)])
    n_kept = left[words.first[1:]] - left[words.first[:-1]]
    # A kept word takes the separator behind it along, as a space, unless it is its document's last kept one.
    keep = np.flatnonzero(~gone)
    inner = np.ones(len(keep), bool)
    inner[np.cumsum(n_kept)[n_kept > 0] - 1] = False
    step = np.zeros(len(lot.raw) + 1, np.int8)
    step[words.starts[keep]] += 1
    step[words.ends[keep]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    raw = lot.raw.copy()
    raw[words.ends[keep[inner]]] = 0x20
    mask[words.ends[keep[inner]]] = True
    size = np.concatenate([[0], np.cumsum(mask)])[lot.offsets].astype(np.int32)
    kept = pa.Array.from_buffers(pa.string(), len(words.count), [None, pa.py_buffer(size), pa.py_buffer(raw[mask].tobytes())])
    return pa.array(words.count.astype(np.int64)), pa.array((words.count - n_kept).astype(np.int64)), kept


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """documents' rows with n_words, n_removed and kept (the words left, joined by one space).

    Words are the runs without white space, unchanged. A word goes if it lies in a window of ``window`` consecutive words
    whose words also start a window in a document with a smaller doc_id; windows are judged on the input. Null and empty
    texts have no words and an empty rest; a very long text is one lot, whole; an empty table gives no rows. Rows that share a
    doc_id are each judged against smaller ids, never against one another; repeated rows each get a result. Rows without doc_id
    are left as they are and remove nothing. Other columns stay as they are, but for ones named like a result, whatever the case.
    """
    results = ("n_words", "n_removed", "kept")
    columns = [c for c in documents.columns if c.lower() not in results]
    key, own, number = (spare(c, columns) for c in ("_row", "_doc", "_lot"))
    source, names = without_dots(documents, columns)
    size, prefixes = measure(source.where(F.col("doc_id").isNotNull()), window, anchor)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots, bits = max(partitions, -(-size // LOT_BYTES)), _hash_bits(size)
    parts_bits = min(30, max(partitions - 1, size // 6 // PART_WINDOWS).bit_length())
    lot_of = lambda row: F.pmod(row, F.lit(lots)).cast("long")
    keyed = source.select("*", F.xxhash64("doc_id", "text").alias(key), F.col("doc_id").cast("long").alias(own)).withColumn(number, lot_of(F.col(key)))
    dealt, text, n = keyed.groupBy(number), columns.index("text"), len(columns)

    def lot(table: pa.Table) -> Lot:
        return Lot(table, text, n + 1, n, window)

    def held(table: pa.Table) -> pa.Table:
        return _held(lot(table), table.column(n + 2)[0].as_py(), bits, parts_bits)

    def suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        one = lot(table if answers.num_rows else table.slice(0, 0))
        return _suffixes(one, one.settled()[2] & _candidates(one, answers, bits, parts_bits), anchor, prefixes)

    def removed(table: pa.Table, found: pa.Table) -> pa.Table:
        one = lot(table)
        return pa.table([*one.table.columns[:n], *_removed(one, found)], names=[*names, *results])

    answers = dealt.applyInArrow(held, "part int, lot long, hashes binary").groupBy("part").applyInArrow(lambda t: _shared(t, bits, parts_bits), "lot long, part int, mask binary")
    asked = dealt.cogroup(answers.groupBy("lot")).applyInArrow(suffixes, SUFFIX)
    grouped = asked.repartition(partitions, "key").sortWithinPartitions("key", "doc_id")
    found = grouped.mapInArrow(lambda b: _repeats(b, window, anchor), "doc_id long, row long, starts binary").withColumn("lot", lot_of(F.col("row")))
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return dealt.cogroup(found.groupBy("lot")).applyInArrow(removed, T.StructType([*source.schema.fields, *kinds])).toDF(*columns, *results)
