"""Source divergence audit: how each source's share of terms departs from other sources' and from its language's.

Which terms count is found by iceberg prefix refinement. Chunks of texts are first told as rows of (lang, term) with their counts by
source and with the first few distinct documents they stand in, which is enough to decide a threshold on distinct documents exactly.
Terms are then cut to prefixes of 4 bytes, 8, 16 and so on. Prefixes that stand in too few documents go, and with them all their
terms; a term no longer than the level's prefix is complete, and kept if it has enough documents itself. Only what lies
under a frequent prefix reaches the next level, so the long tail of rare terms is never grouped by whole terms nor counted by source.

All numbers are integers: shares are scaled by 10^9 and cut, so that results do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Words, chunks, lists, lowered, ragged, text_buffers
from .common import bounded_broadcast, stored

#: Documents that a term must stand in, within its language; terms reported for each source; scale of shares.
LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of the first level's prefixes; each level doubles them.
FIRST_PREFIX = 4
#: Bytes of text told as one lot of rows; cells (terms by sources) compared at a time.
CHUNK, CELLS = 16 << 20, 1 << 20


def _not_letters() -> np.ndarray:
    """By byte: whether it ends a term. Terms are of A-Z, a-z and everything beyond ASCII."""
    out = np.zeros(256, bool)
    out[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
    return out


NOT_LETTERS = _not_letters()


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and, for each, where its stretch begins in sorted x."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], first


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _told(lang: pa.Array, source: pa.Array, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, least: int) -> pa.RecordBatch:
    """lang, term, docs, sources, counts of a run of documents."""
    words = Words(lowered(raw), offsets, NOT_LETTERS)
    bounds = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    letters = np.ascontiguousarray(words.raw[~NOT_LETTERS[words.raw]])
    code, terms = _codes(pa.Array.from_buffers(pa.large_string(), len(words.starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]))
    (lang_of, langs), (source_of, sources), (id_of, documents) = _codes(lang), _codes(source), _codes(ids)
    rows = len(lang_of)
    met, at = _distinct((lang_of[words.doc()] * max(1, len(terms)) + code) * rows + words.doc())
    n = np.diff(np.append(at, len(code)))
    key, row = np.divmod(met, rows)
    keys, first = _distinct(key)  # met is sorted, so its keys are
    # By key and source: sums of n.
    by_source = np.lexsort((source_of[row], key))
    k, s, c = key[by_source], source_of[row][by_source], n[by_source]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, np.int64)
    counts = np.add.reduceat(c, new) if len(k) else c
    n_sources = np.diff(np.append(np.searchsorted(k[new], keys), len(new)))
    # By key: the first few distinct documents; rows without an id are none.
    pairs, _ = _distinct((key * max(1, len(documents)) + id_of[row])[id_of[row] >= 0])
    of, doc = np.divmod(pairs, max(1, len(documents)))
    begins = np.searchsorted(of, keys)
    n_docs = np.minimum(np.diff(np.append(begins, len(of))), least)
    doc = doc[ragged(begins, n_docs)]
    which_lang, which_term = np.divmod(keys, max(1, len(terms)))
    docs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_docs)]).astype(np.int32)), documents.take(pa.array(doc)))
    named = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_sources)]).astype(np.int32)), sources.take(pa.array(s[new])))
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(which_lang)), terms.take(pa.array(which_term)).cast(pa.string()), docs, named, lists(counts, n_sources, pa.int64())], names=["lang", "term", "docs", "sources", "counts"]
    )


def term_rows(documents: DataFrame, least: int) -> DataFrame:
    """lang, term, docs (up to ``least`` distinct doc_ids), sources, counts (by source): a row for each term of each lot of texts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, ids, text = batch.columns
            for a, b, raw, offsets in chunks(*text_buffers(text), CHUNK):
                yield _told(lang.slice(a, b - a), source.slice(a, b - a), ids.slice(a, b - a), raw, offsets, least)

    key = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("lang", "source", "doc_id", "text").mapInArrow(told, f"lang string, term string, docs array<{key}>, sources array<string>, counts array<long>")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """lang, prefix, whole of rows (with docs) that stand in at least ``least`` distinct documents."""
    by = ["lang", "prefix", "whole"]
    full = stored(rows.where(F.size("docs") >= least).select(*by).distinct())  # rows that decide it alone
    rest = rows.where(F.size("docs") < least).join(bounded_broadcast(full), by, "left_anti")
    counted = rest.select(*by, F.explode("docs").alias("doc")).distinct().groupBy(*by).count().where(F.col("count") >= least)
    return full.unionByName(counted.select(*by))


def kept_terms(rows: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST_PREFIX) -> DataFrame:
    """lang, term of term_rows() that stand in at least ``least`` distinct documents of the language, by prefix refinement."""
    length, kept, alive = first, None, None
    while True:
        long_enough = rows if alive is None else rows.where(F.octet_length("term") > length // 2)
        level = lambda df, n: df.withColumn("prefix", F.substring(F.col("term").cast("binary"), 1, n))
        if alive is not None:
            long_enough = level(long_enough, length // 2).join(bounded_broadcast(alive.where("not whole").select("lang", "prefix")), ["lang", "prefix"], "left_semi")
        cut = level(long_enough, length).withColumn("whole", F.octet_length("term") <= length)
        alive = stored(_frequent(cut.select("lang", "prefix", "whole", "docs"), least))
        done = alive.where("whole").select("lang", F.col("prefix").cast("string").alias("term"))
        kept = done if kept is None else kept.unionByName(done)
        if not alive.where("not whole").limit(1).count():
            return kept
        length *= 2


def term_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, by_source (source, n) of every kept term; sources where it does not occur have no entry."""
    rows = stored(term_rows(_plain(documents), least))
    kept = stored(kept_terms(rows, least))
    pairs = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    counted = rows.join(bounded_broadcast(kept), ["lang", "term"], "left_semi").select("lang", "term", pairs)
    by_source = counted.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    # A term has one entry for each source of its language at most, as many as the report has rows for one source.
    return by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))


def _scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exactly: long division by thousands, so that no product leaves 64 bits."""
    rest = count + 1
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _pair_sums(counts: DataFrame, groups: list[tuple[str, str, int, int]]) -> DataFrame:
    """lang, source, item, value: for every two sources of a language, the sum of departures over all of its kept terms."""
    places: dict[str, dict[str, int]] = {}
    totals: dict[str, list[int]] = {}
    for lang, source, total, terms in sorted(groups):
        places.setdefault(lang, {})[source] = len(places.get(lang, {}))
        totals.setdefault(lang, []).append(total + terms)
    told = counts.sparkSession.sparkContext.broadcast((places, {k: np.array(v, np.int64) for k, v in totals.items()}))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = told.value
        sums = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            entries = batch.column(1)
            size = np.diff(entries.offsets.to_numpy())
            flat = entries.flatten()
            source, n = flat.field(0).to_pylist(), flat.field(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lang)), size)
            by_lang: dict[str, list[int]] = {}
            for i, x in enumerate(lang):
                by_lang.setdefault(x, []).append(i)
            column = np.array([place[lang[r]][s] for r, s in zip(row, source)], np.int64)
            for x, mine in by_lang.items():
                width = len(place[x])
                acc = sums.setdefault(x, np.zeros((width, width), np.int64))
                at = np.full(len(lang), -1)
                at[mine] = np.arange(len(mine))
                step = max(1, CELLS // width)
                for a in range(0, len(mine), step):
                    here = (at[row] >= a) & (at[row] < a + step)
                    dense = np.zeros((min(step, len(mine) - a), width), np.int64)
                    dense[at[row][here] - a, column[here]] = n[here]
                    p = _scaled(dense, total[x][None, :])
                    for q in range(width):
                        away = p - p[:, q, None]
                        acc[:, q] += (away * away // p[:, q, None]).sum(axis=0)
        for x, acc in sums.items():
            names = list(place[x])
            own, other = np.nonzero(~np.eye(len(names), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(own), pa.string()), pa.array([names[i] for i in own], pa.string()), pa.array([names[i] for i in other], pa.string()), pa.array(acc[own, other])],
                names=["lang", "source", "item", "value"],
            )

    parts = counts.select("lang", "by_source").mapInArrow(summed, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every occurring (lang, source).

    Part pair: each other source of the language and how far this source's shares of the kept terms lie from that one's, summed over all
    kept terms (0 without any). Part term: the ``top`` terms that the source has more of than its language, by how far.
    A share is p = 1 + floor(10^9 (count + 1) / (all + terms)); a departure from q is floor((p - q)^2 / q). Ranks begin at 1, ties go by item.

    documents: doc_id, text, lang, source, and any other columns, which are ignored whatever their names. Null text, lang and source
    count as empty text; empty texts have no terms but their groups are reported; very long ones are read whole; rows that share a doc_id
    are one document for the threshold, and all of them are counted; rows without doc_id are no document, but their terms are counted
    if kept; an empty table gives no rows.
    """
    plain = _plain(documents)
    counts = stored(term_counts(documents, least))
    terms = counts.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    entries = counts.select("lang", "term", "total", F.explode("by_source").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stored(groups.fillna(0, ["own_total", "terms", "lang_total"]))
    listed = [(r["lang"], r["source"], r["own_total"], r["terms"]) for r in groups.collect()]  # a row for each source and language

    sums = _pair_sums(counts, listed)
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the report's own rows
    pairs = every.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"]).withColumn("part", F.lit("pair"))

    scaled = lambda n, total: F.expr(f"(cast({n} + 1 as decimal(20,0)) * {SCALE}) div ({total}) + 1")
    shares = entries.join(bounded_broadcast(groups), ["lang", "source"])
    shares = shares.withColumn("p", scaled("n", "own_total + terms")).withColumn("q", scaled("total", "lang_total + terms")).where("n > 0 and p > q")
    telling = shares.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order))
    best = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best.select(*ranked.columns))
