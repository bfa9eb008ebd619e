"""Benchmark decontamination: a prefix-filtered set join of item windows against documents, verified exactly.

Every item window is a set of word shingles. As a window must occur whole, its rarest shingle alone is a sufficient
prefix: the item shingles' occurrences are counted first, without positions, and then only prefix shingles meet documents' positions.
An alignment survives the length and position bounds and is then compared word by word, over the few words of the item that
its prefix stands for. All steps are DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD_RUN, bounded_broadcast, cut, lower_ascii, quoted, spare, words_of

#: Words of a window, and of a shingle within it.
WINDOW, SHINGLE = 13, 3


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, by their first word's index; the last ones are of fewer words."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(words, i + k) for k in range(1, size)]))


def _positions(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """keep, pos, h: each full shingle of each row's words. (The outer form keeps Spark from also hashing in a filter.)"""
    hashed = rows.select(*keep, _shingles(F.col("words"), size).alias("hs"), (F.size("words") - size + 1).alias("full"))
    return hashed.select(*keep, "full", F.posexplode_outer("hs").alias("pos", "h")).where(F.col("pos") < F.col("full")).drop("full")


def items_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_id, ids (item_ids of the text), words, n, width (words of its windows), size (words of its shingles); texts without words are left out."""
    words = benchmark.select("item_id", words_of(lower_ascii(F.col("text")), NON_WORD_RUN).alias("words"))
    n = F.size("words")
    return words.where(n > 0).groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")).select(
        F.monotonically_increasing_id().alias("text_id"), "ids", "words",
        n.alias("n"), F.least(n, F.lit(window)).alias("width"), F.least(n, F.lit(SHINGLE), F.lit(window)).alias("size"),
    )


def prefix_shingles(placed: DataFrame, frequency: DataFrame) -> DataFrame:
    """h, text_id, offset, first, last: the rarest shingle of every item window, and the starts of the windows it stands for.

    Windows of which some shingle never occurs are left out.
    """
    rare = placed.join(frequency, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("offset") - F.col("width") + F.col("size"))
    last = F.least(F.col("offset"), F.col("n") - F.col("width"))
    starts = rare.select("text_id", "h", "offset", "df", F.explode(F.sequence(first, last)).alias("start"))
    least = starts.groupBy("text_id", "start").agg(F.min(F.struct("df", "h", "offset")).alias("m")).where("m.df > 0")
    return least.groupBy("m.h", "text_id", "m.offset").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def contaminated_words(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents' rows with n_words, n_hit (words inside occurrences of item windows) and items (ids of the items found).

    documents: doc_id, text and any other columns, which stay, but for ones named like a result, whatever the case; benchmark:
    item_id, text. Words are lower-cased alphanumeric runs, anything beyond ASCII is a letter. A window is ``window`` consecutive
    item words; a shorter item is one window. Null and empty texts have no words; a very long text is compared whole; repeated
    rows each get a result; an empty benchmark finds nothing, an empty table gives no rows. Items that share an id are told apart
    by their words; the words of an item without id are hit, but it has no id to give.
    """
    items = cut(items_of(benchmark, window))  # text_id must not be numbered twice
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # three at most
    columns = [c for c in documents.columns if c.lower() not in ("n_words", "n_hit", "items")]
    own_words = words_of(lower_ascii(F.col("text")), NON_WORD_RUN)
    if not sizes:
        return documents.select(*quoted(columns), F.size(own_words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    # Rows go by their content, so that neither a repeated nor a missing doc_id gathers the alignments of many texts.
    row_key = F.xxhash64("doc_id", "text")
    docs = documents.select(row_key.alias("row"), own_words.alias("words"))
    placed = {s: _positions(items.where(F.col("size") == s), ["text_id", "n", "width", "size"], s).withColumnRenamed("pos", "offset") for s in sizes}
    counts = [_positions(docs, [], s).join(bounded_broadcast(at.select("h").distinct()), "h").select("h") for s, at in placed.items()]
    frequency = reduce(DataFrame.unionByName, counts).groupBy("h").agg(F.count("*").alias("df"))
    prefix = cut(prefix_shingles(reduce(DataFrame.unionByName, placed.values()), cut(frequency)).join(items, "text_id").select(
        "h", "size", "text_id", "offset", "first", "ids", "width", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("width")).alias("piece")
    ))
    alike = [_positions(docs, ["row"], s).join(bounded_broadcast(prefix.where(F.col("size") == s)), "h") for s in sizes]
    aligned = reduce(DataFrame.unionByName, alike).select("row", "ids", "piece", "width", (F.col("pos") - F.col("offset") + F.col("first")).alias("at"))
    key, seen, own, same, hits = (spare(n, columns) for n in ("_id", "_seen", "_words", "_same", "_hits"))
    per_doc = aligned.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("ids", "at", "piece", "width")).alias(seen))
    base = documents.select(*quoted(columns), row_key.alias(own))
    joined = base.join(per_doc, base[own] == per_doc[key], "left").select(*quoted(columns), seen, own_words.alias(own))
    compared = F.transform(
        F.coalesce(seen, F.array().cast(per_doc.schema[seen].dataType)),
        lambda c: F.struct(
            c["ids"].alias("ids"), c["at"].alias("at"), c["width"].alias("width"),
            F.array_join(F.transform(c["piece"], lambda w, o: F.when((c["at"] + o >= 0) & (F.get(own, c["at"] + o) == w), "1").otherwise("0")), "").alias("bits"),
        ),
    )
    # Short of a whole window, an alignment has no start.
    starts = lambda c: F.filter(
        F.sequence(F.lit(0), F.char_length(c["bits"]) - c["width"]),
        lambda s: F.substr(c["bits"], s + 1, c["width"]) == F.repeat(F.lit("1"), c["width"]),
    )
    found_at = F.filter(F.transform(same, lambda c: F.struct(c["ids"], c["at"], c["width"], starts(c).alias("starts"))), lambda c: F.size(c["starts"]) > 0)
    covered = F.flatten(F.transform(hits, lambda c: F.flatten(F.transform(c["starts"], lambda s: F.sequence(c["at"] + s, c["at"] + s + c["width"] - 1)))))
    return (
        joined.withColumn(same, compared)
        .withColumn(hits, found_at)
        .select(
            *quoted(columns),
            F.size(own).cast("long").alias("n_words"),
            F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda c: c["ids"])))).alias("items"),
        )
    )


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """True where one word in ``share`` or more lies inside an item's window."""
    return (n_hit > 0) & (share * n_hit >= n_words)
