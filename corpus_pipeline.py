"""From raw documents to token ids in five stages, each one of the text operators over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet to the cluster's shared folder and rereads them for the next, so that a lost executor
costs no more than the stage at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasstide.functions.storage import shared_folder
from glasstide.llm import bpe, decontaminate, ngram_join, secret_scan, toxicity
from glasstide.llm.common import spare, table
from glasstide.llm.queries import word_vocabulary


def _apart(docs: DataFrame, *results: str) -> DataFrame:
    """docs, with columns called like an operator's results out of their way; _back undoes it."""
    return docs.withColumnsRenamed(_names(docs, results))


def _names(docs: DataFrame, results: tuple[str, ...]) -> dict[str, str]:
    return {c: spare(f"_own_{c}", docs.columns) for c in docs.columns if c.lower() in results}


def _back(done: DataFrame, docs: DataFrame, *results: str) -> DataFrame:
    """done with the columns of docs, under their names."""
    moved = _names(docs, results)
    return done.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among docs, does not reject.

    Null and empty texts have no evidence and stay; very long ones are read whole; repeated rows fare alike; no documents give
    none; columns called score or predicted keep their values.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(_apart(docs, "score", "predicted"), model)
    return _back(scored.where("predicted = 0"), docs, "score", "predicted")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that hangs together by similarity, the row with the least doc_id, once.

    A row without doc_id stays only where its group has no row with one. Rows without words (null and empty texts) resemble
    nothing and all stay; very long texts are compared whole; texts that share a doc_id are judged each by itself; no documents
    give none; all columns keep their values.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows.

    Null and empty texts have no words and stay; very long ones are compared whole; repeated rows fare alike; an empty benchmark
    keeps all, no documents give none; columns called n_words, n_hit or items keep their values.
    """
    results = ("n_words", "n_hit", "items")
    found = decontaminate.contaminated_words(_apart(docs, *results), table(spark, sf_dir, "benchmark"))
    return _back(found.where(~decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit"))), docs, *results)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text where that changed.

    Null and empty texts stay as they are; very long ones are scanned whole; repeated rows fare alike; no documents give none;
    other columns, among them ones called base or spans, keep their values.
    """
    found = secret_scan.scan_secrets(_apart(docs, "base", "spans"))
    text, changed = secret_scan.redact(F.col("text"), F.col("spans")), F.size("spans") > 0
    new = {"text": text} | ({"n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return _back(found.withColumns(new), docs, "base", "spans")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimal, joined by a space) of all documents; null and empty texts have no ids."""
    return bpe.encode_texts(docs, word_vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]

#: The toxicity model is beyond SQL; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages' folders stay in the shared folder, for whoever wants to look at or resume from them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
