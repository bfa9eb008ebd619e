"""Small helpers shared by the text operators: shared-folder checkpoints, size checks, column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import kept as cut  # noqa: F401
from ..functions.storage import shared_folder

#: Separators of the words that keep case and punctuation (fixed by the data contract).
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Separators of lower-cased alphanumeric words; everything beyond ASCII counts as a letter.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which a side may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows, written as JSON, take at most ``limit`` bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return (size or 0) <= limit


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if it is small; unmarked otherwise, so that the join shuffles."""
    return F.broadcast(df) if is_small(df, limit) else df


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; null gives empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces of text between runs of separators."""
    return F.array_remove(F.split(text, separators), "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def held_out(key: str, modulus: int) -> Column:
    """True where crc32 of the key, written as text, leaves the remainder 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever stands in it: a dot names no field."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def spare(name: str, columns: list[str]) -> str:
    """name, lengthened until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_dots(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of df under names without dots, as functions on Arrow batches take no others, and these names."""
    names = [spare(f"_column{i}", columns) if "." in c or "`" in c else c for i, c in enumerate(columns)]
    return df.select(*[c.alias(n) for c, n in zip(quoted(columns), names)]), names
