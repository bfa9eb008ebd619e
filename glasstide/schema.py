"""Column layouts shared by all modules. Missing values are NULL everywhere, never NaN."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICES = ("open", "high", "low", "close", "volume")
