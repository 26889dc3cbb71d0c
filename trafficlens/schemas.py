"""Fixed schemas of the stages."""

from pyspark.sql import types as T

RAW_LINE = T.StructType([T.StructField("value", T.StringType())])

PARSED = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("bytes", T.LongType()),
])

TYPED = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.IntegerType()),
    T.StructField("bytes", T.DoubleType()),
])

# The variant that keeps status codes as text and sizes in whole bytes.
TYPED_WHOLE_BYTES = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("bytes", T.LongType()),
])

FORECAST = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("predicted", T.DoubleType()),
])


def require_columns(df, names) -> None:
    """Refuse a frame without the wanted columns before any job runs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
