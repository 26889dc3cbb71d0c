"""Log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from trafficlens import fixed_values as V
from trafficlens.functions import sizes, times
from trafficlens.schemas import require_columns


def _matches(value: str) -> Column:
    # One match at most, as the pattern reaches for the last bracket group.
    return F.regexp_extract_all(F.col(value), F.lit(V.LOG_PATTERN), F.lit(0))


def _size_text(record: Column) -> Column:
    return F.substring_index(record, " ", -1)


def _fields(record: Column) -> list[Column]:
    """Plain string functions cut the record that the pattern has found."""
    tail = F.substring_index(record, '"', -1)
    request = F.substring_index(F.substring_index(record, '"', -2), '"', 1)
    head = F.left(record, F.length(record) - F.length(F.substring_index(record, '"', -2)) - 1)
    stamp = F.substring_index(F.substring_index(head, " [", -1), "]", 1)
    return [
        F.substring_index(record, " ", 1).alias("host"),
        F.when(stamp != "", stamp)
        .otherwise(F.regexp_extract(record, V.LOG_PATTERN, 2)).alias("timestamp"),
        request.alias("request"),
        F.substring(tail, 2, 3).alias("response"),
        sizes.parse_size(_size_text(tail)).alias("bytes"),
    ]


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Host, timestamp text, request, status text and size of every line that has
    the log shape; other lines are dropped (``store_checked`` counts and keeps them).
    Further columns pass through.

    The pattern is evaluated once per line: exploding the list of matches both drops the
    unmatched lines and yields the record.
    """
    kept = [c for c in lines.columns if c != value]
    records = lines.select(*kept, F.explode(_matches(value)).alias("_record"))
    return records.select(*kept, *_fields(F.col("_record")))


# What can be wrong with a line; the first means that no row comes of it.
UNMATCHED, BAD_TIME, BAD_SIZE = "unmatched", "bad_time", "bad_size"
FAULTS = (UNMATCHED, BAD_TIME, BAD_SIZE)


def checked_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every line, typed, with the list of its ``faults`` and, if it has any, its text.

    A size of ``-`` is a missing size, not a fault. Null lines are unmatched.
    """
    kept = [c for c in lines.columns if c != value]
    record = F.col("_record")
    records = lines.select(*kept, F.col(value).alias("line"), F.get(_matches(value), F.lit(0)).alias("_record"))
    raw = records.select(
        *kept, "line", record.isNull().alias("_unmatched"), _size_text(record).alias("_size"), *_fields(record))
    typed = apply_types(raw)
    faults = F.array_compact(F.array(
        F.when(F.col("_unmatched"), F.lit(UNMATCHED)),
        F.when(~F.col("_unmatched") & F.col("timestamp").isNull(), F.lit(BAD_TIME)),
        F.when(~F.col("_unmatched") & F.col("bytes").isNull() & (F.col("_size") != "-"), F.lit(BAD_SIZE)),
    ))
    marked = typed.withColumn("faults", faults).drop("_size", "_unmatched")
    return marked.withColumn("line", F.when(F.size("faults") > 0, F.coalesce("line", F.lit(""))))


def store_checked(lines: DataFrame, path: str, value: str = "value") -> dict[str, int]:
    """Parses the lines into a folder that holds the rows and the rejected lines, in one
    pass over the text, and returns what that pass has counted: ``lines``, one number per
    fault, and the known and missing sizes."""
    seen = Observation("checked lines")
    outcome = F.when(F.size("faults") == 0, "clean").when(F.array_contains("faults", UNMATCHED), UNMATCHED).otherwise("faulty")
    matched = ~F.array_contains("faults", UNMATCHED)
    checked_lines(lines, value).withColumn("outcome", outcome).observe(
        seen, F.count("*").alias("lines"),
        *(F.count_if(F.array_contains("faults", fault)).alias(fault) for fault in FAULTS),
        F.count_if(matched & F.col("bytes").isNotNull()).alias("known_size"),
        F.count_if(matched & F.col("bytes").isNull()).alias("no_size"),
    ).write.partitionBy("outcome").parquet(path)
    return dict(seen.get)


def _stored(spark: SparkSession, path: str, schema, outcomes) -> DataFrame:
    return spark.read.schema(schema).parquet(path).where(F.col("outcome").isin(*outcomes))


def _store_schema(lines: DataFrame, value: str) -> T.StructType:
    return checked_lines(lines, value).withColumn("outcome", F.lit("")).schema


def checked_rows(lines: DataFrame, path: str, value: str = "value") -> DataFrame:
    """The typed rows of a folder that ``store_checked`` has made from ``lines``; faulty
    rows count as rows, with null for what could not be read."""
    found = _stored(lines.sparkSession, path, _store_schema(lines, value), ["clean", "faulty"])
    return found.drop("line", "faults", "outcome")


def quarantine(lines: DataFrame, path: str, value: str = "value") -> DataFrame:
    """The text of every line of the folder that has a fault, with its faults. Only the
    folders of such lines are read."""
    found = _stored(lines.sparkSession, path, _store_schema(lines, value), ["faulty", UNMATCHED])
    kept = [c for c in lines.columns if c != value]
    return found.select(*kept, F.col("line").alias(value), "faults")


def apply_types(parsed: DataFrame) -> DataFrame:
    """Time, status code and size in kilobytes; what cannot be read is null."""
    require_columns(parsed, V.RAW_COLUMNS)
    kept = [c for c in parsed.columns if c not in V.RAW_COLUMNS]
    return parsed.select(
        *kept,
        F.col("host").cast("string").alias("host"),
        times.parse_log_time(F.col("timestamp")).alias("timestamp"),
        F.col("request").cast("string").alias("request"),
        F.col("response").try_cast("int").alias("response"),
        sizes.to_kilobytes(F.col("bytes").try_cast("bigint")).alias("bytes"),
    )


def coerce_number(text: Column) -> Column:
    """Any number in a text as a double; bad text is null, and so is NaN."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def cast_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast by a column-to-type table; further columns pass through."""
    wanted = {field.name: field.dataType for field in schema.fields}
    require_columns(df, wanted)
    return df.select(
        *(F.col(c).try_cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns)
    )
