"""Raw access-log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from trafficlens.session import lookup, written
from trafficlens.sources.zips import ZipLines

# Besides line feed and carriage return, the characters that end a line of text.
EXTRA_LINE_BREAKS = "[\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def log_line() -> Column:
    """The lines within a text record, bytes that are no UTF-8 as U+FFFD."""
    return F.explode(F.split(F.make_valid_utf8(F.col("value")), EXTRA_LINE_BREAKS)).alias("value")


def read_log_text(spark: SparkSession, path, positions: bool = False) -> DataFrame:
    """One row per line; bytes that are no UTF-8 become U+FFFD.

    Plain or gzip text files. With ``positions`` each line also carries its file
    and block, which ``dense_index`` turns into row numbers in file order.
    """
    line = log_line()
    lines = spark.read.text(path)
    if not positions:
        return lines.select(line)
    return lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        "value",
    ).select("_file", "_block", line)


def read_log_zip(spark: SparkSession, path: str, members: str = "*", positions: bool = False, encoding: str = "utf-8") -> DataFrame:
    """The same from members of a zip container, or of all containers of a folder.

    ``members`` is a name or pattern, or several with commas between. A container is
    read by as many tasks as it has members, each in pieces.
    """
    spark.dataSource.register(ZipLines)
    lines = spark.read.format("zip_lines").option("members", members).option("encoding", encoding).load(path)
    text = F.col("value").cast("string").alias("value")
    if not positions:
        return lines.select(text).select(log_line())
    return lines.select(
        F.concat_ws("!", "container", "member").alias("_file"), F.lit(0).cast("bigint").alias("_block"), text,
    ).select("_file", "_block", log_line())


def write_log_zip(lines: DataFrame, path: str) -> None:
    """Lines (member, value) as zip containers below a folder, one per task; overwrites."""
    lines.sparkSession.dataSource.register(ZipLines)
    rows = lines.select(F.lit(None).cast("string").alias("container"), "member", F.col("value").cast("binary").alias("value"))
    rows.write.format("zip_lines").mode("overwrite").save(path)


#: Members of the container that holds both splits.
TRAIN_MEMBER, TEST_MEMBER = "DATA/train.txt", "DATA/test.txt"


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def read_train_test(spark: SparkSession, train, test, positions: bool = False) -> DataFrame:
    """Both splits in one frame, told apart by ``split``."""
    return _both(read_log_text(spark, train, positions), read_log_text(spark, test, positions))


def read_train_test_zip(
    spark: SparkSession, path: str, train: str = TRAIN_MEMBER, test: str = TEST_MEMBER, positions: bool = False,
    encoding: str = "utf-8",
) -> DataFrame:
    """Both splits from two members of one container."""
    return _both(*(read_log_zip(spark, path, member, positions, encoding) for member in (train, test)))


def dense_index(df: DataFrame, name: str = "index") -> DataFrame:
    """Number the rows of a positioned scan 0..n-1 in file order.

    No sort and no single task: rows of one block are read in order by one task, so a
    row's number is its place in the block plus the rows of all earlier blocks. The
    numbered scan is stored, so that places and counts come from one and the same scan.
    Only the per-block counts (one row per input block) are ordered. Splits, if any, are
    numbered apart.
    """
    keys = ["split"] if "split" in df.columns else []
    placed = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    blocks = placed.groupBy(*keys, "_file", "_block").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    order = W.partitionBy(*keys).orderBy("_file", "_block")
    starts = lookup(blocks.select(
        *keys, "_file", "_block", "_first",
        (F.sum("_n").over(order) - F.col("_n")).alias("_start"),
    ), "block-starts")
    joined = placed.join(starts, [*keys, "_file", "_block"])
    number = (F.col("_start") + F.col("_id") - F.col("_first")).alias(name)
    kept = [c for c in df.columns if c not in ("_file", "_block")]
    return joined.select(number, *kept)
