"""CSV and Parquet tables, and the stage outputs written with them."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(
    spark: SparkSession, path, schema: T.StructType, columns=None, index: str | None = None
) -> DataFrame:
    """CSV with a header. ``columns`` reads only those; ``index`` names a leading
    row-number column that the file has and the result drops."""
    fields = schema.fields
    if index is not None:
        fields = [T.StructField(index, T.LongType()), *fields]
    frame = (
        spark.read.schema(T.StructType(fields)).option("header", True)
        .option("enforceSchema", False).option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return frame.select(*(columns or schema.fieldNames()))


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True).option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )


def read_parquet_sets(spark: SparkSession, paths) -> list[DataFrame]:
    """One frame per data set, in the given order."""
    return [spark.read.parquet(path) for path in paths]


def read_parquet_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of one schema below a folder as one frame."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


# Files and joining tasks of a bucketed set; at 100 TB a few thousand.
BUCKETS = 32


def write_bucketed_sets(
    sets: dict[str, DataFrame], path: str, key: str = "index", buckets: int = BUCKETS
) -> tuple[DataFrame, list[DataFrame]]:
    """Feature sets as tables dealt out and sorted by their key, and read back; before them
    their distinct keys, stored the same way.

    Tables with the same number of buckets join on the key without moving a row, however
    often they are joined. A set is brought into its buckets once, so it has one file per
    bucket; its table is named after the last folder of ``path`` and the set.
    """
    base = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")

    def stored(name: str, dealt: DataFrame) -> DataFrame:
        (
            dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}")
            .format("parquet").mode("overwrite").saveAsTable(f"{base}_{name}")
        )
        return dealt.sparkSession.table(f"{base}_{name}")

    out = [stored(name, df.repartition(buckets, key)) for name, df in sets.items()]
    every = reduce(lambda a, b: a.union(b), [df.select(key).where(F.col(key).isNotNull()) for df in out])
    return stored("_keys", every.repartition(buckets, key).distinct()), out


def write_tables(df: DataFrame, path: str) -> None:
    """One folder per frequency and split. The rows of a folder are brought together
    first; a folder with many rows is split again over several tasks and files."""
    df.hint("rebalance", "freq", "split").write.partitionBy("freq", "split").parquet(path)


def write_features(df: DataFrame, path: str, freq: str) -> None:
    """A feature table into the folder of its frequency, which has its own columns."""
    df.hint("rebalance", "split").write.partitionBy("split").parquet(f"{path}/freq={freq}")


def read_table(
    spark: SparkSession, path: str, freq: str, split: str | None = None,
    made_by: str = "the traffic-table step",
) -> DataFrame:
    """The table of one frequency (and split); only its folders are read."""
    folder = f"{path}/freq={freq}"
    try:
        found = spark.read.option("basePath", path).parquet(folder)
    except AnalysisException as error:
        raise FileNotFoundError(f"no table at {folder}: run {made_by} first") from error
    return found if split is None else found.where(F.col("split") == split)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
