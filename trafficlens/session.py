"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession, functions as F


def get_spark(app: str = "trafficlens", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites in error messages cost a lookup for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` as the session has it.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be seen by the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trafficlens-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/trafficlens/{name}-{uuid.uuid4().hex}"


#: Rows of text work that one task gets at most.
TASK_ROWS = 100_000


def spread(df):
    """Rows dealt out evenly, so that no task has more than ``TASK_ROWS`` and every core
    has some. Text work is heavy per row, and the splits of a scan say little about rows: a
    file of many splits may hold all of them in a few row groups."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(wanted)


def written(df, name: str):
    """Write a frame below the shared folder and read it back.

    Cuts the lineage at a small intermediate that several branches read, and
    keeps it when executors are lost.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables below the shared folder that are deleted once nothing reads them any more."""

    def __init__(self):
        self.paths: list[str] = []
        self.spark: SparkSession | None = None

    def written(self, df, name: str):
        self.spark = df.sparkSession
        self.paths.append(work_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def side_by_side(jobs: dict, most: int = 8) -> dict:
    """Runs functions in driver threads, ``most`` at a time, each in a pool of its own, so
    that with ``spark.scheduler.mode=FAIR`` none waits for another's tasks. A function that
    fails has its exception as its result; the others go on."""
    spark = SparkSession.active()

    def run(name, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", str(name))
        try:
            return job()
        except Exception as error:
            return error
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as threads:
        started = {name: threads.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
        return {name: one.result() for name, one in started.items()}


# Bytes of Parquet up to which a lookup table goes to every executor; in memory it is
# larger, some tens of megabytes.
BROADCAST_BYTES = 8 << 20


def lookup(df, name: str):
    """A table to join to much larger ones. It is written first, so it is made only
    once and its size is known: a small one is broadcast, and a join with a larger one
    is left to Spark, which shuffles both sides and splits skewed keys."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(table) if stored_bytes(df.sparkSession, path) <= BROADCAST_BYTES else table
