"""Session settings the operators are tested with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "answerlab", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter sets these."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # Whole texts are long: a batch of 10 000 can pass what one Arrow column may hold.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # Texts are few bytes and much work: keep small shuffle partitions apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as spark.checkpoint.dir names it.

    Only where it is unset and driver and executors are one process is a new folder of this machine used.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="answerlab-"))
    return context.getCheckpointDir()


def materialise(frame: DataFrame, compression: str | None = None) -> DataFrame:
    """Write the frame once, as Parquet, and read it back.

    Nothing upstream runs again, also not when an executor is lost, and readers still get
    column pruning. The table goes when the application ends. ``compression`` is that of the session
    unless another one is named.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/answerlab-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs that run inside run with these settings of the session."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def arrow_batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Jobs that run inside give Python batches of about ``size`` bytes, or of a row that is larger.

    By number of rows alone, a batch of texts takes tens of MB in the executor and as much in each of its workers.
    """
    return settings(spark, {BATCH_BYTES: str(size)})


def passing_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs that run inside leave no shuffle files: they go with their job, not when the driver collects its garbage.

    For jobs one after the other that each write a table: else the disk holds the shuffles of all of them.
    """
    return settings(spark, {FILE_CLEANUP: "true"})
