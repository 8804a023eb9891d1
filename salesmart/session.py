"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# a write then deletes what it has shuffled as it ends; else that stays until the driver collects garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "salesmart", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator relies on.

    On a cluster ``master`` and sizes come from spark-submit; only semantics
    (UTC, ANSI) and adaptive execution are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # files are compressed: judge broadcasts by what a table takes in memory
        .config("spark.sql.sources.fileCompressionFactor", "8.0")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named by ``spark.checkpoint.dir``.

    Where that is unset, the warehouse is used, which all executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/salesmart-{spark.sparkContext.applicationId}"


@contextmanager
def tidy_writes(spark: SparkSession) -> Iterator[None]:
    """Writes made within leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The rows are computed once, survive the loss of executors, and anything
    that depends on the physical layout (partition ids) is frozen.  Readers of
    a few columns read only those.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with tidy_writes(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete what this application has cut; call it when its results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
