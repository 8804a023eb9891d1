"""Datasets published together: readers see all of a run, or nothing of it.

Each run writes its partitions into folders of its own, which no reader looks at
yet.  A manifest then names, for every dataset and partition, the run that holds
it; last, one small file is switched to that manifest.  A run that fails anywhere
before has changed nothing, a reader keeps what it has opened, and running it
again writes new folders.  A partition of a run never changes once published.

The manifest is a table with a row per dataset and partition.  A read is a join
of the dataset's files with it, on partition columns only, so that folders of
other runs are pruned before any file is opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.session import cut
from salesmart.sources.readers import SCHEMA_FILE, saved_schema
from salesmart.sources.sinks import write_text

RUN, CURRENT, MANIFESTS = "publication", "current_manifest", "manifests"
ROW = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("partition", T.StringType()),
                    T.StructField(RUN, T.StringType())])


class Publication:
    """One run in the making; nothing is visible until ``commit``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.run = spark, root, uuid.uuid4().hex
        self._named = current_name(spark, root)
        self._after = manifest_rows(spark, root, self._named)

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str], replaced: DataFrame | None = None) -> None:
        """Write a dataset's new partitions.

        ``replaced`` holds the partitions that are due (named like
        ``partition_by``): those without rows in ``df`` are empty from then on.
        Without it the dataset afterwards holds ``df`` and nothing else.
        """
        keys = [c for c in partition_by if c in df.columns]
        path = f"{self.root}/{name}"
        rows = df.withColumn(RUN, F.lit(self.run)).hint("rebalance", *keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN, *keys).parquet(path)
        write_text(self.spark, f"{path}/{SCHEMA_FILE}", df.schema.json())
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(RUN, T.StringType())])).parquet(
            path).where(F.col(RUN) == self.run)
        fresh = written.select(_partition(keys)).distinct().select(
            F.lit(name).alias("dataset"), "partition", F.lit(self.run).alias(RUN))
        kept = self._after.where(F.col("dataset") != name)
        if replaced is not None:
            due = replaced.select(_partition(keys)).unionByName(fresh.select("partition")).distinct()
            same = self._after.where(F.col("dataset") == name).join(due, "partition", "left_anti")
            kept = kept.unionByName(same.select(*ROW.fieldNames()))
        self._after = kept.unionByName(fresh)

    def commit(self) -> str:
        """Write the manifest, then switch to it; returns its name."""
        if current_name(self.spark, self.root) != self._named:
            raise RuntimeError(f"another run has published to {self.root} since this one began")
        self._after.write.parquet(f"{self.root}/{MANIFESTS}/{self.run}")
        write_text(self.spark, f"{self.root}/{CURRENT}", self.run)
        return self.run

    def read(self, name: str, partition_by: Sequence[str]) -> DataFrame:
        """A dataset as it will be once this run is committed."""
        return _live(self.spark, self.root, name, partition_by, cut(self._after))


def _partition(keys: Sequence[str]):
    """A partition's values as one text; JSON, so that no two partitions look alike."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])).alias("partition")


def current_name(spark: SparkSession, root: str) -> str | None:
    """The manifest that readers see now."""
    files, path = _files(spark, f"{root}/{CURRENT}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def manifest_rows(spark: SparkSession, root: str, name: str | None) -> DataFrame:
    if name is None:
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(f"{root}/{MANIFESTS}/{name}")


def read_published(spark: SparkSession, root: str, name: str, partition_by: Sequence[str],
                   manifest: str | None = None) -> DataFrame:
    """A dataset as published, or as an earlier ``manifest`` had it."""
    named = manifest or current_name(spark, root)
    if named is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return _live(spark, root, name, partition_by, manifest_rows(spark, root, named))


def _live(spark: SparkSession, root: str, name: str, partition_by: Sequence[str], manifest: DataFrame) -> DataFrame:
    """The rows of a dataset in the folders that a manifest names."""
    path = f"{root}/{name}"
    schema = saved_schema(spark, path)
    if schema is None:
        raise FileNotFoundError(f"nothing is published as {name} in {root}")
    keys = [c for c in partition_by if c in schema.fieldNames()]
    # only partition columns in the join: it prunes folders
    values = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    live = manifest.where(F.col("dataset") == name).select(
        F.col(RUN).alias("_live_run"), F.from_json("partition", values).alias("_live")).select(
        "_live_run", *[F.col(f"_live.{k}").cast(schema[k].dataType).alias(f"_live_{k}") for k in keys])
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])).parquet(path)
    same = F.col(RUN) == F.col("_live_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_live_{k}"))
    return rows.join(live, same, "left_semi").select(*schema.fieldNames())


def drop_old_runs(spark: SparkSession, root: str, names: Sequence[str], keep: Sequence[str] = ()) -> None:
    """Delete folders that neither the current manifest nor those in ``keep`` name; no reader may be on others."""
    manifests = [m for m in (current_name(spark, root), *keep) if m]
    wanted = {r[0] for r in spark.read.schema(ROW).parquet(*[f"{root}/{MANIFESTS}/{m}" for m in manifests])
              .select(RUN).distinct().collect()}     # as many as there were runs
    for name in names:
        files, path = _files(spark, f"{root}/{name}")
        for status in files.listStatus(path):
            folder = status.getPath().getName()
            if folder.startswith(f"{RUN}=") and folder.removeprefix(f"{RUN}=") not in wanted:
                files.delete(status.getPath(), True)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
