"""Writing datasets and reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.session import tidy_writes
from salesmart.sources.readers import FORMATS, SCHEMA_FILE

#: a dataset whose plan reads no more bytes is written in one go
SLICED_FROM = 128 << 20


def save_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by: Sequence[str] = ("companyfn",), whole: bool = False, slices: int = 1) -> None:
    """Write a dataset as a folder of ``fmt`` files, partitioned by tenant.

    Only the partitions present in ``df`` are replaced; with ``whole`` the
    folder afterwards holds ``df`` and nothing else.  The schema is
    saved beside the files, so that loading restores it.  Rows are brought together
    by partition first, so that not every task writes a file into every folder;
    adaptive execution splits a partition that is too large for one task.

    With ``slices`` a large ``df`` is made and written in so many passes, told apart
    by its whole-number partition columns (the months), and a pass deletes what
    it has shuffled before the next begins.  For wide rows: these take several
    times the room in a shuffle that they take in the files.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    keys = [c for c in partition_by if c in df.columns]
    months = [c for c in keys if isinstance(df.schema[c].dataType, T.IntegralType)]
    passes = slices if months and slices > 1 and bytes_read(df) > SLICED_FROM else 1
    for i in range(passes):
        # all rows of a partition are of one pass
        rows = df if passes == 1 else df.where(F.pmod(F.xxhash64(*months), F.lit(passes)) == i)
        if keys:
            rows = rows.hint("rebalance", *keys)
        writer = rows.write.mode("append" if whole and i else "overwrite").format(fmt)
        writer = writer.option("partitionOverwriteMode", "static" if whole else "dynamic")
        if fmt == "csv":
            writer = writer.option("header", True)
        if keys:
            writer = writer.partitionBy(*keys)
        with tidy_writes(df.sparkSession):
            writer.save(path)
    write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", df.schema.json())


def bytes_read(df: DataFrame) -> int:
    """What Spark takes the files and cached tables to hold that ``df`` is made from.

    Sources whose size Spark does not know, such as a database, count nothing: they are read once.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 62)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then moved onto its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(text.encode())
    out.close()
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)


def save_report(df: DataFrame, path: str) -> None:
    """Write a small report as JSON lines."""
    df.write.mode("overwrite").json(path)
