"""Reading tables: parameterised SQL, filtered scans, joins and descriptions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Filters = Mapping[str, Any]

FORMATS = ("parquet", "csv", "json")  # also the order in which a dataset is looked for


def run_sql(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Any SQL text over registered views, with ``:name`` parameters."""
    return spark.sql(query, args=dict(params or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, lower: Any, upper: Any,
              partitions: int, fetch_size: int = 10_000,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table read in ``partitions`` parallel ranges of ``key``.

    Credentials and driver come from the caller; filters and columns applied to
    the result are pushed into the database's query.
    """
    return (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), fetchsize=str(fetch_size),
            **dict(properties or {}),
        ).load()
    )


def condition_of(filters: Filters) -> Column:
    """AND of ``column IN (...)`` for lists and ``column = value`` for scalars."""
    terms = [
        F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
        for name, value in filters.items()
    ]
    return reduce(Column.__and__, terms, F.lit(True))


def _finish(df: DataFrame, columns: Sequence[str] | None, filters: Filters | None,
            limit: int | None) -> DataFrame:
    if filters:
        df = df.where(condition_of(filters))
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit else df


def read_table(source: DataFrame, columns: Sequence[str] | None = None,
               filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    """Projection, AND-ed filters and an optional row limit."""
    return _finish(source, columns, filters, limit)


def read_joined(left: DataFrame, right: DataFrame, condition: str,
                columns: Sequence[str] | None = None, filters: Filters | None = None,
                limit: int | None = None, names: tuple[str, str] = ("main", "data")) -> DataFrame:
    """Inner join on a condition text such as ``main.id = data.id``."""
    joined = left.alias(names[0]).join(right.alias(names[1]), F.expr(condition), "inner")
    return _finish(joined, columns, filters, limit)


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability, default, row count."""
    fields = [
        (i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO",
         f.metadata.get("CURRENT_DEFAULT"))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    columns = df.sparkSession.createDataFrame(
        fields, "position int, column_name string, data_type string, is_nullable string, "
                "column_default string")
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    return columns.crossJoin(F.broadcast(rows))


SCHEMA_FILE = "_salesmart_schema.json"  # Spark does not read files with this first letter


def saved_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema that a dataset was saved with, if it was saved by this library."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SCHEMA_FILE}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return None
    stream = files.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return StructType.fromJson(json.loads(text))


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Read a saved dataset; the format defaults to the path's suffix.

    Types are those the dataset was saved with, so codes such as ``001`` stay
    text.  For other folders they are inferred, but a tenant is always text.
    """
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    schema = saved_schema(spark, path) if schema is None else schema
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(fmt).load(path)
    if schema is None and "companyfn" in df.columns and df.schema["companyfn"].dataType != StringType():
        as_text = StructType([StructField("companyfn", StringType()) if f.name == "companyfn" else f
                              for f in df.schema.fields])
        df = reader.schema(as_text).format(fmt).load(path)
    return df
