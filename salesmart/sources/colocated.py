"""Headers and lines stored side by side: dealt into buckets by the order key, each sorted by it.

Whatever joins them on that key afterwards reads bucket by bucket: no row is
shuffled and none is sorted again.  It pays when more than one job of a night
joins the two.  The tables live in the session's catalog (a shared metastore on
a cluster), their files in the given folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_KEY = "uniquenum_pri"
BUCKET_BYTES = 256 << 20


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES, least: int = 8) -> int:
    """A power of two, so that tables of other sizes can still be joined bucket by bucket."""
    wanted = max(least, -(-total_bytes // bucket_bytes))
    return 1 << (wanted - 1).bit_length()


def store_colocated(df: DataFrame, table: str, path: str, buckets: int,
                    columns: Sequence[str] | None = None, key: str = ORDER_KEY) -> DataFrame:
    """Write some columns of ``df`` as one sorted file a bucket, and read it back as a table.

    The exchange deals rows by the same hash as the buckets, so every task writes
    one file.  Rows without a key can join nothing and are left out.
    """
    rows = (df.select(*columns) if columns else df).where(F.col(key).isNotNull())
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path)
     .saveAsTable(table))
    return df.sparkSession.table(table)


def drop_colocated(spark: SparkSession, *tables: str) -> None:
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
