"""Named datasets in one folder, always read for one tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.sources.readers import FORMATS, load_dataset


class DatasetRegistry:
    """Finds ``<root>/<name>.<format>`` and filters it to one tenant.

    The tenant filter prunes partitions when the dataset was saved partitioned
    by ``companyfn``.  A dataset without that column is refused unless
    ``shared=True`` says that it belongs to nobody in particular.
    """

    def __init__(self, spark: SparkSession, root: str, companyfn: str, keep: bool = False):
        self.spark, self.root, self.companyfn, self.keep = spark, root.rstrip("/"), companyfn, keep
        self._kept: dict[str, DataFrame] = {}

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def load(self, name: str, shared: bool = False, schema=None) -> DataFrame:
        if name in self._kept:
            return self._kept[name]
        for fmt in FORMATS:
            path = f"{self.root}/{name}.{fmt}"
            if self._exists(path):
                break
        else:
            raise FileNotFoundError(f"Dataset not found: {name}")
        df = load_dataset(self.spark, path, fmt, schema)
        if "companyfn" in df.columns:
            df = df.where(F.col("companyfn") == self.companyfn)
        elif not shared:
            raise ValueError(f"dataset {name} has no companyfn column; pass shared=True to read it anyway")
        if self.keep:
            self._kept[name] = df.persist()
            return self._kept[name]
        return df
