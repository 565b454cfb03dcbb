"""Tables of the engine in the shared folder: written, cleared and renamed by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.functions.storage import shared_dir


class Table:
    """Rows in a folder per value of one string column; writes replace only the values they hold."""

    def __init__(self, spark: SparkSession, name: str, by: str):
        self.spark, self.by = spark, by
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._schema = None

    def write(self, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Replace the partitions of the rows; with keys, rows that repeat them are written once."""
        rows = rows if keys is None else rows.dropDuplicates(keys)
        self._schema = rows.schema
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)

    def read(self) -> DataFrame:
        if self._schema is None:
            raise ValueError("nothing was written")
        names = self._schema.names
        return self.spark.read.schema(self._schema).parquet(self.path).select(*names)

    def _folder(self, value: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.by}={value}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def clear(self, value: str) -> None:
        path, fs = self._folder(value)
        fs.delete(path, True)

    def rename(self, value: str, new: str) -> None:
        """Rows of one value get another, without being rewritten."""
        path, fs = self._folder(value)
        target, _ = self._folder(new)
        if fs.exists(target):
            raise ValueError(f"{new} is there already")
        if not fs.rename(path, target):
            raise ValueError(f"{value} could not be renamed")

    def prune(self, ids: DataFrame, key: str) -> DataFrame:
        """The rows whose key is among the ids; the others are orphans."""
        return self.read().join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
