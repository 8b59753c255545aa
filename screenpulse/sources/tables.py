"""Source files as text columns, and folders that appear only once they are complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SOURCE_COLUMNS


def read_source(spark: SparkSession, path: str, name: str, partitions: int | None = None) -> DataFrame:
    """A gzip TSV with a header, every column text; \\N is null, an empty field is empty, quotes are plain.

    A gzip file is one partition: give `partitions` to spread what follows.
    """
    columns = SOURCE_COLUMNS[name]
    lines = spark.read.text(path).where(F.col("value") != "\t".join(columns))
    if partitions:
        lines = lines.repartition(partitions)
    fields = lines.select(F.split("value", "\t", -1).alias("f"))
    return fields.select(*[F.nullif(F.get("f", F.lit(i)), F.lit("\\N")).alias(c) for i, c in enumerate(columns)])


class Store:
    """The file system of a folder, by Hadoop's API: local paths and any store Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        path = self._path(self.at(folder))
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(self.at(target)).getParent())
        if not self._fs.rename(self._path(self.at(source)), self._path(self.at(target))):
            raise OSError(f"can't move {self.at(source)} to {self.at(target)}")

    def put(self, path: str, name: str) -> str:
        """Copy a file of the driver into the store, where executors can read it; returns its place."""
        self._fs.mkdirs(self._path(self.at(name)).getParent())
        self._fs.copyFromLocalFile(False, True, self._path(f"file://{path}"), self._path(self.at(name)))
        return self.at(name)

    def publish(self, df: DataFrame, name: str) -> None:
        """Write df beside its place, then swap it in: a reader sees the old folder or the new one, whole.

        What was there is kept under another name until the new folder is in place, and is put back if that fails.
        """
        staged, old = f"_staging/{uuid.uuid4().hex}", f"_staging/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.at(staged))
        kept = self.exists(name)
        if kept:
            self.move(name, old)
        try:
            self.move(staged, name)
        except OSError:
            if kept:
                self.move(old, name)
            raise
        self.remove(old)
