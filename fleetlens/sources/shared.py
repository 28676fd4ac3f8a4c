"""Folders and files that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path: in the one that the cluster names, else in the warehouse; on the driver's own machine only where
    Spark runs on that machine alone (tests)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        alone = spark.sparkContext.master.startswith("local")
        top = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp") if alone else spark.conf.get("spark.sql.warehouse.dir")
        if not alone and top.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of each machine's own")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more; at the latest the end of the driver does, while its session is there."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            Files(spark, path).store.delete(Files(spark, path).at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as written once into a new shared folder: its rows and their order in each file stay as they are."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and whole folders of a store, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, top: str) -> None:
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.top, self.at = top, self.path(top)
        self.store = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, name: str):
        return self.path(f"{self.top}/{name}")

    def names(self, name: str) -> list[str]:
        where = self.of(name)
        return sorted(s.getPath().getName() for s in self.store.listStatus(where)) if self.store.exists(where) else []

    def put(self, name: str, text: str) -> bool:
        """Writes a file beside its name and renames it; False where the name is taken."""
        new = self.of(f"{name}.{uuid.uuid4().hex}.new")
        out = self.store.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.store.exists(self.of(name)) and self.store.rename(new, self.of(name)):
            return True
        self.store.delete(new, False)
        return False

    def delete(self, name: str) -> None:
        self.store.delete(self.of(name), True)
