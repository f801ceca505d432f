"""Stored tables: a shared work folder, lineage cuts, and versioned snapshots with one current version each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only on one machine may the session name none, and a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not hasattr(shared_folder, "own"):
            shared_folder.own = tempfile.mkdtemp(prefix="rivulet-")
        base = f"file://{shared_folder.own}"
    return base.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/rivulet/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, stored in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*stored: DataFrame) -> None:
    """Deletes tables that ``cut`` has stored, once nothing will read them again."""
    for df in stored:
        _delete(df.sparkSession, df.stored_at)


def release_all(spark: SparkSession) -> None:
    """Deletes all that this application has stored between steps; results read from it must be written elsewhere by then."""
    _delete(spark, work_folder(spark))


class Store:
    """Tables as immutable snapshots ``name/v=N`` and a pointer to the current one. One writer at a time.

    A change reads the current snapshot, writes the next one and then moves the pointer, so readers never see half of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        """0 where there is no table yet."""
        fs, folder = self._fs(f"{self.root}/{name}/current")
        if not fs.exists(folder):
            return 0
        return max([0, *(int(s.getPath().getName()) for s in fs.listStatus(folder))])

    def read(self, name: str) -> DataFrame:
        v = self.version(name)
        if not v:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={v:06d}")

    def write(self, name: str, df: DataFrame, partition_by: str | None = None, sort_by: str | None = None) -> int:
        v = self.version(name) + 1
        if sort_by:
            df = df.sortWithinPartitions(sort_by)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v={v:06d}")
        fs, mark = self._fs(f"{self.root}/{name}/current/{v:06d}")
        fs.create(mark, True).close()  # the new version counts from here
        return v

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes all but the newest snapshots."""
        for v in range(1, self.version(name) - keep + 1):
            for path in (f"{self.root}/{name}/v={v:06d}", f"{self.root}/{name}/current/{v:06d}"):
                fs, p = self._fs(path)
                fs.delete(p, True)
