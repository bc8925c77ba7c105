"""Materialised intermediate tables in the folder that the whole cluster shares.

Long lineages are cut by writing Parquet under ``spark.checkpoint.dir`` (set by
the cluster).  Only where that setting is absent and the master is local, as in
unit tests, a local folder is chosen and set on the session's context.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="rillspan-")
    sc.setCheckpointDir(made)
    return made


class Work:
    """A private folder for one query's intermediate tables.

    ``save`` writes a table and returns a DataFrame that scans it; ``drop``
    deletes tables that no later step reads.  What is left goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rillspan/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.root}/{table}")
        return self.load(table)

    def load(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._fs.delete(self._path(f"{self.root}/{table}"), True)

    def release(self) -> None:
        """Let the driver's cleaner delete shuffle files of plans that are done."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
