"""Intermediate tables of iterative jobs.

Every round of an iterative operator is written to a table in the shared folder named by
``spark.checkpoint.dir`` and read back. That cuts the lineage, resets size estimates to real file
sizes and survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a temporary one only for a local session."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spark-wayfield-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


class Scratch:
    """Tables written by one run of an iterative operator.

    ``folder`` is where a run that may be resumed keeps them; its tables and those of earlier attempts are its own.
    """

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        self.spark = spark
        self.path = f"{folder.rstrip('/') if folder else scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._own = folder.rstrip("/") if folder else self.path
        self._written = 0
        self._tables: list[str] = []

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` once and return it as a plain scan."""
        self._written += 1
        path = f"{self.path}/{self._written:04d}-{name}"
        df.write.parquet(path, partitionBy=partition_by)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._wayfield_path = path
        return table

    def save_bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Write ``df`` in buckets by ``keys``, for a table that many rounds join on them.

        Such a join shuffles only the other side.
        """
        self._written += 1
        path = f"{self.path}/{self._written:04d}-{name}"
        table = f"wayfield_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (df.repartition(buckets, *keys).write.format("parquet").option("path", path)
           .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
        self._tables.append(table)
        return self.spark.table(table)

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this run that no later step reads."""
        path = getattr(table, "_wayfield_path", "")
        if path.startswith(self._own):
            self._delete(path)

    def forget_tables(self) -> None:
        """Take bucketed tables that no later step reads out of the catalog."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def clear(self) -> None:
        """Delete everything this run wrote."""
        self.forget_tables()
        self._delete(self._own)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def task_slots(spark: SparkSession) -> int:
    """Partitions for steps that do much work per row, so that AQE does not fold them into few."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, 3 * spark.sparkContext.defaultParallelism)
