"""Finished steps of a long job, kept in a folder of the shared store.

A job that lost its driver is begun again with the same folder and goes on after its last finished step. A step counts
as finished once its tables are written and its entry is in the journal, in this order; what a lost step had
written by then is never read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "step long, job string, state string"


class Journal:
    """Entries of one job under ``folder``; ``state`` is that of the last finished step, or None.

    ``job`` describes what is computed. A folder with entries of another job is refused. The input data are not
    compared: a folder belongs to one run over the same data.
    """

    def __init__(self, spark: SparkSession, folder: str, job: str):
        self.spark, self.job, self.path = spark, job, f"{folder.rstrip('/')}/journal"
        self._append(0, None)
        entries = spark.read.schema(ENTRY).parquet(self.path)
        last = entries.agg(F.count_if(F.col("job") != job).alias("others"), F.max("step").alias("step"),
                           F.max_by("state", "step").alias("state")).first()
        if last["others"]:
            raise ValueError(f"{folder} holds the steps of another job than {job}")
        self.step = last["step"]
        self.state = json.loads(last["state"]) if last["state"] else None

    def record(self, **state) -> None:
        """Note a finished step. Tables must be those of a scratch, and are noted by where they lie."""
        self.step, self.state = self.step + 1, {name: self._note(value) for name, value in state.items()}
        self._append(self.step, json.dumps(self.state))

    def table(self, note: dict) -> DataFrame:
        """A table that an entry names."""
        table = self.spark.read.schema(T.StructType.fromJson(note["schema"])).parquet(note["path"])
        table._wayfield_path = note["path"]
        return table

    def _note(self, value):
        if isinstance(value, DataFrame):
            return {"path": value._wayfield_path, "schema": value.schema.jsonValue()}
        return [self._note(v) for v in value] if isinstance(value, list) else value

    def _append(self, step: int, state: str | None) -> None:
        (self.spark.createDataFrame([(step, self.job, state)], ENTRY).coalesce(1).write.mode("append").parquet(self.path))
