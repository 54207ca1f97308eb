"""Job status as it arrives: the newest row of each job, and an error for running jobs that fall silent.

State is one row a job. A timer in event time goes off when the watermark passes the end of a running job's silence; it
also frees the state of jobs that ended. Late and repeated rows change nothing. RocksDB must be the session's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "job_id string, at long, status string, message string, resumable boolean"
RUNNING = "running"


class Watch(StatefulProcessor):
    """Rows (job_id, at in milliseconds, status, message) of one job at a time."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string, message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        # Of rows of one time the greatest counts, so that their order doesn't matter.
        newest = max((int(a), s, m or "") for a, s, m in zip(found["at"], found["status"], found["message"], strict=True))
        before = tuple(self.last.get()) if self.last.exists() else None
        if before is not None and newest <= before:
            return
        self.last.update(newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(newest[0] + self.silence)
        yield self._row(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, status, _ = self.last.get()
        if status == RUNNING:
            yield self._row(key, (at, "error", "interrupted"), True)
        self.last.clear()

    @staticmethod
    def _row(key, state, resumable) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "at": [state[0]], "status": [state[1]], "message": [state[2]], "resumable": [resumable]})

    def close(self) -> None:
        pass


def job_status(log: DataFrame, silence: int = 600_000, delay: str = "10 seconds") -> DataFrame:
    """Changes of status from a stream (job_id, ts, status, message); ``silence`` in milliseconds makes a running job a resumable error."""
    rows = log.withWatermark("ts", delay).select(F.col("job_id").cast("string").alias("job_id"), "ts", F.unix_millis("ts").alias("at"), "status", "message")
    return rows.groupBy("job_id").transformWithStateInPandas(Watch(silence), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime")


def publish(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Start writing changes to ``path``; a batch that runs again after a failure replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last published status of every job."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("batch"), F.desc("at"), F.desc("resumable"))
    found = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    return found.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch")
