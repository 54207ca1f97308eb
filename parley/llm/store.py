"""Where the operators keep intermediate tables, and how they cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[int, tuple[DataFrame, str]] = {}


#: Bytes of a batch that Spark hands to Python. Its own default lets ten thousand long texts meet in one.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH`` bytes, unless they are smaller already."""
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH[0])))
    if not 0 < now <= BATCH[1]:
        spark.conf.set(BATCH[0], str(BATCH[1]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new local one for a local master, else an error."""
    bound_batches(spark)
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parley-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint its size is known to Catalyst, which can then pick a broadcast
    join for it under the session's own threshold. The files stay until ``discard``, or are left
    to the owner of the folder, as checkpoints are.
    """
    path = new_path(df.sparkSession, name)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system the session reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``table`` from which nothing will be read again."""
    for df in tables:
        if id(df) in _paths:
            remove(df.sparkSession, _paths.pop(id(df))[1])
