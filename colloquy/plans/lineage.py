"""Cutting lineage through the checkpoint folder the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of its own only in a local session that names none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="colloquy-checkpoints-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and read them from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as Parquet: smaller, read by column, and of a size that the planner knows.  Deleted when the session ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written.append((df.sparkSession, path))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote and nothing unfinished reads any more."""
    for frame in frames:
        _delete(frame.sparkSession, frame.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone, and its scratch folder with it
            return
