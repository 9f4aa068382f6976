"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(name: str) -> None:
    """Executors need not have this package installed: the module's functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; a null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_written: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="colloquy-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there: cuts lineage, survives lost executors.

    The files are deleted by ``discard``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colloquy-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged rows that nothing unfinished reads any more."""
    for df in staged:
        discard_paths(df.sparkSession, {df.staged_at})


def staged_paths() -> set[str]:
    """Where the rows staged so far lie."""
    return {path for _, path in _written}


def discard_paths(spark: SparkSession, paths: set[str]) -> None:
    """As ``discard``, by path."""
    for path in paths:
        _delete(spark, path)
    _written[:] = [w for w in _written if w[1] not in paths]


def read_from(df: DataFrame) -> str | None:
    """Where a table comes from that is read as it is; None for rows that something makes."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.relation().location().rootPaths().mkString(",") if plan.nodeName() == "LogicalRelation" else None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone, and its scratch folder with it
            return


_POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_HIGH = np.multiply.accumulate(np.full(4096, _POWERS[-1], np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes where ``inside`` holds, and where the runs start."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), first
    origin = np.zeros(len(data), np.int64)
    origin[first] = first
    offset = np.arange(len(data)) - np.maximum.accumulate(origin)
    value = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 4095] * _HIGH[offset >> 12 & 4095]
    value[~inside] = 0
    return mix(np.add.reduceat(value, first)), first


def hash_pieces(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of bytes that begin at the places ``first`` and end where the next one begins."""
    if not len(first):
        return np.zeros(0, np.uint64)
    part = data[first[0] :]
    offset = np.arange(len(part)) - np.repeat(first - first[0], np.diff(np.append(first, len(data))))
    value = (part.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 4095] * _HIGH[offset >> 12 & 4095]
    return mix(np.add.reduceat(value, first - first[0]))


#: Bits of a filter over digests.  The size is fixed: more digests than bits let more rows pass, and cost time only.
FILTER_BITS = 1 << 24


def bit_filter(digests: DataFrame, column: str, bits: int = FILTER_BITS) -> Broadcast:
    """A broadcast bit table that has the bit of every digest of the column; bits / 8 bytes (2 MB), whatever the input."""
    bit = F.pmod(column, F.lit(bits))
    parts = (
        digests.groupBy(F.floor(bit / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit % 32768 + 1)).alias("bits"))
        .collect()  # at most bits / 32768 rows of 4 KB
    )
    table = np.zeros(bits // 8, np.uint8)
    for r in parts:
        table[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return digests.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which digests may be in the filter."""
    bit = digests % (8 * len(table))
    return table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0


def only(df: DataFrame, columns: list[str], shared: Broadcast) -> DataFrame:
    """The rows of which one of the (long) columns may be in the filter."""
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in places:
                keep |= passes(shared.value, batch.column(k).to_numpy())
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


ship(__name__)
