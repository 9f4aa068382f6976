"""Memory tables fed by a stream: one commit per micro-batch.

A batch first writes its messages and the fact versions of the buckets it touches to folders of its own; then a single
file in ``_commits`` names them, together with the folders of all other buckets.  That file is the commit: before it is
there nothing of the batch is seen, and a batch that has one is not done again.  Facts are bucketed by (persona, key).
Only the active rows of touched buckets are read; closed versions only where something came late.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.memory import fact_candidates, supersede

KEYS = ["persona_id", "key"]
BUCKETS = 64
#: Folders of closed versions of a bucket, after which they are written together.
MOST_FOLDERS = 16


def batch_facts(messages: DataFrame, persona: str = "chat_id") -> DataFrame:
    """Fact rows of a batch of messages (persona, message_id, ts, text)."""
    return fact_candidates(messages).select(
        F.concat_ws("_", F.lit("l2"), F.col(persona).cast("string"), F.col("message_id").cast("string")).alias("id"),
        F.col(persona).cast("string").alias("persona_id"),
        F.lit("L2").alias("layer"),
        "category",
        "key",
        "value",
        "importance_score",
        F.col("ts").alias("valid_from"),
        "confidence",
        F.col("ts").alias("created_at"),
    )


def _at(spark: SparkSession, path: str):
    """The Hadoop file system and path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _commit_file(path: str, batch_id: int) -> str:
    return f"{path}/_commits/{batch_id:020d}.json"


def last_commit(spark: SparkSession, path: str) -> dict | None:
    """What the newest commit names: schema, messages, active and closed folders by bucket."""
    fs, folder = _at(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return None
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json"))
    if not names:
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/_commits/{names[-1]}", wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, batch_id: int, named: dict) -> bool:
    """Make the file appear at once under its name; false if the batch had been committed meanwhile."""
    fs, target = _at(spark, _commit_file(path, batch_id))
    _, draft = _at(spark, f"{path}/_commits/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(named).encode()))
    out.close()
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def _read(spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_batch(path: str, persona: str = "chat_id", facts: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS):
    """A ``foreachBatch`` function that adds the messages and fact versions of a batch in one commit.

    ``facts`` makes the versions (id, persona_id, key, valid_from and any other columns) of a batch.  The result is
    the same as ``supersede`` over all batches, in whatever order versions arrive; ids are taken as unique.
    """
    of = facts or (lambda batch: batch_facts(batch, persona))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, target = _at(spark, _commit_file(path, batch_id))
        if fs.exists(target):
            return
        before = last_commit(spark, path) or {"messages": [], "active": {}, "closed": {}}
        own = f"{batch_id}-{uuid.uuid4().hex}"
        # The batch is read once: its facts are made from what it wrote.
        batch.write.parquet(f"{path}/messages/{own}")
        kept = spark.read.schema(batch.schema).parquet(f"{path}/messages/{own}")
        arrived = of(kept).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
        schema = arrived.drop("bucket").withColumn("valid_to", F.lit(None).cast(arrived.schema["valid_from"].dataType)).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        touched = {str(r.bucket) for r in arrived.select("bucket").distinct().collect()}  # bucket numbers
        active = _read(spark, columns, [before["active"][b] for b in touched if b in before["active"]])
        # Where a version comes before the active one of its key, or folders have piled up, closed versions are read too.
        newest = active.groupBy(*KEYS).agg(F.max(F.struct("valid_from", "id")).alias("newest"))
        late = arrived.join(newest, KEYS).filter(F.struct("valid_from", "id") < F.col("newest"))
        again = {str(r.bucket) for r in late.select("bucket").distinct().collect()}
        again |= {b for b in touched if len(before["closed"].get(b, [])) >= MOST_FOLDERS}
        closed = _read(spark, columns, [f for b in sorted(again) for f in before["closed"].get(b, [])])
        number = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")
        known = active.unionByName(closed).drop("valid_to").withColumn("bucket", number)
        merged = supersede(arrived.unionByName(known), KEYS).withColumn("state", F.when(F.col("valid_to").isNull(), "active").otherwise("closed"))
        # One file a bucket and task.
        merged.repartition("state", "bucket", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("state", "bucket").parquet(f"{path}/facts/{own}")
        fresh = {}
        for state in ("active", "closed"):
            fs, folder = _at(spark, f"{path}/facts/{own}/state={state}")
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            fresh[state] = {n.split("=")[1]: f"{path}/facts/{own}/state={state}/{n}" for n in names if n.startswith("bucket=")}
        after = dict(before["closed"])
        for b in touched:
            added = [fresh["closed"][b]] if b in fresh["closed"] else []
            after[b] = added if b in again else [*after.get(b, []), *added]
        _commit(spark, path, batch_id, {
            "schema": columns, "messages": f"{path}/messages", "active": before["active"] | fresh["active"], "closed": after,
            "batches": [*before.get("batches", []), own],
        })

    return write


def committed_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages of all committed batches; what a failed try left is not among them."""
    named = last_commit(spark, path)
    return spark.read.parquet(*[f"{named['messages']}/{own}" for own in named["batches"]])


def active_table(spark: SparkSession, path: str) -> DataFrame:
    """The active version of every key, of the newest commit."""
    named = last_commit(spark, path)
    return _read(spark, named["schema"], sorted(named["active"].values()))


def current_facts(spark: SparkSession, path: str) -> DataFrame:
    """All fact versions committed so far, each closed by the next one with its key."""
    named = last_commit(spark, path)
    closed = [f for folders in named["closed"].values() for f in folders]
    return reduce(DataFrame.unionByName, [active_table(spark, path), _read(spark, named["schema"], sorted(closed))])
