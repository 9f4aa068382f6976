"""Writing and reading results: splits, profile packages, fingerprints, memory dumps."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split_jsonl(turns: DataFrame, path: str, split: str = "split") -> None:
    """One JSON line per sample, one folder per split."""
    turns.write.mode("overwrite").partitionBy(split).json(path)


def read_split_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: 16 hex digits that depend on the rows but not on their order.

    Row hashes are added as two exact halves, so the sum is the same for every partitioning and
    counts repeated rows.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(digest, s, 12), 16, 10).cast("decimal(38,0)") for s in (1, 13)]
    sums = df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string").alias(f"h{i}") for i in (0, 1)]
    )
    return sums.select(
        "rows", F.substring(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "h0", "h1"), 256), 1, 16).alias("fingerprint")
    )


def write_profile_tables(tables: dict[str, DataFrame], path: str, **labels: str) -> DataFrame:
    """Write a package of tables and return its manifest (component, rows, fingerprint, labels, package, place).

    The tables go to a place of their own; one manifest file, added last, makes them the newest package.  Until then, and
    if the write breaks off, ``path`` holds what it held before.  Of two packages written at once, with one number, the later
    place in order counts.  Earlier packages stay until someone deletes their places.  Without tables it is an error.
    """
    if not tables:
        raise ValueError("a package needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    before = _manifests(spark, path)
    package = 1 + (0 if before is None else before.agg(F.max("package")).first()[0])
    place = f"{path}/package-{package}-{uuid.uuid4().hex}"
    manifest = None
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
        row = table_fingerprint(spark.read.parquet(f"{place}/{name}")).select(F.lit(name).alias("component"), "rows", "fingerprint")
        manifest = row if manifest is None else manifest.unionByName(row)
    for key, value in labels.items():
        manifest = manifest.withColumn(key, F.lit(value))
    manifest = manifest.withColumns({"package": F.lit(package).cast("long"), "place": F.lit(place)})
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return read_profile_manifest(spark, path)


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests of all packages of a path, None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_profile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the newest whole package."""
    all_ = _manifests(spark, path)
    if all_ is None:
        raise ValueError(f"no package in {path}")
    newest = all_.orderBy(F.desc("package"), F.desc("place")).select("place").first()
    return all_.filter(F.col("place") == newest.place)


def read_profile_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest whole package by name."""
    rows = read_profile_manifest(spark, path).select("component", "place").collect()
    return {r.component: spark.read.parquet(f"{r.place}/{r.component}") for r in rows}


def export_memories(memories: DataFrame, path: str) -> None:
    memories.write.mode("overwrite").json(path)
