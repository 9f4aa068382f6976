"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Language ID drops texts without a language; line deduplication takes repeated lines out; Order MinHash keeps one
document of each class of near copies; decontamination drops documents with benchmark passages; the rest is packed.

A stage takes the written rows of the stage before.  So whatever that one had staged on its way is deleted when the
next one begins; if its rows were not written and read again, it stays until the session ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, language_id, line_dedup, order_minhash, packing
from colloquy.llm.common import discard, discard_paths, read_from, stage, staged_paths, table

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: set[str] = set()


def _after(step: Step) -> Step:
    """The step, deleting first what the step before it left, if ``docs`` is a written table."""

    @wraps(step)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        source = read_from(docs)
        if step.__name__ != "known_language" and source and not any(path in source for path in _left):
            discard_paths(spark, set(_left))
        _left.clear()
        before = staged_paths()
        out = step(spark, docs, sf_dir)
        _left.update(staged_paths() - before)
        return out

    return tidied


@_after
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language; null texts and texts without a letter go, repeated rows all stay."""
    return language_id.keep_known(docs)


@_after
def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier one has; n_chars, if there, follows.  Those left without a word go."""
    cut = line_dedup.remove_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@_after
def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the first by id; texts under five words are compared whole."""
    return order_minhash.keep_first(docs)


@_after
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark window occurs; without benchmark items all of them."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@_after
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; an empty text has one piece, its end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("near_dedup", unlike_documents),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Tokenization is beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        made = step(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        made = stage(made)
        if k:
            discard(docs)
        docs = made
    return docs
