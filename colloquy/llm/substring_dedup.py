"""Substring deduplication by hashing lines, cut further after sentences.

Units are normalised to their lower-case words, and their digests are grouped over the whole corpus; the earliest
unit of a digest, by doc_id and place, stays.  Later ones are joined to passages where they follow each other,
and a passage of at least ``MIN_WORDS`` words is to be removed; its offsets in the original text are kept.
Cutting lines after sentences gives a passage that stands in the middle of other text units of its own, and
asking for a passage spares short sentences and notices that many texts share by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bit_filter, passes, ship, stage, text_of
from colloquy.llm.line_dedup import lines_of

#: Least words of a passage; only units of at least SOLID words count, and open or close a passage.
MIN_WORDS = 15
SOLID = 4

#: Words are ASCII letters and digits, and whatever lies beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_NULL = -(1 << 63)


def _row_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def _units(column: pa.Array, sentences: bool) -> Iterator[tuple]:
    """(lines, unit numbers): numbers count the units with words of each text."""
    made = base = 0
    for x in lines_of(column, sentences, _WORD):
        counts = x.n > 0
        before = made + np.cumsum(counts) - counts
        of_doc = np.maximum.accumulate(np.where(x.number == 0, before, base))
        yield x, np.flatnonzero(counts), before - of_doc
        made, base = made + int(counts.sum()), int(of_doc[-1])


def first_units(docs: DataFrame, sentences: bool = True) -> DataFrame:
    """(d1, d2, doc, no): the earliest unit of every digest that occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for x, keep, no in _units(batch.column(1), sentences):
                d1, d2 = (d[keep] for d in x.digests())
                doc, no = ids[x.doc[keep]], no[keep]
                order = np.lexsort((no, doc, d2, d1))
                d1, d2, doc, no = d1[order], d2[order], doc[order], no[order]
                new = np.ones(len(d1), bool)
                new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(d1)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d1[at], d2[at], doc[at], no[at], n)], names=["d1", "d2", "doc", "no", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), text_of().alias("text"))
    found = rows.mapInArrow(run, "d1 long, d2 long, doc long, no long, n long")
    groups = found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "no")).alias("first"), F.sum("n").alias("n"))
    return groups.filter("n > 1").select("d1", "d2", "first.doc", "first.no")


def repeated_units(docs: DataFrame, firsts: DataFrame, sentences: bool = True) -> DataFrame:
    """(doc_id, row_key, no, start, end, n, first_doc): the units that have an earlier one."""
    shared = bit_filter(firsts, "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_keys = batch.column(0), batch.column(1)
            for x, keep, no in _units(batch.column(2), sentences):
                d1, d2 = x.digests()
                keep = keep[passes(shared.value, d1[keep])]
                owner = pa.array(x.doc[keep])
                values = [pa.array(v[keep].astype(np.int64)) for v in (no, x.start, x.end, x.n, d1, d2)]
                yield pa.RecordBatch.from_arrays([ids.take(owner), row_keys.take(owner), *values], names=["doc_id", "row_key", "no", "start", "end", "n", "d1", "d2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), text_of().alias("text"))
    found = rows.mapInArrow(run, "doc_id long, row_key long, no long, start long, end long, n long, d1 long, d2 long")
    firsts = firsts.select("d1", "d2", F.col("doc").alias("first_doc"), F.col("no").alias("first_no"))
    later = F.struct(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.col("no").alias("no")) > F.struct(F.col("first_doc").alias("doc"), F.col("first_no").alias("no"))
    return found.join(firsts, ["d1", "d2"]).filter(later).drop("d1", "d2", "first_no")


def _passages(docs: DataFrame, min_words: int, solid: int, sentences: bool) -> DataFrame:
    units = repeated_units(docs, stage(first_units(docs, sentences)), sentences)
    # Repeated rows have the same units.
    units = units.dropDuplicates(["row_key", "doc_id", "no"])
    in_text = Window.partitionBy("row_key", "doc_id").orderBy("no")
    runs = units.withColumn("run", F.col("no") - F.row_number().over(in_text)).groupBy("row_key", "doc_id", "run")
    is_solid = F.col("n") >= solid
    found = runs.agg(
        F.min(F.when(is_solid, F.struct("no", "start", "first_doc"))).alias("a"), F.max(F.when(is_solid, F.struct("no", "end"))).alias("z"),
        F.sum(F.when(is_solid, F.col("n"))).alias("n_words"),
    ).filter(F.col("n_words") >= min_words)
    return found.select(
        "doc_id", "row_key", "a.start", "z.end", (F.col("z.no") - F.col("a.no") + 1).alias("n_units"), "n_words", F.nullif(F.col("a.first_doc"), F.lit(_NULL)).alias("first_doc_id"),
    )


def passages(docs: DataFrame, min_words: int = MIN_WORDS, solid: int = SOLID, sentences: bool = True) -> DataFrame:
    """One row per passage to remove: doc_id, start, end, n_units, n_words, first_doc_id.

    start and end count code points of the original text, end exclusive; first_doc_id holds the earliest unit equal to
    the first of the passage.  Null and empty texts have no units; a null doc_id ranks before all others; rows
    that repeat a doc_id rank alike, so equal units at equal places of them all stay; other columns are ignored.
    """
    return _passages(docs, min_words, solid, sentences).drop("row_key")


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, solid: int = SOLID, sentences: bool = True) -> DataFrame:
    """All documents without their ``passages``, other columns as they are."""
    gone = _passages(docs, min_words, solid, sentences).groupBy(F.col("row_key").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__gone"))
    joined = docs.join(gone, _row_key() == F.col("__key"), "left")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.col("__gone.end"))
    nexts = F.concat(F.col("__gone.start"), F.array(F.length("text").cast("long")))
    parts = F.zip_with(bounds, nexts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))).select(*docs.columns)


ship(__name__)
