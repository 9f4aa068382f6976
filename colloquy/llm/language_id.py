"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a reference text, made from a bounded sample
of labelled documents.  A text is parsed greedily into longest matches with the reference; the
language whose reference needs the fewest phrases, each weighted by the bits of a position in the reference,
wins.  Whole texts are parsed, in blocks of ``BLOCK`` bytes (a phrase ends at the end of its block), so
that many blocks walk through the automaton side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import held_out, ship, text_of

FOLDS = 5
#: Bounds of the labelled sample: documents per language, characters read of each, bytes of a reference.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 1024
REFERENCE_BYTES = 48_000
#: More labels than this is an error: the automata are broadcast.
MAX_LANGUAGES = 256
BLOCK = 1024
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-case letters and marks; whatever stands between is one space; empty if there is no letter."""
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")).otherwise("")


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the empty string, every path spells a substring."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def parser(reference: list[bytes], class_of: np.ndarray, classes: int) -> np.ndarray:
    """The greedy parse as a table: at state * classes + symbol class stand next state * 4 + phrases ended there."""
    # Class 0 marks the seams of the sample; it never occurs in a text, nor does it match.
    joined = b"\0".join(class_of[np.frombuffer(r, np.uint8)].tobytes() for r in reference)
    step = suffix_automaton(joined)
    root = np.zeros(classes, np.int32)
    fresh = np.ones(classes, np.int32)  # a symbol that the reference lacks is a phrase of its own
    for c, to in step[0].items():
        if c:
            root[c], fresh[c] = to, 0
    rows = np.empty((len(step), classes), np.int32)
    rows[0] = root * 4 + fresh
    rows[1:] = root * 4 + fresh + 1  # the phrase so far ends, the symbol opens the next
    for s, moves in enumerate(step):
        for c, to in moves.items():
            if c:
                rows[s, c] = to * 4
    return rows.ravel()


def count_phrases(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], classes: int) -> np.ndarray:
    """Phrases of each text for each table; ``data`` holds symbol classes, text i lies at offsets[i:i+2]."""
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), blocks)
    nr = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[owner] + nr * BLOCK
    left = np.minimum(BLOCK, size[owner] - nr * BLOCK)
    order = np.argsort(-left, kind="stable")
    owner, start, left = owner[order], start[order], left[order]
    out = np.zeros((len(size), len(tables)), np.int64)
    if not len(owner):
        return out
    alive = np.searchsorted(-left, -np.arange(left[0]), side="left")  # blocks longer than t
    state = np.zeros((len(tables), len(owner)), np.int32)
    ended = np.zeros((len(tables), len(owner)), np.int32)
    for t, k in enumerate(alive):
        symbol = data[start[:k] + t]
        for j, table in enumerate(tables):
            v = table[state[j, :k] * classes + symbol]
            state[j, :k] = v >> 2
            ended[j, :k] += v & 3
    ended += state > 0
    for j in range(len(tables)):
        out[:, j] = np.bincount(owner, ended[j], len(size))
    return out


def references(docs: DataFrame, folds: int = FOLDS) -> dict[str, list[bytes]]:
    """Bounded reference texts by language, from labelled documents outside the held-out fold.

    Each document lends ``SAMPLE_CHARS`` characters from a hashed place of its whole text, so openings that many
    documents share do not fill the references.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds)).withColumn("text", text_of())
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id", F.length("text")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = labelled.select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), "doc_id", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("text"),
    )
    rows = rows.withColumn("text", letters(F.col("text"))).filter(F.length("text") > 1)
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    sample = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_DOCS)
    texts: dict[str, list[bytes]] = {}
    for r in sample.orderBy("lang", "rank").limit(SAMPLE_DOCS * MAX_LANGUAGES + 1).collect():
        own = texts.setdefault(r.lang, [])
        room = REFERENCE_BYTES - sum(map(len, own))
        if room > 0:
            own.append(r.text.encode()[:room])
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return texts


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits (per language, in order of name).

    ``docs``: (doc_id, text, lang, ...).  score is 1 - best / second best, from 0 (a tie, broken by the name) to 1
    (a single language); null texts and texts without a letter are ``und`` with score 0, as is everything if no
    label is there to learn from.  A null doc_id stays null; repeated rows have one result each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), letters(text_of()).alias("__letters"))
    return _predicted(rows, docs, folds, "lang_pred string, score double, bits array<double>")


def keep_known(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The documents with a language, that is not ``und``, with all their columns; a missing lang is filled in."""
    found = _predicted(docs.withColumn("__letters", letters(text_of())), docs, folds, "__pred string, __score double, __bits array<double>")
    return found.filter(F.col("__pred") != UNKNOWN).withColumn("lang", F.coalesce("lang", "__pred")).select(*docs.columns)


def _predicted(rows: DataFrame, docs: DataFrame, folds: int, added: str) -> DataFrame:
    """``rows`` with predictions in place of the column ``__letters``, which comes last."""
    texts = references(docs, folds)
    names = sorted(texts)
    seen = np.unique(np.frombuffer(b"".join(b"".join(t) for t in texts.values()), np.uint8))
    # Class 0: seams; class 1: bytes that no reference holds.
    class_of = np.full(256, 1, np.uint8)
    class_of[seen] = np.arange(2, 2 + len(seen))
    classes = 2 + len(seen)
    model = docs.sparkSession.sparkContext.broadcast([parser(texts[n], class_of, classes) for n in names])
    weight = np.array([math.log2(2 + sum(map(len, texts[n]))) for n in names])
    schema = StructType([f for f in rows.schema if f.name != "__letters"] + StructType.fromDDL(added).fields)
    out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = class_of[np.frombuffer(column.buffers()[2] or b"", np.uint8)]
            size = np.diff(offsets)
            if names:
                bits = count_phrases(data, offsets, model.value, classes) * weight / np.maximum(size, 1)[:, None]
                ranked = np.sort(bits, axis=1)
                best = bits.argmin(axis=1)
                score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(names) > 1 else np.ones(len(size))
            else:
                bits, best, score = np.zeros((len(size), 0)), np.zeros(len(size), int), np.zeros(len(size))
            known = (size > 0) & (len(names) > 0)
            made = [pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(list(bits), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=out)

    return rows.mapInArrow(run, schema)


ship(__name__)
