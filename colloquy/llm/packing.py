"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities.

A document longer than the window is first cut into full windows; the rest of it, shorter than a
window, is placed by best-fit decreasing.  Documents are dealt evenly into blocks of
``block_docs``; each block is packed on its own, so no task and no group grows with the input, and
a block is so large that its few half-empty last windows do not matter.  The ids are written piece by
piece, a window at most a row; a block holds row numbers and lengths only, and its places are joined to the pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ship, stage, text_of

WINDOW = 1024
BLOCK_DOCS = 50_000
END = 0
#: About so many ids go into one Arrow batch.
BATCH_IDS = 1 << 20

#: Texts of these characters only go through the faster encoder; it gives the same ids as ``tokenizers``.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*\Z")

_encoders: dict = {}


def encoder(path: str):
    """(plain, general): two encoders over the same tokenizer file, kept per worker."""
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        general = Tokenizer.from_file(path)
        general.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letter[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = (tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={}), general)
    return _encoders[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text with the end id, as little-endian unsigned 32-bit numbers."""
    plain, general = encoder(path)
    ids = plain.encode_ordinary(text) if PLAIN.match(text) else general.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], dtype="<u4")


def tokenized(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, doc_tokens, start, ids_crc32, ids): each full window of a document and the rest; row numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, pieces, held = TaskContext.get().partitionId() << 40, [], 0

        def rows() -> pa.RecordBatch:
            number, doc, n, start, ids = zip(*pieces)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32)))
            crcs = [zlib.crc32(x.tobytes()) for x in ids]
            columns = [*(pa.array(x, pa.int64()) for x in (number, doc, n, start, crcs)), lists]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "doc_tokens", "start", "ids_crc32", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = token_ids(text.as_py(), path)
                for i in range(0, len(ids), window):
                    pieces.append((row, doc.as_py(), len(ids), i, ids[i : i + window]))
                    held += len(pieces[-1][-1])
                    if held >= BATCH_IDS:
                        yield rows()
                        pieces, held = [], 0
                row += 1
        if pieces:
            yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, doc_tokens long, start long, ids_crc32 long, ids array<int>")


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Window number and offset of every piece (1 <= length < window), and the number of windows.

    Pieces are placed longest first, each into the open window with the least room that suffices.
    The leaves of the tree are the remaining capacities; an inner node counts the open windows below.
    """
    leaves = 1 << (window - 1).bit_length()
    tree = [0] * (2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(leaves)]
    number, offset, windows = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        # Least leaf >= need with an open window: climb until a right neighbour has one, then descend.
        node = need + leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - leaves
            w = open_at[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, w, windows = window, windows, windows + 1
        number[i], offset[i] = w, window - room
        room -= need
        if room:
            open_at[room].append(w)
            node = room + leaves
            while node:
                tree[node] += 1
                node >>= 1
    return number, offset, windows


def pack(docs: DataFrame, path: str, window: int = WINDOW, block_docs: int = BLOCK_DOCS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``docs``: (doc_id, text, ...); other columns are ignored.  Null text is empty text, which is one
    piece of one id, the end.  A null doc_id stays null; repeated rows are packed once each.  An empty
    table gives no rows.  A document of n * window ids has n pieces.
    """
    pieces = stage(tokenized(docs, path, window))
    rows = pieces.filter("start = 0").select("row", "doc_tokens")
    blocks = max(1, -(-rows.count() // block_docs))
    # Dealt by row number: no id, however frequent, fills a block.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        tokens = group.column("doc_tokens").to_numpy()
        rest = tokens % window
        tail = np.flatnonzero(rest)
        number, offset, windows = best_fit(rest[tail].tolist(), window)
        base = key[0].as_py() << 36
        sequence, start = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        sequence[tail], start[tail] = number, offset
        full = tokens // window
        first = windows + np.cumsum(full) - full
        out = group.select(["row"])
        for name, values in (("first_full", base + first), ("tail_sequence", base + sequence), ("tail_offset", start)):
            out = out.append_column(name, pa.array(values))
        return out

    placed = rows.groupBy("block").applyInArrow(place, "row long, first_full long, tail_sequence long, tail_offset long")
    is_full = F.col("start") + window <= F.col("doc_tokens")
    out = [
        "doc_id",
        "start",
        F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("start")).alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(is_full, F.col("first_full") + F.floor(F.col("start") / window)).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(is_full, F.lit(0).cast("long")).otherwise(F.col("tail_offset")).alias("offset"),
    ]
    if with_ids:
        out.append("ids")
    return pieces.join(placed, "row").select(*out)


def digests(packed: DataFrame) -> DataFrame:
    """``pack`` without the ids, and ids_crc32 computed from the ids that it gave."""
    names = [c for c in packed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
            values = lists.flatten().to_numpy().astype("<u4")
            crcs = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip([0, *ends], ends)], pa.int64())
            yield pa.RecordBatch.from_arrays([crcs if c == "ids_crc32" else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return packed.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in packed.dtypes if c != "ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token windows from ``pack``, at most one window of ids a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


ship(__name__)
