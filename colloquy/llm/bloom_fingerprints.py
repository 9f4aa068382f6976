"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces: at line ends, and inside long paragraphs where a hash of the last bytes says so, so that an
edit changes only the pieces it touches, in any script.  Each piece's digest (with its occurrence number in the text,
so repeats count) is added to one cell in each of three parts of a sketch: a count, the XOR of the digests and the
XOR of their checks.  The sketches of two versions are subtracted cell by cell; what both have cancels, and peeling
(taking out cells that hold a single digest) recovers the digests in which they differ.  If it gets stuck, both
sketches are made again with four times the cells.  A fingerprint is the sketch of the smallest size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import hash_pieces, mix, partitions, ship, text_of

#: Cells of one part in a fingerprint, parts, and how much larger the next try is.
CELLS, PARTS, GROWTH = 4, 3, 4
#: A paragraph is cut after a byte whose window hash ends in this many zero bits: every 64 bytes on average.
CUT_BITS = 6
#: Bytes of text handled at once.
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_CHECK = np.uint64(0x082EFA98EC4E6C89)


def digests_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, digest) of all pieces of all texts; equal pieces of one text differ by their occurrence number."""
    gap = 8  # zero bytes before each text: the window never sees another text
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + gap) - size
    data = np.frombuffer(b"".join(b"\0" * gap + t for t in texts), np.uint8)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    window = np.zeros(len(data), np.uint64)
    for k in range(gap):
        window[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    ends = (window * _ODD) >> np.uint64(64 - CUT_BITS) == 0
    ends |= data == 10
    ends[start[size > 0] + size[size > 0] - 1] = True
    # A piece begins at the start of a text or after the end of one, inside the same text.
    first = np.zeros(len(data) + 1, bool)
    first[1:] = ends
    first[start[size > 0]] = True
    owner_of = np.repeat(np.arange(len(texts)), size + gap)
    inside = np.arange(len(data)) >= np.repeat(start, size + gap)
    begin = np.flatnonzero(first[:-1] & inside)
    # What lies between a text and the next is hashed with the last piece: so the gaps are pieces of their own, dropped after.
    edges = np.sort(np.concatenate((begin, start[1:] - gap)))
    hashed = hash_pieces(data, edges)[np.searchsorted(edges, begin, side="right") - 1]
    owner = owner_of[begin]
    order = np.lexsort((hashed, owner))
    o, h = owner[order], hashed[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    place = np.arange(len(o))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return o, mix(h + nth.astype(np.uint64) * _ODD)


class Sketches:
    """One sketch per owner, as rows of cells: count, XOR of digests, XOR of checks."""

    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @staticmethod
    def of(owner: np.ndarray, digest: np.ndarray, n: int, cells: int) -> Sketches:
        width = PARTS * cells
        made = Sketches(np.zeros(n * width, np.int32), np.zeros(n * width, np.uint64), np.zeros(n * width, np.uint32))
        made._add(owner, digest, np.ones(len(owner), np.int32), cells)
        return made.shaped(n)

    def shaped(self, n: int) -> Sketches:
        return Sketches(*(a.reshape(n, -1) for a in (self.count, self.key, self.check)))

    def _add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray, cells: int) -> None:
        check = checks(digest)
        for part in range(PARTS):
            at = owner * (PARTS * cells) + places(digest, part, cells)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, mine: np.ndarray, other: Sketches, theirs: np.ndarray) -> Sketches:
        return Sketches(self.count[mine] - other.count[theirs], self.key[mine] ^ other.key[theirs], self.check[mine] ^ other.check[theirs])

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(solved, row, digest, sign): the digests left in each row; rows that are not solved are incomplete."""
        n, width = self.count.shape
        cells = width // PARTS
        flat = Sketches(self.count.ravel().copy(), self.key.ravel().copy(), self.check.ravel().copy())
        rows, found, signs = [], [], []
        # Every round takes out at least one digest of a row that can still be solved; a wrong one makes the row fail.
        for _ in range(width + 8):
            at = np.flatnonzero((np.abs(flat.count) == 1) & (flat.check == checks(flat.key)))
            at = at[at % width == places(flat.key[at], at % width // cells, cells)]
            if not len(at):
                break
            row, key, sign = at // width, flat.key[at], flat.count[at]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[new], key[new], sign[new]
            flat._add(row, key, -sign, cells)
            rows, found, signs = [*rows, row], [*found, key], [*signs, sign]
        left = flat.shaped(n)
        solved = ~(left.count.any(1) | left.key.any(1) | left.check.any(1))
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return solved, whole(rows, np.int64), whole(found, np.uint64), whole(signs, np.int32)

    def text(self, row: int) -> str:
        return base64.b64encode(self.count[row].astype("<i4").tobytes() + self.key[row].astype("<u8").tobytes() + self.check[row].astype("<u4").tobytes()).decode()


def checks(digest: np.ndarray) -> np.ndarray:
    return (mix(digest ^ _CHECK) >> np.uint64(32)).astype(np.uint32)


def places(digest: np.ndarray, part: int | np.ndarray, cells: int) -> np.ndarray:
    """The cell of a digest in a part."""
    salt = np.array(_SALTS, np.uint64)[part]
    return (mix(digest + salt) >> np.uint64(33)).astype(np.int64) % cells + np.asarray(part) * cells


class Digests:
    """Digests of many texts, from which sketches of any size are made for some of them."""

    def __init__(self, texts: list[bytes]):
        self.owner, self.digest = digests_of(texts)
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.bounds)

    def sketches(self, rows: np.ndarray, cells: int) -> Sketches:
        size = self.size[rows]
        total = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.bounds[rows] - total + size, size)
        return Sketches.of(np.repeat(np.arange(len(rows)), size), self.digest[at], len(rows), cells)


def reconcile(a: Digests, mine: np.ndarray, b: Digests, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(differing, cells, row, digest, sign) of text pairs: number of digests only one side has, cells needed, and those digests."""
    n = len(mine)
    differing, used = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, cells, rows, found, signs = np.arange(n), CELLS, [], [], []
    while len(left):
        # Sketches are made once per text, and for so many pairs at a time as keep them small.
        step = max(1, (1 << 18) // (PARTS * cells))
        stuck = []
        for k in range(0, len(left), step):
            part = left[k : k + step]
            one, at_one = np.unique(mine[part], return_inverse=True)
            two, at_two = np.unique(theirs[part], return_inverse=True)
            solved, row, digest, sign = a.sketches(one, cells).minus(at_one, b.sketches(two, cells), at_two).peel()
            good = solved[row]
            differing[part] = np.where(solved, np.bincount(row[good], minlength=len(part)), 0)
            used[part] = cells * PARTS
            rows, found, signs = [*rows, part[row[good]]], [*found, digest[good]], [*signs, sign[good]]
            stuck.append(part[~solved])
        left, cells = np.concatenate(stuck), cells * GROWTH
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return differing, used, whole(rows, np.int64), whole(found, np.uint64), whole(signs, np.int32)


def likeness(a: np.ndarray, b: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Shared digests among all; 1 for two empty texts."""
    shared = (a + b - differing) / 2
    return np.where(a + b == 0, 1.0, shared / np.maximum(a + b - shared, 1))


def _by_bytes(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``CHUNK`` bytes."""
    a = total = i = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= CHUNK:
            yield a, i
            a, total = i, 0
    if a < i:
        yield a, i


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, fingerprint), one row per document.

    Null and empty texts have no pieces and all the same fingerprint; equal texts have equal ones.  Rows that repeat a
    doc_id, or have none, give a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            for a, b in _by_bytes(map(len, texts)):
                made = Digests(texts[a:b])
                sketch = made.sketches(np.arange(b - a), CELLS)
                columns = [batch.column(0).slice(a, b - a), pa.array(made.size), pa.array([sketch.text(i) for i in range(b - a)])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "fingerprint"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, fingerprint string")


def differences(versions: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(doc_id, near, cells, removed, added) per pair of versions: piece digests that only the one or the other has.

    ``near`` is the share of pieces that both have, 0 to 1; ``cells`` is the size of sketch that could be peeled.
    Nulls read as empty; two empty texts are alike (1).  One row out per row in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[(t.as_py() or "").encode() for t in batch.column(c)] for c in (1, 2)]
            for a, b in _by_bytes(len(x) + len(y) for x, y in zip(*texts)):
                one, two, every = Digests(texts[0][a:b]), Digests(texts[1][a:b]), np.arange(b - a)
                differing, used, row, digest, sign = reconcile(one, every, two, every)
                lists = []
                for s in (1, -1):
                    at = np.flatnonzero(sign == s)
                    at = at[np.lexsort((digest[at], row[at]))]
                    bounds = np.searchsorted(row[at], np.arange(b - a + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(digest[at].view(np.int64))))
                columns = [batch.column(0).slice(a, b - a), pa.array(likeness(one.size, two.size, differing)), pa.array(used), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "near", "cells", "removed", "added"])

    rows = versions.select("doc_id", text_of(before).alias("before"), text_of(after).alias("after"))
    kind = versions.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, near double, cells long, removed array<long>, added array<long>")


def _in_order(docs: DataFrame) -> DataFrame:
    """(to, ghost, doc_id, text) in order within partitions: chunks of consecutive documents, each followed by the next one.

    Chunk borders are quantiles of the order (doc_id, hash of the text), so ids that repeat are split like others; rows
    without an id come first, dealt by hash.  The first document of a chunk is also sent, as its ghost, to the chunk
    before; that of the first chunk to the last.
    """
    n = 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("slot", F.pmod("h", F.lit(1 << 16)))
    value = F.col("doc_id").cast("double") + F.col("slot") / (1 << 16)
    steps = [k / n for k in range(1, n)]
    borders = rows.agg(F.percentile_approx(value, steps, max(10_000, 10 * n))).first()[0] or []  # n numbers at most
    borders = F.array(*[F.lit(b) for b in sorted(set(borders))]).cast("array<double>")
    # Binary search: how many borders are not above the value.
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, s: F.when(F.get(borders, at + s - 1) <= value, at + s).otherwise(at))
    chunk = F.when(F.col("doc_id").isNull(), F.floor(F.col("slot") * n / (1 << 16)).cast("int")).otherwise(F.lit(n) + below)
    rows = rows.withColumn("chunk", chunk)
    order = ["doc_id", "slot", "h"]
    firsts = sorted(rows.groupBy("chunk").agg(F.min(F.struct(*order)).alias("first")).collect(), key=lambda r: r.chunk)  # 2 n rows at most
    edges = [(r.chunk, r.first.doc_id, r.first.h, firsts[k - 1].chunk) for k, r in enumerate(firsts)]
    edges = docs.sparkSession.createDataFrame(edges, "chunk int, first_id long, first_h long, before int")
    met = rows.join(F.broadcast(edges), "chunk")
    opens = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("chunk").alias("to"), F.lit(0).alias("ghost"))
    sent = F.explode(F.when(opens, F.array(own, F.struct(F.col("before").alias("to"), F.lit(1).alias("ghost")))).otherwise(F.array(own)))
    placed = met.select(sent.alias("at"), *order, "text").select("at.to", "at.ghost", *order, "text")
    return placed.repartition(partitions(docs.sparkSession), "to").sortWithinPartitions("to", "ghost", *order).select("to", "ghost", "doc_id", "text")


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by as many of the other text's first, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after it by doc_id (rows of one id by their text's hash), the first one after the
    last; a lone document is its own.  Null and empty texts are alike and have the same fingerprint; an empty text has
    likeness 0 to one that is not.  Rows without an id come first and keep a null id; repeated rows give a row each,
    and follow one another.  Other columns are ignored, whatever their names.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (t.as_py() for t in batch.column(3)))

    def finished(ids: list, pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        # The next text of a row mostly is the row after it: each text is digested once.
        texts, at = [], []
        for text, after in pairs:
            if not texts or texts[-1] is not text:
                texts.append(text)
            at.append(len(texts) - 1)
            texts.append(after)
        at = np.array(at)
        changed = [edited(*p) for p in pairs]
        raw = [t.encode() for t in changed]
        own, new, every = Digests([t.encode() for t in texts]), Digests(raw), np.arange(len(pairs))
        mine, theirs = own.sketches(at, CELLS), new.sketches(every, CELLS)
        near_edited = likeness(own.size[at], new.size, reconcile(own, at, new, every)[0])
        near_next = likeness(own.size[at], own.size[at + 1], reconcile(own, at, own, at + 1)[0])
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
            pa.array([mine.text(i) for i in every]), pa.array([theirs.text(i) for i in every]), pa.array(near_edited), pa.array(near_next),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pairs, size, last = [], [], 0, None
        for to, ghost, doc_id, text in rows_of(batches):
            if last and last[0] == to:
                ids.append(last[1])
                pairs.append((last[2], text))
                size += len(last[2]) + len(text)
            last = None if ghost else (to, doc_id, text)
            if size >= CHUNK:
                yield finished(ids, pairs)
                ids, pairs, size = [], [], 0
        if ids:
            yield finished(ids, pairs)

    return _in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


ship(__name__)
