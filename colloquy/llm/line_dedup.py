"""Line deduplication by a deletion-neighbourhood join.

Two lines are the same if their lower-cased words are equal, or differ by one word inserted, dropped or replaced
(lines of at least ``NEAR_WORDS`` words).  The earliest line, by doc_id and line number, stays; a later one goes
if any earlier line is the same.

* Equal lines collapse first, by a 128-bit digest; only distinct lines are compared.
* A line within one edit of another shares its first or its last half with it.  Lines whose halves (under
  either length the partner may have) no different line has are out, without loss, before their words are read.
* The others, numbered by doc_id and line number, emit every variant with one word deleted, and themselves, as
  hashed keys; keys of a single line are out again.  Equal variants deleted at the same place differ by a
  replaced word; a variant equal to a whole line, by an inserted one.  So per key the earliest holder is all a
  line has to meet: the join is linear in the variants, however many lines share a key, and minima are taken
  before the shuffle.
* The edit distance of every pair found is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bit_filter, discard, hash_runs, mix, only, passes, ship, stage, text_of

#: Shorter lines are left alone.
MIN_WORDS = 3
#: Shorter lines are compared for equality only.
NEAR_WORDS = 8
CHUNK = 1 << 20
#: Bits of the filters over halves and variants that more than one line has (8 MB): more of them let more lines pass, and cost time only.
HALF_BITS = 1 << 26
#: Ranks before all ids.
NO_ID = -(1 << 63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Lines:
    """The lines of a chunk of texts, as arrays with one entry per line; ``words`` holds their word hashes in a row."""

    def __init__(self, doc, number, start, end, first, n, words):
        self.doc, self.number, self.start, self.end, self.first, self.n, self.words = doc, number, start, end, first, n, words
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(n.max(initial=0)), _R))))
        offset = np.arange(len(words)) - np.repeat(first, n)
        zero = np.zeros(1, np.uint64)
        self.forward = np.concatenate((zero, np.cumsum(words * powers[offset])))
        self.backward = np.concatenate((zero, np.cumsum(words * powers[np.repeat(n, n) - 1 - offset])))

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return self.forward[self.first + size] - self.forward[self.first]

    def suffix(self, size: np.ndarray) -> np.ndarray:
        return self.backward[self.first + self.n] - self.backward[self.first + self.n - size]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n.astype(np.uint64)
        return mix(self.prefix(self.n) + n).view(np.int64), mix(self.suffix(self.n) ^ mix(n)).view(np.int64)

    def half_keys(self) -> np.ndarray:
        """Four keys a line: first and last half for a partner set of this length or one word shorter."""
        out = []
        for shorter in (self.n, self.n - 1):
            half, tag = shorter // 2, 2 * shorter.astype(np.uint64)
            out += [mix(self.prefix(half) + mix(tag)), mix(self.suffix(shorter - half) + mix(tag + np.uint64(1)))]
        return np.stack(out, 1).view(np.int64)

    def take(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the word lists of the lines kept."""
        n = self.n[keep]
        offsets = np.concatenate(([0], np.cumsum(n)))
        return offsets.astype(np.int32), self.words[np.repeat(self.first[keep] - offsets[:-1], n) + np.arange(offsets[-1])]


def lines_of(column: pa.Array, sentences: bool = False, word: np.ndarray = ~_SPACE) -> Iterator[Lines]:
    """All lines of an Arrow column of texts, in chunks cut between lines; doc counts the rows of the column.

    With ``sentences``, white space after . ! or ? ends a line too.  ``word`` tells the bytes of words.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    start = np.cumsum(size + 1) - size - 1
    data = np.full(int((size + 1).sum()), 10, np.uint8)
    for s, a, n in zip(start.tolist(), offsets.tolist(), size.tolist()):
        data[s : s + n] = raw[a : a + n]
    a = lines = points = 0
    first_line = first_point = 0
    while a < len(data):
        b = min(len(data), a + CHUNK)
        while data[b - 1] != 10:
            more = np.flatnonzero(data[b : b + CHUNK] == 10)
            b = b + int(more[0]) + 1 if len(more) else min(len(data), b + CHUNK)
        part = _LOWER[data[a:b]]
        ends = part == 10
        if sentences:
            ends[1:] |= _SPACE[part[1:]] & _STOP[part[:-1]]
        end = np.flatnonzero(ends)
        begin = np.concatenate(([0], end[:-1] + 1))
        doc = np.searchsorted(start, a + begin, side="right") - 1
        opens = a + begin == start[doc]
        index = lines + np.arange(len(end))
        point = points + np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        of_line = np.maximum.accumulate(np.where(opens, index, first_line))
        of_point = np.maximum.accumulate(np.where(opens, point[begin], first_point))
        words, at = hash_runs(part, word[part])
        first = np.searchsorted(at, begin)
        n = np.searchsorted(at, end) - first
        yield Lines(doc, index - of_line, point[begin] - of_point, point[end] - of_point, first, n, words)
        lines, points, first_line, first_point = lines + len(end), int(point[-1]), int(of_line[-1]), int(of_point[-1])
        a = b


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, row_key, line_no, start, end, n, d1, d2, keys): the lines of at least ``min_words`` words; keys only of near_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_keys = batch.column(0), batch.column(1)
            for x in lines_of(batch.column(2)):
                keep = np.flatnonzero(x.n >= min_words)
                d1, d2 = x.digests()
                near = x.n[keep] >= near_words
                bounds = np.concatenate(([0], np.cumsum(4 * near))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.half_keys()[keep][near].ravel()))
                owner = pa.array(x.doc[keep])
                columns = [ids.take(owner), row_keys.take(owner), *(pa.array(v[keep].astype(np.int64)) for v in (x.number, x.start, x.end, x.n)), pa.array(d1[keep]), pa.array(d2[keep]), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "line_no", "start", "end", "n", "d1", "d2", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, line_no long, start long, end long, n long, d1 long, d2 long, keys array<long>")


def _row_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def _candidates(docs: DataFrame, shared: Broadcast, near_words: int) -> DataFrame:
    """(d1, d2, doc, no, words) of the lines that share a half with another line, each distinct line once, at its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for x in lines_of(batch.column(1)):
                d1, d2 = x.digests()
                keep = np.flatnonzero(x.n >= near_words)
                keep = keep[passes(shared.value, x.half_keys()[keep]).any(1)]
                doc = ids[x.doc]
                # The first of equal lines of a chunk is enough.
                order = keep[np.lexsort((x.number[keep], doc[keep], d2[keep], d1[keep]))]
                new = np.ones(len(order), bool)
                new[1:] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])
                keep = order[new]
                offsets, words = x.take(keep)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64)))
                columns = [pa.array(v[keep].astype(np.int64)) for v in (d1, d2, doc, x.number)]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["d1", "d2", "doc", "no", "words"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"))
    found = rows.mapInArrow(run, "d1 long, d2 long, doc long, no long, words array<long>")
    return found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "no")).alias("at"), F.any_value("words").alias("words")).select("d1", "d2", "at.doc", "at.no", "words")


def variants(lines: DataFrame, shared: Broadcast | None = None) -> DataFrame:
    """(h, i, id): every line whole (i = -1) and with word i deleted, h the hash of the words left; only those in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            words = lists.flatten().to_numpy().view(np.uint64)
            first = np.cumsum(n) - n
            x = Lines(None, None, None, None, first, n, words)
            owner, at = np.repeat(np.arange(len(n)), n), np.arange(len(words))
            whole = x.prefix(n)
            without = x.forward[at] - x.forward[first[owner]] + (x.forward[first[owner] + n[owner]] - x.forward[at + 1]) * _R_INVERSE
            left = np.concatenate((n, n[owner] - 1)).astype(np.uint64)
            h = mix(mix(np.concatenate((whole, without))) + left).view(np.int64)
            i = np.concatenate((np.full(len(n), -1), at - first[owner])).astype(np.int32)
            ids = batch.column(0).to_numpy()[np.concatenate((np.arange(len(n)), owner))]
            keep = slice(None) if shared is None else passes(shared.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(i[keep]), pa.array(ids[keep])], names=["h", "i", "id"])

    return lines.select("id", "words").mapInArrow(run, "h long, i int, id long")


def within_one(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement, or none, makes the lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def near_lines(docs: DataFrame, table: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(d1, d2, near): for the distinct lines of ``line_table`` the earliest line within one edit that comes before, staged."""
    halves = table.select("d1", F.explode("keys").alias("key")).groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("b"))
    shared = bit_filter(halves.filter("a < b"), "key", HALF_BITS)
    # Numbered in their order, so that a line's number is its rank and variants carry nothing else.
    lines = stage(_candidates(docs, shared, near_words).sort("doc", "no", "d1", "d2").withColumn("id", F.monotonically_increasing_id()))
    twice = variants(lines).groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    rows = variants(lines, bit_filter(twice, "h", HALF_BITS))
    per_place = rows.groupBy("h", "i").agg(F.min("id").alias("best"), F.count(F.lit(1)).alias("c"))
    per_key = per_place.groupBy("h").agg(
        F.min(F.when(F.col("i") < 0, F.col("best"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("best"))).alias("cut"), F.sum("c").alias("c"),
    ).filter("c > 1").drop("c")
    partner = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("best", "whole"))
    offers = per_place.drop("c").join(per_key, "h").select("h", "i", partner.alias("near")).filter(F.col("near").isNotNull())
    pairs = stage(rows.join(offers, ["h", "i"]).filter("near < id").groupBy("id").agg(F.min("near").alias("near")))
    # Verified on the words: hashes only propose.  Lines at one place of rows with one id rank alike.
    met = only(lines, ["id"], bit_filter(pairs.select(F.explode(F.array("id", "near")).alias("id")), "id"))
    other = met.select(F.col("id").alias("near"), F.col("doc").alias("odoc"), F.col("no").alias("ono"), F.col("words").alias("owords"))
    both = pairs.join(met, "id").join(other, "near").filter(F.struct("odoc", "ono") < F.struct("doc", "no"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(4))]
            yield batch.select(["d1", "d2", "near"]).filter(pa.array(good, pa.bool_()))

    checked = both.select("d1", "d2", F.struct(F.col("odoc").alias("doc"), F.col("ono").alias("no")).alias("near"), "words", "owords")
    near = stage(checked.mapInArrow(verify, "d1 long, d2 long, near struct<doc: long, no: long>"))
    discard(lines, pairs)
    return near


def _marked(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    table = stage(line_table(docs, min_words, near_words))
    near = near_lines(docs, table, near_words)
    at = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("line_no").alias("no"))
    copied = table.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last")
    # Written, so that the join to all lines has two plain inputs: then Spark splits the partition of a very common line.
    verdict = stage(
        copied.join(near, ["d1", "d2"], "full")
        .select("d1", "d2", F.coalesce("near", "first").alias("keeper"), F.when(F.col("near").isNull(), 0).otherwise(1).alias("edits"))
    )
    discard(near)
    gone = only(table.drop("keys"), ["d1"], bit_filter(verdict, "d1")).join(verdict, ["d1", "d2"]).filter(at > F.col("keeper"))
    return gone.select(
        "doc_id", "row_key", "line_no", "start", "end", F.col("n").alias("n_words"),
        F.nullif(F.col("keeper.doc"), F.lit(NO_ID)).alias("first_doc_id"), F.col("keeper.no").alias("first_line_no"), "edits",
    )


def duplicates(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row per line to remove: doc_id, line_no, start, end, n_words, first_doc_id, first_line_no, edits.

    first_* is the earliest line that is the same; start and end count code points, end exclusive.  Lines are split
    at \\n and numbered from 0.  Null and empty texts have no lines that count; a null doc_id ranks before all
    others; rows that repeat a doc_id rank alike, so equal lines at equal places of them all stay; other columns
    are ignored.
    """
    return _marked(docs, min_words, near_words).drop("row_key")


def remove_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents without the lines of ``duplicates``, other columns as they are.

    A document of which no word is left although it had some goes; all others stay.
    """
    gone = _marked(docs, min_words, near_words).groupBy(F.col("row_key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, _row_key() == F.col("__key"), "left")
    lines = F.split(F.col("text"), "\n", -1)
    # Sorted set against the line numbers, both within one document.
    numbers = F.array_except(F.transform(lines, lambda _, i: i.cast("long")), F.col("__gone"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i.cast("int"))), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    cut = joined.withColumn("text", text)
    return cut.filter(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


ship(__name__)
