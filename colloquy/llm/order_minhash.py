"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment of the words.

Two documents are linked if the words that an alignment matches make up ``SIMILARITY`` of all: M / (a + b - M), a and b
being their numbers of words and M the length of the longest common subsequence.  A class is a connected component of
links.  Candidates share a sketch of labelled shingles: a shingle carries its occurrence number, so all of one
document differ.

* Texts with equal words collapse first; only distinct ones are compared.
* Order MinHash: each hash function picks the ``PICKED`` least labelled shingles and keeps them in text
  order; ``ROWS`` such sketches make a bucket key, and there are ``BANDS`` keys.  A pair that has 0.8 of its
  shingles in common misses all of them with a probability of about 3e-5.  A replaced word takes five shingles with it:
  pairs with 3 / 5 / 8 % of their words replaced here and there are missed by some 0.04 / 3 / 30 in a hundred.
* In a bucket nobody meets everybody: members meet the first one, then the one with most links; only members
  still outside the class of that hub then meet the members of other classes, in blocks.  So groups of copies cost a
  few comparisons each, and no link between classes is lost.
* The alignment looks only inside the band that the threshold leaves: words more than
  (a + b) (1 - t) / (1 + t) places apart cannot be matched by an alignment that is good enough.  A row of the band is
  one long integer, so a word costs a few operations on it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bit_filter, hash_runs, mix, passes, ship, stage, text_of

SHINGLE = 5
SIMILARITY = 0.8
PICKED, ROWS, BANDS = 2, 2, 20
CHUNK = 1 << 20
#: Words found this often or less are looked up place by place, more frequent ones keep a row of bits.
SELDOM = 64
QUERY_BLOCK, MEMBER_BLOCK = 256, 512


def normal_text(text: Column) -> Column:
    """Lower-case words of letters, marks and digits; a text without any stands for itself."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(words == "", F.concat(F.lit("\t"), text)).otherwise(words)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [a, b) of about CHUNK bytes: a, b, the bytes and where each text starts among them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of words of each text."""
    # A blank after each text keeps the last word of one apart from the first of the next.
    spread = np.full(len(data) + len(offsets) - 1, 32, np.uint8)
    size = np.diff(offsets)
    spread[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    words, at = hash_runs(spread, (spread != 32) & (spread != 9))
    return words, np.bincount(np.searchsorted(offsets[1:] + np.arange(len(size)), at), minlength=len(size))


def _sums(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests per text from its words and their order."""
    place = (np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    out = []
    for seed in (np.uint64(0x51ED270B), np.uint64(0x2545F491)):
        value = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place + seed)))))
        end = np.cumsum(n)
        out.append(mix(value[end] - value[end - n] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, n = _words(data, offsets)
    d1, d2 = _sums(words, n)
    return d1, d2, words, n


def labels(words: np.ndarray, n: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words with and without their occurrence number, text after text, and their number per text."""
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    start = np.repeat(np.cumsum(n) - n, count) + np.arange(len(owner)) - np.repeat(first, count)
    length = np.minimum(n, size)[owner]
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    shingle = np.zeros(len(owner), np.uint64)
    for k in range(size):
        shingle = np.where(k < length, mix(shingle * np.uint64(0x9E3779B97F4A7C15) + padded[start + k]), shingle)
    # Occurrence numbers: place in the run of equal shingles of the same text.
    own = shingle ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0)) if len(own) else np.zeros(0, np.int64)
    occurrence = np.empty(len(own), np.uint64)
    occurrence[order] = (np.arange(len(own)) - run).astype(np.uint64)
    return mix(shingle + occurrence * np.uint64(0xC2B2AE3D27D4EB4F)), shingle, count


def sketches(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bucket keys (texts x BANDS); texts without words have zero keys."""
    label, shingle, count = labels(words, n)
    first = np.cumsum(count) - count
    keys = np.zeros((len(n), BANDS), np.uint64)
    has = np.flatnonzero(count)
    if not len(has):
        return keys.view(np.int64)
    cut, far = first[has], np.uint64(0xFFFFFFFFFFFFFFFF)
    seeds = mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64)).reshape(BANDS, ROWS)
    for band in range(BANDS):
        for seed in seeds[band]:
            value = (label ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
            places = []
            for _ in range(PICKED):
                least = np.minimum.reduceat(value, cut)
                at = np.flatnonzero(value == np.repeat(least, count[has]))
                at = at[np.searchsorted(at, cut)]  # one place a text
                places.append(np.where(least == far, -1, at))
                value[at] = far
            for p in np.sort(np.stack(places, 1), axis=1).T:  # in text order
                keys[has, band] = mix(keys[has, band] * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(p < 0, np.uint64(1), shingle[p]))
        keys[has, band] = mix(keys[has, band] + np.uint64(band))
    return keys.view(np.int64)


def sketch_table(docs: DataFrame) -> DataFrame:
    """(node, doc_id, row_key, d1, d2, n, keys): node numbers the rows; d1, d2 stand for the n words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in _texts(batch.column(2)):
                d1, d2, words, n = digests(data, offsets)
                keys = sketches(words, n)
                size = np.arange(b - a + 1, dtype=np.int32) * BANDS
                columns = [
                    pa.array(node + np.arange(b - a)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(d1), pa.array(d2),
                    pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(size), pa.array(keys.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "row_key", "d1", "d2", "n", "keys"])
                node += b - a

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), normal_text(text_of()).alias("text"))
    return rows.mapInArrow(run, "node long, doc_id long, row_key long, d1 long, d2 long, n long, keys array<long>")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, d1, d2): the normal texts, found by their digests."""
    shared = bit_filter(wanted, "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch.column(0)):
                d1, d2, _, _ = digests(data, offsets)
                keep = np.flatnonzero(passes(shared.value, d1))
                keep = keep[np.unique(d1[keep], return_index=True)[1]]  # one copy is enough
                yield pa.RecordBatch.from_arrays([pa.array(d1[keep]), pa.array(d2[keep]), batch.column(0).take(pa.array(a + keep))], names=["d1", "d2", "text"])

    found = docs.select(normal_text(text_of()).alias("text")).mapInArrow(run, "d1 long, d2 long, text string")
    return wanted.join(found, ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("node", "text")


def words_of(text: str) -> list[str]:
    """The words of a normal text; a text without any is one word."""
    return [text] if text.startswith("\t") else text.split(" ")


def places_of(words: list[str]) -> dict[str, list[int]]:
    """Where each word stands."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    return places


def aligned(places: dict[str, list[int]], a: int, b: list[str], threshold: float) -> float:
    """Similarity of two documents if it reaches the threshold, else 0; places: of the ``a`` words of the first.

    Row j of the alignment is a run of bits for the places lo <= i < hi of the band; a bit is 0 where the longest
    common subsequence with the first j words grows by one.  Bits below the band do not change any more.
    """
    band = int((a + len(b)) * (1 - threshold) / (1 + threshold) + 1e-9)
    lo, hi = 0, min(a, band)
    row, m = (1 << hi) - 1, 0
    common: dict[str, tuple[int, int, int]] = {}  # of frequent words: bits, the place of the lowest, places taken up
    for j, w in enumerate(b):
        if j > band and lo < a:
            m += not row & 1
            row >>= 1
            lo += 1
        if hi < min(a, j + band + 1):
            row |= 1 << (hi - lo)
            hi += 1
        at = places.get(w)
        if at is None:
            continue
        if len(at) <= SELDOM:
            match = sum(1 << (i - lo) for i in at if lo <= i < hi)
        else:
            match, base, taken = common.get(w, (0, 0, 0))
            match >>= lo - base
            end = bisect_left(at, hi, taken)
            for i in at[bisect_left(at, lo, taken, end) : end]:
                match |= 1 << (i - lo)
            common[w] = match, lo, end
        if match:
            hit = row & match
            row = (row + hit | row & ~match) & ((1 << (hi - lo)) - 1)
    m += hi - lo - row.bit_count()
    similarity = m / (a + len(b) - m)
    return similarity if similarity >= threshold else 0.0


def linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, places = None, [], {}
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, first = a, words_of(x.as_py())
                    places = places_of(first)
                good.append(aligned(places, len(first), words_of(y.as_py()), threshold) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node that has an edge, with the least node of its component.

    Large-star and small-star steps in turn: the edges turn into stars around the least nodes.  Each step
    takes minima by partial aggregation, so a node with very many neighbours is no hot group.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        mark = now


def _stars(now: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the members of each bucket with its pivot, where size allows a link and the classes differ."""
    fits = (F.least("n", "pn") >= F.greatest("n", "pn") * threshold) & (F.col("label") != F.col("plabel"))
    return now.join(pivots, "key").filter(fits).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _hubs(now: DataFrame, links: DataFrame) -> DataFrame:
    """(key, pivot, pn, plabel) of the buckets that hold more than one class: the member with most links."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = now.join(degree, "node", "left").withColumn("order", -F.coalesce("degree", F.lit(0)))
    best = ranked.groupBy("key").agg(F.min(F.struct("order", "node", "n", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return best.filter("lo <> hi").select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.label").alias("plabel"))


def _rest(now: DataFrame, hubs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of the members outside the class of the hub with all members of the bucket, in blocks.

    A task gets at most about QUERY_BLOCK such members and MEMBER_BLOCK others of one bucket, so a text travels once
    per block, not once per pair.  A pair that shares several buckets is compared in the first only.
    """
    rows = now.join(hubs.select("key", F.col("plabel").alias("main")), "key").withColumn("outside", F.col("label") != F.col("main")).drop("main")
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("mbs"), F.ceil(F.count_if("outside") / QUERY_BLOCK).cast("int").alias("qbs"))
    rows = stage(rows.join(sizes, "key").withColumn("h", F.xxhash64("node")))
    block = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("key", block("mbs").alias("mb"), every("qbs").alias("qb"), "node", "n", "label", "outside", F.lit(False).alias("asks"))
    queries = rows.filter("outside").select("key", every("mbs").alias("mb"), block("qbs").alias("qb"), "node", "n", "label", "outside", F.lit(True).alias("asks"))
    full = members.union(queries).join(texts, "node")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        node, label_of, n = (group.column(c).to_numpy() for c in ("node", "label", "n"))
        outside = group.column("outside").to_numpy(zero_copy_only=False)
        keys = np.array(group.column("keys").to_pylist(), np.int64)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: tuple[list, list] = ([], [])
        if len(q) and len(m):
            text = group.column("text").combine_chunks()
            parts = [labels(*digests(data, offsets)[2:], 1) for _, _, data, offsets in _texts(text)]
            label, count = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts])
            end = np.cumsum(count)
            own = lambda r: label[end[r] - count[r] : end[r]]
            of_members = np.concatenate([own(r) for r in m])
            cut = np.cumsum(count[m]) - count[m]
            for i in q:
                # Two members outside meet once; a pair that shares several buckets meets in the first.
                fit = (label_of[m] != label_of[i]) & (~outside[m] | (node[i] < node[m])) & (keys[i][(keys[m] == keys[i]).argmax(axis=1)] == key[0].as_py())
                if not fit.any():
                    continue
                # Common words bound the alignment, whatever their order; equal hashes can only raise the bound.
                mine = np.sort(own(i))
                at = np.minimum(np.searchsorted(mine, of_members), len(mine) - 1)
                common = np.add.reduceat((mine[at] == of_members).astype(np.int64), cut)
                fit &= common * (1 + threshold) >= (n[m] + n[i]) * threshold - 1e-6
                if fit.any():
                    first = words_of(text[i].as_py())
                    places = places_of(first)
                    for j in m[fit]:
                        if aligned(places, len(first), words_of(text[j].as_py()), threshold):
                            out[0].append(min(node[i], node[j])), out[1].append(max(node[i], node[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return full.groupBy("key", "mb", "qb").applyInArrow(compare, "a long, b long")


def _similar_nodes(docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of the distinct texts that have a link; ``reps``: (node, d1, d2, n, keys)."""
    keys = reps.select("node", "n", "d1", "d2", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1").select("key")
    members = stage(keys.join(shared, "key", "left_semi"))
    wanted = members.select("node", "d1", "d2").distinct()
    texts = stage(_texts_of(docs, wanted).join(reps.select("node", "keys"), "node"))
    members = members.select("key", "node", "n")
    relabel = lambda labels: members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # The first of each bucket, then the hub, then what is left against all.
    now = members.withColumn("label", F.col("node"))
    first = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"))
    first = first.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.node").alias("plabel"))
    links = stage(linked(stage(_stars(now, first, threshold)), texts, threshold))
    now = stage(relabel(components(links)))
    links = stage(links.union(linked(stage(_stars(now, _hubs(now, links), threshold)), texts, threshold)))
    now = stage(relabel(components(links)))
    links = stage(links.union(_rest(now, _hubs(now, links), texts, threshold)))
    return components(links)


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, stays (one document a class).

    Null text is empty; texts without a word are alike only if equal, as are texts of fewer than five words, which are
    one shingle.  A null doc_id ranks before all others and is a class_id of null; repeated rows are members
    of one class, of which one row stays; other columns are ignored.
    """
    return _classes(docs, threshold).drop("row_key")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    null = F.lit(-(1 << 63))
    table = stage(sketch_table(docs)).withColumn("rank", F.coalesce("doc_id", null))
    first = F.min(F.struct("rank", "node", "row_key"))
    reps = stage(table.groupBy("d1", "d2").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
                 .select(F.col("first.node").alias("node"), "first", "copies", "d1", "d2", "n", "keys"))
    labels = _similar_nodes(docs, reps.filter("n > 0"), threshold)
    reps = reps.drop("keys", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = reps.groupBy("label").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    verdict = reps.select("d1", "d2", "label").join(of_class, "label").drop("label")
    return table.select("node", "doc_id", "row_key", "d1", "d2").join(verdict, ["d1", "d2"]).select(
        "doc_id", "row_key", F.nullif(F.col("least.rank"), null).alias("class_id"), "class_size", (F.col("node") == F.col("least.node")).alias("stays"),
    )


def keep_first(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that stay, one of each class, with all their columns.

    A row is known by its doc_id and a hash of its text.  Of repeated rows one stays; a null doc_id ranks first, so of a
    class with such rows one of them stays.
    """
    found = stage(_classes(docs, threshold))
    stays = found.filter("stays").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__stays"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__stays"))
    kept = docs.withColumn("__row_key", _row_key()).join(stays, same, "left_semi")
    if not found.groupBy("doc_id", "row_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__row_key"])  # equal rows
    return kept.drop("__row_key")


ship(__name__)
