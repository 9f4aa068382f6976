"""Hard negatives by coordinate pruning over length buckets.

Rows are integer vectors with a label.  An anchor's positives are the nearest rows of its label by inner product;
its hard negatives the nearest rows of other labels whose score lies in a band below the positive's.

* Rows are dealt by (label, length) and cut into buckets of one label and similar lengths, so a label or a vector
  that fills a third of the table is spread over many buckets.  A bucket is one row: its vectors and, per
  coordinate, the order of its normalised values.
* A bucket is skipped for an anchor if even its longest vector cannot reach the score wanted.  Otherwise the angle
  that the score allows gives a feasible range of values on each focus coordinate (the anchor's largest); the ranges
  are looked up in the sorted lists, intersected, and what is left is scored exactly.
* The score wanted comes from what is known already: for positives from one bucket searched before the others, for
  negatives from the lower end of the band.
* Anchors meet buckets in slices: each (bucket, slice) is one group of bounded size, and only its best few rows per
  anchor leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import partitions, ship, stage

#: Rows and bytes of a bucket, and how far its lengths may differ.
ROWS, BYTES, RATIO = 2048, 4 << 20, 1.1
#: Anchors of a slice, and those scored by one product.
SLICE, TOGETHER = 8192, 256
#: Focus coordinates of an anchor, and the share of a bucket above which candidates are scored with the whole bucket.
FOCUS, SHARE = 3, 0.25

BUCKET = "label string, bucket long, longest double, size int, dims int, ids binary, rows binary, vectors binary, orders binary"


def usable(rows: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """(id, label, v, length, row): vectors as integers floor(scale * x); rows with anything missing or not finite are out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    kept = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & finite)
    out = kept.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    # Written right away, so the number of a row stays the same in every later read.
    return stage(out.withColumns({"length": length, "row": F.monotonically_increasing_id()}))


def buckets(rows: DataFrame) -> DataFrame:
    """One row per bucket, see ``BUCKET``; a bucket has one label, at most ``ROWS`` rows and lengths within ``RATIO``."""

    def bucket(number: int, label: str, piece: list[tuple]) -> tuple:
        ids, row, length, vectors = (np.concatenate([p[k] for p in piece]) if k < 3 else [v for p in piece for v in p[3]] for k in range(4))
        dims = max(map(len, vectors), default=0)
        table = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(vectors):
            table[i, : len(v)] = v
        order = np.argsort(_unit(table), axis=0, kind="stable").T.astype(np.int32)
        return label, number, float(length.max()), len(ids), dims, ids.tobytes(), row.tobytes(), table.tobytes(), order.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, now, least, size, width = TaskContext.get().partitionId() << 32, [], None, 0.0, 0, 1
        send = lambda: pa.RecordBatch.from_pylist([dict(zip(names, bucket(number, now, piece)))], schema=schema)
        for batch in batches:
            labels, lengths = batch.column(1).to_pylist(), batch.column(3).to_numpy()
            ids, row, lists = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            a = 0
            for i in range(len(labels)):
                n = int(offsets[i + 1] - offsets[i])
                new = labels[i] != now or size >= ROWS or lengths[i] > least * RATIO or size * max(width, n) * 8 >= BYTES
                if new:
                    if i > a:
                        piece.append((ids[a:i], row[a:i], lengths[a:i], [flat[offsets[k] : offsets[k + 1]] for k in range(a, i)]))
                    if piece:
                        yield send()
                    number, piece, now, least, size, width, a = number + 1, [], labels[i], lengths[i], 0, 1, i
                size, width = size + 1, max(width, n)
            if len(labels) > a:
                piece.append((ids[a:].copy(), row[a:].copy(), lengths[a:].copy(), [flat[offsets[k] : offsets[k + 1]].copy() for k in range(a, len(labels))]))
        if piece:
            yield send()

    names = [c.split(" ")[0] for c in BUCKET.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in BUCKET.split(", ")])
    dealt = rows.select("id", "label", "v", "length", "row").repartitionByRange(partitions(rows.sparkSession), "label", "length", "row")
    return dealt.sortWithinPartitions("label", "length", "row").mapInArrow(run, BUCKET)


def _unit(table: np.ndarray) -> np.ndarray:
    real = table.astype(np.float64)
    return real / np.maximum(np.sqrt((real * real).sum(1, keepdims=True)), 1e-300)


def feasible(anchor: np.ndarray, cosine: float, unit: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """Rows of a bucket that may have this cosine to the unit anchor; None if too many to be told apart by the ranges."""
    if cosine <= 0 or not len(anchor):
        return None
    focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
    angle = np.arccos(min(1.0, cosine))
    ranges = []
    for f in focus:
        own = np.arccos(np.clip(anchor[f], -1.0, 1.0))
        low = np.cos(min(np.pi, own + angle)) - 1e-9
        high = np.cos(max(0.0, own - angle)) + 1e-9
        values = unit[order[f], f]
        a, b = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
        ranges.append((b - a, f, a, b, low, high))
    n, f, a, b, _, _ = min(ranges)
    if n > SHARE * len(unit):
        return None
    found = order[f, a:b]
    for _, g, _, _, low, high in ranges:
        if g != f:
            x = unit[found, g]
            found = found[(x >= low) & (x <= high)]
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where every sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    place = np.arange(len(score))
    if len(score) > k:
        place = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return place[np.lexsort((ids[place], -score[place]))][:k]


def _meet(anchors: DataFrame, met: DataFrame, by: list[str], k: int, bands: bool) -> DataFrame:
    """The best k rows per anchor and bucket: with ``bands`` in each band of scores among other labels, else of the same label."""
    out = "anchor long, band int, score long, id long, row long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c: [] for c in ("anchor", "band", "score", "id", "row")}

        def keep(i: int, score: np.ndarray, ids: np.ndarray, number: np.ndarray) -> None:
            wanted = zip(lows[i], highs[i]) if bands else [(wants[i], None)]
            for band, (low, high) in enumerate(wanted):
                at = score >= low if high is None else (score >= low) & (score <= high)
                if not bands:
                    at &= number != own[i]
                if not at.any():
                    continue
                at = np.flatnonzero(at)
                at = at[best(score[at], ids[at], k)]
                for c, v in zip(rows, (np.full(len(at), own[i]), np.full(len(at), band), score[at], ids[at], number[at])):
                    rows[c].append(v)

        if left.num_rows and right.num_rows:
            own, wants = left["row"].to_pylist(), left["want"].to_pylist()
            labels = left["label"].to_pylist()
            if bands:
                lows, highs = left["low"].to_pylist(), left["high"].to_pylist()
            vectors = [np.asarray(v, np.int64) for v in left["v"].to_pylist()]
            for b in right.to_pylist():
                ids, number = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["rows"], np.int64)
                table = np.frombuffer(b["vectors"], np.int64).reshape(b["size"], b["dims"])
                order = np.frombuffer(b["orders"], np.int32).reshape(b["dims"], b["size"])
                unit = _unit(table)
                mine = np.zeros((len(vectors), b["dims"]), np.int64)
                for i, v in enumerate(vectors):
                    n = min(len(v), b["dims"])
                    mine[i, :n] = v[:n]
                norms = np.sqrt((mine.astype(np.float64) ** 2).sum(1))
                dense = []
                for i in range(len(own)):
                    if (labels[i] == b["label"]) == bands:
                        continue
                    reach = norms[i] * b["longest"]
                    if wants[i] > reach * (1 + 1e-9):
                        continue
                    some = feasible(mine[i] / max(norms[i], 1e-300), wants[i] / reach if reach else 0.0, unit, order)
                    if some is None:
                        dense.append(i)
                    elif len(some):
                        keep(i, products(mine[i : i + 1], table[some])[0], ids[some], number[some])
                for a in range(0, len(dense), TOGETHER):
                    part = dense[a : a + TOGETHER]
                    score = products(mine[part], table)
                    for s, i in zip(score, part):
                        if s.max() >= wants[i]:
                            keep(i, s, ids, number)
        whole = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in rows.items()}
        return pa.table({c: pa.array(v, pa.int32() if c == "band" else pa.int64()) for c, v in whole.items()})

    return anchors.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(run, out)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k per anchor and band, numbered; each partition cuts its own before the shuffle."""
    w = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dealt_out(n: int, name: str) -> F.Column:
    """A copy for each of n groups."""
    return F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))).alias(name)


def mine(
    rows: DataFrame, anchors: str = "id % 100 = 0", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 1.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``id``.  Positives are the first ``n_positives`` other rows of the anchor's label by
    higher inner product, then smaller id; negatives the first ``n_negatives`` rows of other labels with
    low * positive <= 100 * negative <= high * positive.  Fewer if there are fewer; positives without a negative give
    no row, nor do those with a negative score (their band is empty).  Rows without id or label, without a vector or
    with a null or not finite component take no part; of vectors of unequal size the shorter one is filled with zeros;
    rows that repeat an id are rows of their own, also as anchors.  Scores must fit a long.  Other columns are ignored.
    """
    spark = rows.sparkSession
    table = usable(rows, key, label, vector, scale)
    met = stage(buckets(table))
    n_met = met.count()
    chosen = table.filter(F.expr(anchors))
    slices = max(1, -(-chosen.count() // SLICE))
    spread = lambda n: F.pmod(F.xxhash64("row"), n)
    met = met.withColumn("slice", _dealt_out(slices, "slice"))
    chosen = chosen.withColumn("slice", spread(F.lit(slices)).cast("int"))

    # Positives: buckets of the anchor's label, numbered by hash into as many groups.
    per_label = met.filter("slice = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    of_label = met.join(per_label, "label").withColumn("group", F.pmod(F.xxhash64("bucket"), F.col("n")).cast("int")).drop("n")
    counted = chosen.join(per_label, "label")
    by = ["label_key", "group", "slice"]
    of_label = of_label.withColumn("label_key", F.col("label"))
    nothing = F.lit(-(1 << 63)).cast("long")
    seeds = counted.withColumns({"group": spread(F.col("n")).cast("int"), "label_key": F.col("label"), "want": nothing}).drop("n")
    seen = _first(_meet(seeds, of_label, by, n_positives, False), n_positives)
    seen = seen.groupBy("anchor").agg(F.when(F.count(F.lit(1)) == n_positives, F.min("score")).alias("found"))
    every = (
        counted.join(seen, F.col("row") == F.col("anchor"), "left").withColumn("want", F.coalesce("found", nothing))
        .withColumns({"group": F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))), "label_key": F.col("label")})
        .drop("n", "found", "anchor")
    )
    positives = _first(_meet(every, of_label, by, n_positives, False), n_positives)
    # At most n_positives entries an anchor; a score below zero has an empty band.
    bands = positives.filter("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    bands = stage(
        bands.join(chosen, F.col("anchor") == F.col("row")).withColumns({
            "low": F.transform("p", lambda p: F.ceil(p["score"].cast("decimal(38,0)") * low / 100).cast("long")),
            "high": F.transform("p", lambda p: F.floor(p["score"].cast("decimal(38,0)") * high / 100).cast("long")),
        }).withColumn("want", F.array_min("low")).withColumn("anchor_id", F.col("id"))
    )

    # Negatives: all buckets; those of the anchor's own label are passed over.
    others = met.withColumn("group", F.pmod(F.xxhash64("bucket"), F.lit(max(1, n_met))).cast("int"))
    asked = bands.select("row", "label", "v", "low", "high", "want", "slice", _dealt_out(n_met, "group"))
    found = _first(_meet(asked, others, ["group", "slice"], n_negatives, True), n_negatives)
    pairs = found.select("anchor", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    p = F.element_at("p", F.col("band") + 1)
    return bands.select("anchor", "anchor_id", "p").join(pairs, "anchor").select(
        "anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        p["score"].alias("positive_score"), "negative_score",
    )


ship(__name__)
