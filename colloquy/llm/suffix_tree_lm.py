"""Language-model scores from a probabilistic suffix tree over bytes, beside a unigram base.

A text is its lower-cased words joined by blanks, in UTF-8, and an end symbol.  All (context, next
symbol) pairs with contexts of up to ``DEPTH`` symbols are counted over the whole training part.  A context
is a candidate if it makes up ``P_MIN`` of all positions, which bounds the tree whatever the input; it is
retained if its next-symbol distribution diverges from that of its longest retained suffix.  A retained state
mixes its counts with the distribution of that suffix (Witten-Bell), down to an add-half root.  Texts
are scored by the longest retained suffix of what stands before each symbol; the tree is laid out as an
automaton, so that many texts walk through it side by side.

Above the bytes stands a state whose symbols are whole words.  It knows every word of the training part, so it
grows with the corpus; its table is joined to the texts' words, and only a frequent head is broadcast.  A word has
WORD_WEIGHT of its share of all words, and what the tree gives its bytes for the rest, which is all an unknown one has:

    P(w) = (1 - WORD_WEIGHT) * tree(w) + WORD_WEIGHT * c(w) / N * (1 - stop before w) / stop after w

``stop`` is what the tree gives a blank or an end, so that the probabilities of all words and stops add up to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import held_out, lower_ascii, ship, stage, text_of

FOLDS = 10
DEPTH = 6
#: Least share of all positions: of a context, and of a context with its next symbol to be stored.
P_MIN = 1e-5
P_PAIR = P_MIN / 40
#: Least divergence from the suffix, in bits per symbol of the corpus.
DIVERGENCE = 1e-8
#: Words of at least this share of all tokens are looked up in a broadcast table of at most 1 / WORD_SHARE rows.
WORD_SHARE = 1e-6
BEGIN, END, BLANK = 0, 1, 32
END_TOKEN = 1
#: What the state of whole words weighs beside the tree.
WORD_WEIGHT = 0.5
CHUNK = 1 << 21
BLOCK = 256

_POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_HIGH = np.multiply.accumulate(np.full(4096, _POWERS[-1], np.uint64))


def normal_text(text: Column) -> Column:
    """Words joined by one blank each."""
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "))


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each as DEPTH begin symbols, its bytes and an end; and where the bytes start and end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.maximum(np.frombuffer(column.buffers()[2] or b"", np.uint8), 2)  # begin and end stand for themselves only
    size = np.diff(offsets)
    start = np.cumsum(size + DEPTH + 1) - size - 1
    out = np.zeros(len(data[offsets[0] : offsets[-1]]) + (DEPTH + 1) * len(size), np.uint8)
    for s, a, n in zip(start.tolist(), offsets.tolist(), size.tolist()):
        out[s : s + n] = data[a : a + n]
    out[start + size] = END
    return out, start, start + size


def inside(s: np.ndarray) -> np.ndarray:
    """Whether a symbol belongs to a word."""
    return (s != BEGIN) & (s != END) & (s != BLANK)


def chunks(s: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK symbols that cut no word."""
    a = DEPTH
    while a < len(s):
        b = min(len(s), a + CHUNK)
        while b < len(s) and inside(s[b - 1]):
            more = np.flatnonzero(~inside(s[b : b + CHUNK]))
            b = b + int(more[0]) + 1 if len(more) else min(len(s), b + CHUNK)
        yield a, b
        a = b


def grams(s: np.ndarray, a: int, b: int) -> np.ndarray:
    """For every symbol of [a, b): the DEPTH symbols before it and itself, as one number."""
    out = np.zeros(b - a, np.uint64)
    for j in range(DEPTH + 1):
        out |= s[a - DEPTH + j : b - DEPTH + j].astype(np.uint64) << np.uint64(8 * (DEPTH - j))
    return out[s[a:b] != BEGIN]


def word_hashes(s: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of [a, b), where they start, and where they end."""
    part = s[a:b]
    word = np.concatenate(([False], inside(part), [False]))
    first, last = np.flatnonzero(word[1:] & ~word[:-1])[: b - a], np.flatnonzero(word[:-1] & ~word[1:])
    if not len(first):
        return np.zeros(0, np.int64), first, last
    origin = np.zeros(len(part), np.int64)
    origin[first] = first
    offset = np.arange(len(part)) - np.maximum.accumulate(origin)
    value = (part.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 4095] * _HIGH[offset >> 12 & 4095]
    value[~word[1:-1]] = 0
    h = np.add.reduceat(value, first)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64), first + a, last + a


def counted(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over all ``text``: kind 0 words by hash, kind 1 grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, start, _ = symbols(batch.column(0))
            for a, b in chunks(s):
                yield rows(1, *np.unique(grams(s, a, b), return_counts=True))
                yield rows(0, *np.unique(word_hashes(s, a, b)[0], return_counts=True))
            yield rows(0, np.array([END_TOKEN]), np.array([len(start)]))

    return texts.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Tree:
    """The retained contexts as an automaton over symbol classes.

    ``step[node * classes + c]`` is the next node, ``row[node]`` the distribution used there, and
    ``log10p[row * classes + c]`` its entries.  Nodes are all candidate contexts: a candidate's prefixes and
    suffixes are candidates too, so the node after a symbol depends on the node before only.
    """

    def __init__(self, levels: list[tuple], total: int):
        """levels[d]: contexts of d symbols and their counts, the pairs (context * 256 + next) of these and theirs, all sorted."""
        seen = np.unique(np.concatenate([p & np.uint64(255) for _, _, p, _ in levels] + [np.array([BEGIN, END], np.uint64)])).astype(np.int64)
        self.class_of = np.zeros(256, np.uint8)
        self.class_of[seen] = np.arange(1, 1 + len(seen))  # class 0: bytes the training part lacks
        self.classes = classes = 1 + len(seen)
        base = np.cumsum([0] + [len(c) for c, *_ in levels])
        step = np.zeros((base[-1], classes), np.int32)
        self.row = np.zeros(base[-1], np.int32)
        _, _, pairs, n = levels[0]
        root = np.full(classes, 0.5 / (total + 128))
        root[self.class_of[(pairs & np.uint64(255)).astype(np.int64)]] += n / (total + 128)
        rows = [root[None, :]]
        made = 1
        for d, (contexts, count, pairs, n) in enumerate(levels):
            mine = base[d] + np.arange(len(contexts))
            if d:
                short = contexts & np.uint64((1 << 8 * (d - 1)) - 1)
                suffix = base[d - 1] + np.searchsorted(levels[d - 1][0], short)
                step[mine] = step[suffix]
                self.row[mine] = self.row[suffix]
                # Divergence of each context from what its suffix uses.
                at, symbol = np.searchsorted(contexts, pairs >> np.uint64(8)), self.class_of[(pairs & np.uint64(255)).astype(np.int64)]
                below = np.concatenate(rows)[self.row[mine][at], symbol] if len(at) else np.zeros(0)
                gain = np.bincount(at, n * np.log2(np.maximum(n / count[at], 1e-300) / below), len(contexts)) / total
                kept = np.flatnonzero(gain >= DIVERGENCE)
                stored, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                weight = (count - stored + kinds) / (count + kinds)
                fresh = np.concatenate(rows)[self.row[mine[kept]]] * weight[kept, None]
                place = np.full(len(contexts), -1)
                place[kept] = np.arange(len(kept))
                use = place[at] >= 0
                fresh[place[at[use]], symbol[use]] += (n / (count[at] + kinds[at]))[use]
                self.row[mine[kept]] = made + np.arange(len(kept))
                made += len(kept)
                rows = [np.concatenate([*rows, fresh])]
            if d < len(levels) - 1:
                longer = levels[d + 1][0]
                parent = base[d] + np.searchsorted(contexts, longer >> np.uint64(8))
                step[parent, self.class_of[(longer & np.uint64(255)).astype(np.int64)]] = base[d + 1] + np.arange(len(longer))
        self.step = step.ravel()
        p = np.concatenate(rows)
        self.log10p = np.log10(p).astype(np.float32).ravel()
        self.stop = np.clip(p[:, self.class_of[BLANK]] + p[:, self.class_of[END]], 1e-12, 1 - 1e-12)
        self.states = made

    def walk(self, s: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The state used for each symbol of [a, b) and the symbol's log10 probability (0 for a begin).

        Blocks walk side by side from DEPTH symbols early, which settles the node, also past the end of a text.
        """
        k, lanes = self.classes, -(-(b - a) // BLOCK)
        c = np.zeros(DEPTH + lanes * BLOCK, np.uint8)
        c[: DEPTH + b - a] = self.class_of[s[a - DEPTH : b]]
        early = BLOCK * np.arange(lanes)
        column = np.ascontiguousarray(c[DEPTH:].reshape(lanes, BLOCK).T)
        used, node = np.empty((BLOCK, lanes), np.int32), np.zeros(lanes, np.int32)
        for t in range(-DEPTH, BLOCK):
            if t >= 0:
                used[t] = self.row[node]
            node = self.step[node * k + (c[early + DEPTH + t] if t < 0 else column[t])]
        used = np.ascontiguousarray(used.T).ravel()[: b - a]
        log10p = self.log10p[used * k + c[DEPTH : DEPTH + b - a]].astype(np.float64)
        log10p[s[a:b] == BEGIN] = 0
        return used, log10p

    def gains(self, used: np.ndarray, log10p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each word [first, last): log10 of what its share of all words is to be multiplied by, over the tree's own."""
        bounds = np.stack([first, last], 1).ravel()
        of_tree = np.add.reduceat(log10p, bounds)[::2] if len(first) else np.zeros(0)
        return np.log10((1 - self.stop[used[first]]) / self.stop[used[last]]) - of_tree


def grow(counts: DataFrame) -> Tree:
    """The tree from gram counts; each level sums the one below, and only its frequent part goes to the driver.

    At most (DEPTH + 1) * (1 / P_MIN + 1 / P_PAIR) rows are collected, whatever the input.
    """
    level = counts.filter(F.col("kind") == 1).select("key", "n")
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = []
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            level = stage(level.groupBy(F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")))
        contexts = level.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"))
        often = contexts.filter(F.col("n") >= F.lit(P_MIN * total)).toArrow()
        # All symbols are kept at the root.
        pairs = level.filter(F.col("n") >= F.lit(P_PAIR * total if d else 0)).withColumn("context", F.shiftright("key", 8))
        known = F.broadcast(level.sparkSession.createDataFrame(often.select(["key"])).withColumnRenamed("key", "context"))
        parts = []
        for t in (often, pairs.join(known, "context", "left_semi").select("key", "n").toArrow()):
            key, n = t.column("key").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(np.float64)
            order = np.argsort(key)
            parts += [key[order], n[order]]
        levels.append(tuple(parts))
    levels.reverse()
    if not total:
        levels[0] = (np.zeros(1, np.uint64), np.zeros(1), *levels[0][2:])
    return Tree(levels, total)


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs``: (doc_id, text, ...).  Documents of the held-out fold teach nothing.  Null text is empty, whose only token
    is the end; a null doc_id reads as empty text for the fold and stays null; repeated rows have one result each
    (and count as often as they stand there); other columns are ignored.  With nothing to learn from, the tree is
    an even distribution over symbols, and every word is an unknown one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), normal_text(text_of()).alias("text"))
    counts = stage(counted(rows.filter(~F.col("held_out"))))
    words = counts.filter(F.col("kind") == 0)
    spoken = F.sum(F.when(F.col("key") != END_TOKEN, F.col("n")))
    n, v, spoken = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(spoken, F.lit(1))).first()
    often = words.filter(F.col("n") >= F.lit(WORD_SHARE * n)).select("key", "n").toArrow()  # at most 1 / WORD_SHARE rows
    key = often.column("key").to_numpy()
    order = np.argsort(key)
    model = spark.sparkContext.broadcast((grow(counts), key[order], often.column("n").to_numpy()[order]))
    norm = float(np.log10(n + 0.1 * (v + 1)))
    rest, weight = float(np.log10(1 - WORD_WEIGHT)), float(np.log10(WORD_WEIGHT / spoken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, count = model.value
        log = np.log10(count + 0.1) - norm
        row, part = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            s, start, end = symbols(batch.column(2))
            docs_n = len(start)
            tokens, known, base, score = np.ones(docs_n, np.int64), np.zeros(docs_n, np.int64), np.zeros(docs_n), np.zeros(docs_n)
            of_doc, hashes, left = [np.arange(docs_n)], [np.full(docs_n, END_TOKEN)], [np.full(docs_n, np.nan)]  # one end per text
            place = np.searchsorted(key, END_TOKEN)
            if place < len(key) and key[place] == END_TOKEN:
                known, base = known + 1, base + log[place]
                of_doc, hashes, left = [], [], []
            for a, b in chunks(s):
                used, log10p = tree.walk(s, a, b)
                some = np.arange(np.searchsorted(end, a), np.searchsorted(start, b))
                score[some] += np.add.reduceat(log10p, np.maximum(start[some], a) - a)
                h, first, last = word_hashes(s, a, b)
                gain = tree.gains(used, log10p, first - a, last - a)
                doc = np.searchsorted(start, first, side="right") - 1
                place = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
                hit = key[place] == h if len(key) else np.zeros(len(h), bool)
                tokens += np.bincount(doc, minlength=docs_n)
                known += np.bincount(doc[hit], minlength=docs_n)
                base += np.bincount(doc[hit], log[place[hit]], docs_n)
                mixed = weight + np.log10(count[place[hit]]) + gain[hit]
                mixed = np.maximum(mixed, rest) + np.log10(1 + 10 ** -np.abs(mixed - rest))
                score += np.bincount(doc[hit], mixed, docs_n)
                of_doc.append(doc[~hit]), hashes.append(h[~hit]), left.append(gain[~hit])
            owner, h, gain = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((of_doc, np.int64), (hashes, np.int64), (left, np.float64)))
            order = np.argsort(owner, kind="stable")
            lists = np.searchsorted(owner[order], np.arange(docs_n + 1)).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x[order])) for x in (h, gain.astype(np.float32))]
            columns = [pa.array(part + row + np.arange(docs_n)), batch.column(0), batch.column(1), *map(pa.array, (tokens, known, base, score)), *rare]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "gain"])
            row += docs_n

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, gain array<float>"
    found = stage(rows.mapInArrow(run, schema))
    # Rarer words meet their counts by a shuffle; none has more than WORD_SHARE of all rows in training.
    rare = found.select("row", F.explode(F.arrays_zip("rare", "gain")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.gain").cast("double").alias("gain"))
    looked_up = rare.join(words.select("key", F.col("n").alias("c")), "key", "left")
    log10p = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1) - F.lit(norm)
    mixed = F.lit(weight) + F.log10("c") + F.col("gain")
    mixed = F.greatest(mixed, F.lit(rest)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(mixed - F.lit(rest))))
    # An end has no gain.
    mixed = F.when(F.isnan("gain"), 0.0).when(F.col("c").isNull(), rest).otherwise(mixed)
    more = looked_up.groupBy("row").agg(F.count("c").alias("k"), F.sum(log10p).alias("b"), F.sum(mixed).alias("m"))
    return found.drop("rare", "gain").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("m", F.lit(0.0))).alias("score"),
    )


ship(__name__)
