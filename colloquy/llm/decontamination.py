"""Benchmark decontamination: a broadcast set of benchmark n-grams meets the token windows of the corpus.

Every document is cut into words and its windows are hashed inside the row.  A hash set of the benchmark, a
table of slots of fixed size that goes out with the tasks, drops nearly all windows there and then; more
windows than slots only let more of them pass.  Those left are spelled out and joined to the benchmark on their
words, which verifies them: by broadcast if it has at most ``broadcast_windows`` windows, else by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import lower_ascii, stage, text_of

#: After lower-casing: letters, digits and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text as it stands.
TEXT_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
BROADCAST_WINDOWS = 200_000
#: The table of taken hash slots has one byte a slot and never more than 2 ** MAX_SLOT_BITS.
MAX_SLOT_BITS = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(ITEM_WORD), F.lit(0))


def _with_windows(rows: DataFrame, sizes: list[int], maybe: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``x``: the windows of ``sizes`` words of the word list ``w`` as (pos, m, h, gram), pos from 1.

    ``maybe`` keeps windows by their hash before their words are put together.  Windows of 1, 2, 4, ... words are
    hashed from two halves each and joined to the sizes asked for, so the work per word does not depend on the
    length of the text or of the window.  Each step is a column of its own: written into one expression, every
    half would be computed again.
    """
    pair = lambda a, b, shift: F.zip_with(a, F.slice(b, F.lit(shift + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))
    keep, powers = rows.columns, [1]
    rows = rows.withColumn("__p1", F.transform("w", lambda x: F.xxhash64(x)))
    while 2 * powers[-1] <= max(sizes):
        half = powers[-1]
        powers.append(2 * half)
        rows = rows.withColumn(f"__p{2 * half}", pair(F.col(f"__p{half}"), F.col(f"__p{half}"), half))
    found = []
    for size in sizes:
        done = max(p for p in powers if p <= size)
        rows = rows.withColumn(f"__w{size}", F.col(f"__p{done}"))
        for part in reversed(powers):
            if done + part <= size:
                rows = rows.withColumn(f"__w{size}", pair(F.col(f"__w{size}"), F.col(f"__p{part}"), done))
                done += part
        whole = F.slice(f"__w{size}", F.lit(1), F.greatest(F.lit(0), F.size("w") - size + 1))
        keep_h = maybe or (lambda h: F.lit(True))
        rows = rows.withColumn(f"__x{size}", F.array_compact(F.transform(whole, _if_kept(keep_h))))
        found.append(F.transform(f"__x{size}", _spelled(size)))
    return rows.select(*keep, F.flatten(F.array(*found)).alias("x"))


def _if_kept(keep: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda h, i: F.when(keep(h), F.struct(i.alias("i"), h.alias("h")))


def _spelled(size: int) -> Callable[[Column], Column]:
    """A window with its words joined by a blank, which no word holds."""
    return lambda x: F.struct(
        (x["i"] + 1).alias("pos"), F.lit(size).alias("m"), x["h"].alias("h"),
        F.concat_ws(" ", *[F.get(F.col("w"), x["i"] + k) for k in range(size)]).alias("gram"),
    )


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct (m, h, gram, item): windows of n words; an item of fewer words is one window, one of none has none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(text_of()).alias("w"))
    every = _with_windows(items, list(range(1, n + 1))).select("item", F.size("w").alias("size"), F.explode_outer("x").alias("x"))
    return every.filter(F.col("x.m") == F.least(F.col("size"), F.lit(n))).select("x.m", "x.h", "x.gram", "item").distinct()


def _key() -> Column:
    """Tells rows apart; rows that agree in doc_id and text have equal results."""
    return F.xxhash64(F.col("doc_id"), text_of())


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, row_key, pos, m, item): every occurrence of a benchmark window; pos counts words from 1."""
    grams = stage(benchmark_windows(benchmark, n))
    sizes = sorted(r.m for r in grams.select("m").distinct().collect())  # at most n numbers
    size = grams.count()
    slots = 1 << min(MAX_SLOT_BITS, max(16, (32 * size).bit_length()))
    taken = bytearray(slots)
    for r in grams.select(F.pmod("h", F.lit(slots)).cast("int").alias("slot")).distinct().toLocalIterator():
        taken[r.slot] = 1
    table = F.lit(bytes(taken))
    maybe = lambda h: F.substring(table, F.pmod(h, F.lit(slots)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    rows = docs.select("doc_id", _key().alias("row_key"), words(text_of()).alias("w"))
    # Outer, as the filter that Spark infers for an inner explode would compute all windows a second time.
    near = _with_windows(rows, sizes or [n], maybe).select("doc_id", "row_key", F.explode_outer("x").alias("x"))
    near = near.filter(F.col("x").isNotNull()).select("doc_id", "row_key", "x.pos", "x.m", "x.gram")
    # Equal words, not equal hashes, make a hit.
    exact = grams.select("gram", "item")
    return near.join(F.broadcast(exact) if size <= broadcast_windows else exact, "gram").drop("gram")


def _by_row(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, items, spans): the hit words as merged spans [from, to), counted from 1."""
    rows = found.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set("item")).alias("items"),
        F.array_sort(F.collect_set(F.struct("pos", F.col("m").alias("len")))).alias("at"),
    )
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["pos"] + x["len"]).alias("to"),
        (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(x["pos"], acc["to"]))).alias("n"),
    )
    return rows.withColumn("n_hit", F.aggregate("at", zero, step)["n"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, contaminated.

    Null or empty texts have no words and no hits; a null doc_id stays null; rows that repeat a doc_id are
    judged by their own text; a null item_id counts as the item ''; an empty benchmark hits nothing; other
    columns of either table are ignored.
    """
    rows = docs.select("doc_id", _key().alias("row_key"), F.size(words(text_of())).cast("long").alias("n_words"))
    found = _by_row(hits(docs, benchmark, n, broadcast_windows))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "items", "n_hit")
    joined = rows.join(found, (F.col("row_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    bad = hits(docs, benchmark, n, broadcast_windows).select(F.col("row_key").alias("__bad_key"), F.col("doc_id").alias("__bad_id")).distinct()
    marked = docs.withColumn("__row_key", _key())
    clean = marked.join(bad, (F.col("__row_key") == F.col("__bad_key")) & F.col("doc_id").eqNullSafe(F.col("__bad_id")), "left_anti")
    return clean.drop("__row_key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """All documents; hit words are taken out of the text, what stands between words stays."""
    found = _by_row(hits(docs, benchmark, n, broadcast_windows)).select(
        F.col("row_key").alias("__hit_key"), F.col("doc_id").alias("__hit_id"),
        F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))).alias("__hit"),
    )
    marked = docs.withColumn("__row_key", _key())
    joined = marked.join(found, (F.col("__row_key") == F.col("__hit_key")) & F.col("doc_id").eqNullSafe(F.col("__hit_id")), "left")
    kept = F.split("text", TEXT_WORD, -1)
    own = F.regexp_extract_all("text", F.lit(TEXT_WORD), F.lit(0))
    parts = F.transform(kept, lambda gap, i: F.concat(gap, F.when(F.array_contains("__hit", i + 1), F.lit("")).otherwise(F.coalesce(F.get(own, i), F.lit("")))))
    cleaned = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return joined.withColumn("text", cleaned).select(*docs.columns)
