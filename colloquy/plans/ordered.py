"""Ordered scans over groups of any size.

``row_number``, ``lag`` and running sums over ``partitionBy(chat)`` put a whole
chat into one task.  Here every group is cut into chunks by its order column, so
a task only ever sees one chunk; what has to cross a chunk border (row count,
last row, sums) is a small aggregate with one row per chunk, scanned per group
and joined back.  Windows, aggregate and join all use one partitioning by group
and chunk, so the rows are read and shuffled once (see ``_dealt``).  Chunks of a
time column are days; where a day is too busy for one task, ``cut_chunks`` cuts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.plans import lineage

CHUNK = "__chunk"
CUT = "__cut"
ROWS_PER_CHUNK = 100_000
SECONDS_PER_CHUNK = 86_400
#: Parts that a busy chunk is cut into.
QUANTILES = 1024


def chunk_of(df: DataFrame, order: str, width: int | None = None, tie: str | None = None) -> Column:
    """Chunk number of an integer or time column; nulls come first, cut by ``tie`` if that is an integer.

    ``width`` counts units of an integer column, or seconds of a time column.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # Widening to micros keeps sub-second borders exact.
        size = int((width or SECONDS_PER_CHUNK) * 1_000_000)
        value = F.unix_micros(F.col(order).cast("timestamp"))
    else:
        size, value = int(width or ROWS_PER_CHUNK), F.col(order).cast("long")
    none = F.lit(-(2**62))
    if tie is not None and _whole(df, tie):
        none = none + F.coalesce(F.floor(F.col(tie) / F.lit(ROWS_PER_CHUNK)).cast("long"), F.lit(-(2**61)))
    return F.coalesce(F.floor(value / F.lit(size)).cast("long"), none)


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _not_above(borders: Column, value: Column, most: int) -> Column:
    """How many of the sorted borders (``most`` at most) are not above the value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(borders, at + s - 1) <= value, at + s).otherwise(at))


def _borders(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sorted quantiles of a whole-number column per group; one that fills several quantiles gets a part of its own."""
    quantiles = F.percentile_approx(value, [k / QUANTILES for k in range(1, QUANTILES)], 10 * QUANTILES)
    often = F.filter("q", lambda x, i: (i > 0) & (x == F.get("q", i - 1)))
    cut = F.array_sort(F.array_distinct(F.concat("q", F.transform(often, lambda x: x + 1))))
    return values.groupBy(*by).agg(quantiles.alias("q")).select(*by, cut.alias("__borders"))


def cut_chunks(df: DataFrame, keys: list[str], order: list[str], width: int | None = None, rows: int | None = None) -> DataFrame:
    """Add ``CUT``, the chunk of each row for ``scan(chunk=F.col(CUT))``, with busy chunks cut at quantiles.

    Chunks of more than ``rows`` rows (a chat with one busy day) are found by a count when this is called.  They are cut
    where a quantile sketch of the first order column says so, and where a single value is what fills them, at
    quantiles of the second, if that is an integer.  If there are none, the plan is that of plain chunks.
    """
    limit = rows or ROWS_PER_CHUNK
    marked = df.withColumn(CUT, chunk_of(df, order[0], width, order[1] if len(order) > 1 else None))
    by = [*keys, CUT]
    busy = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    if busy.isEmpty():
        return marked
    kind = df.schema[order[0]].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    value = F.unix_micros(F.col(order[0]).cast("timestamp")) if timed else F.col(order[0]).cast("long")
    values = marked.select(*by, value.alias("__value"), *([F.col(order[1]).cast("long").alias("__tie")] if len(order) > 1 and _whole(df, order[1]) else []))
    first = lineage.cut(_borders(values.join(busy.select(*by), by, "left_semi"), by, "__value"))
    part = F.coalesce(_not_above(F.col("__borders"), F.col("__value"), 2 * QUANTILES), F.lit(0))
    out = marked.withColumn("__value", value).join(first, by, "left").withColumn("__part", part).drop("__borders")
    tie = F.lit(0)
    if "__tie" in values.columns:
        parted = values.join(first, by).withColumn("__part", part)
        full = parted.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("__value").alias("__values"))
        full = full.filter((F.col("__n") > limit) & (F.col("__values") <= 1)).select(*by, "__part")
        second = lineage.cut(_borders(parted.drop("__borders").join(full, [*by, "__part"], "left_semi"), [*by, "__part"], "__tie"))
        out = out.join(second, [*by, "__part"], "left")
        tie = F.coalesce(_not_above(F.col("__borders"), F.col(order[1]).cast("long"), 2 * QUANTILES), F.lit(0))
    return out.select(*df.columns, F.struct(F.col(CUT).alias("a"), F.col("__part").alias("b"), tie.alias("c")).alias(CUT))


def _dealt(df: DataFrame, by: list[str], chunk: Column) -> DataFrame:
    """The rows with their chunk, dealt out by group and chunk: the exchange that both branches of a scan share."""
    return df.withColumn(CHUNK, chunk).repartition(*by)


def _touched(df: DataFrame) -> Column:
    """A value of all columns that is there wherever there is a row.

    Both branches ask for it, so both read the same columns; their exchanges are then the same and Spark runs them
    once.  Without it each would be pruned to its own columns and read the source again, at every scan of a chain.
    Callers select the columns they need before they scan.
    """
    plain = [c for c, kind in df.dtypes if kind != "variant" and "map<" not in kind]
    return F.max(F.hash(*plain))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    width: int | None = None,
    chunk: Column | None = None,
    number: str | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    last_seen: dict[str, Column] | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add ordered columns per group of ``keys``; ``order`` must be total within a group.

    ``number``     1-based row number.
    ``lag``        value of an expression on the previous row.
    ``lead``       value of an expression on the next row.
    ``running``    inclusive running sum of a numeric expression.
    ``last_seen``  last non-null value of an expression up to and including the row.
    """
    lag, lead, running, last_seen = lag or {}, lead or {}, running or {}, last_seen or {}
    by = [*keys, CHUNK]
    base = _dealt(df, by, chunk if chunk is not None else chunk_of(df, order[0], width, order[1] if len(order) > 1 else None))
    where = F.struct(*[F.col(c) for c in order])
    local = Window.partitionBy(*by).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # One row per chunk: what later chunks need to know about it.
    parts = [F.count(F.lit(1)).alias("__n"), _touched(df).alias("__touched")]
    if lag:
        parts.append(F.max_by(F.struct(*[e.alias(n) for n, e in lag.items()]), where).alias("__lag"))
    if lead:
        parts.append(F.min_by(F.struct(*[e.alias(n) for n, e in lead.items()]), where).alias("__lead"))
    parts += [F.sum(e).alias(f"__sum_{n}") for n, e in running.items()]
    parts += [
        F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), where)).alias(f"__seen_{n}")
        for n, e in last_seen.items()
    ]
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c_n")]
    if lag:
        carry.append(F.lag("__lag").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__c_lag"))
    if lead:
        carry.append(F.lead("__lead").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__c_lead"))
    carry += [
        F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__c_sum_{n}") for n in running
    ]
    carry += [
        F.last(f"__seen_{n}", ignorenulls=True).over(before).alias(f"__c_seen_{n}") for n in last_seen
    ]
    edges = base.groupBy(*by).agg(*parts).filter("__touched is not null").select(*by, *carry)

    rows = base.select(
        "*",
        F.row_number().over(local).alias("__rn"),
        _touched(df).over(upto).alias("__touched"),
        *[F.lag(F.struct(e.alias("v"))).over(local).alias(f"__l_{n}") for n, e in lag.items()],
        *[F.lead(F.struct(e.alias("v"))).over(local).alias(f"__d_{n}") for n, e in lead.items()],
        *[F.sum(e).over(upto).alias(f"__r_{n}") for n, e in running.items()],
        *[
            F.last(F.when(e.isNotNull(), F.struct(e.alias("v"))), ignorenulls=True).over(upto).alias(f"__s_{n}")
            for n, e in last_seen.items()
        ],
    )
    out = [F.col(c) for c in df.columns]
    if keep_chunk:
        out.append(F.col(CHUNK))
    if number:
        out.append((F.col("__c_n") + F.col("__rn")).cast("long").alias(number))
    out += [
        F.when(F.col("__rn") == 1, F.col(f"__c_lag.{n}")).otherwise(F.col(f"__l_{n}.v")).alias(n) for n in lag
    ]
    out += [
        F.when(F.col(f"__d_{n}").isNull(), F.col(f"__c_lead.{n}")).otherwise(F.col(f"__d_{n}.v")).alias(n) for n in lead
    ]
    out += [(F.col(f"__c_sum_{n}") + F.coalesce(f"__r_{n}", F.lit(0))).alias(n) for n in running]
    out += [
        F.when(F.col(f"__s_{n}").isNotNull(), F.col(f"__s_{n}.v")).otherwise(F.col(f"__c_seen_{n}.v")).alias(n)
        for n in last_seen
    ]
    return rows.filter("__touched is not null").join(edges, by).select(*out)


def preceding(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    size: int,
    item: Column,
    name: str,
    width: int | None = None,
) -> DataFrame:
    """Add an array with ``item`` of up to ``size`` rows before each row, oldest first."""
    by = [*keys, CHUNK]
    base = _dealt(df, by, chunk_of(df, order[0], width, order[1] if len(order) > 1 else None))
    local = Window.partitionBy(*by).orderBy(*order)
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    # The last rows of every chunk.
    tail = (
        base.select("*", item.alias("__item"), F.row_number().over(newest).alias("__rn"))
        .filter(F.col("__rn") <= size)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("o"), "__item"))).alias("__tail"), _touched(df).alias("__touched"))
        .filter("__touched is not null")
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-size, -1)
    carry = tail.select(
        *by, F.transform(F.flatten(F.collect_list("__tail").over(before)), lambda s: s["__item"]).alias("__carry")
    )
    here = F.collect_list(item).over(local.rowsBetween(-size, -1))
    both = F.concat(F.col("__carry"), F.col("__here"))
    last = F.slice(both, F.greatest(F.size(both) - size + 1, F.lit(1)), F.lit(size))
    return (
        base.select("*", here.alias("__here"), _touched(df).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__touched"))
        .filter("__touched is not null")
        .join(carry, by)
        .select(*df.columns, last.alias(name))
    )


def top_k(df: DataFrame, keys: list[str], by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)
