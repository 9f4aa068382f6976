"""Reply rhythm: latencies, double messages, latency by reply length.

Times are compared over the whole chat, whatever the session.  Percentiles here take the element
at position floor((n - 1) p); they are read from value counts, so one busy chat is no problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numbers import beta_mean, sample_confidence
from colloquy.functions.text import clamp
from colloquy.plans.ordered import CUT, cut_chunks, scan

MINUTE = 60_000
MAX_LATENCY = 30 * MINUTE
# Bounds and defaults in milliseconds (fixed values): median low, high, default; p90 low, high, default.
OVERALL = (2000, 4000, 2800, 4000, 12000, 7500)
BUCKETS = {
    "short": (1500, 3000, 2200, 3000, 6000, 4500),
    "medium": (3000, 5500, 3800, 5000, 9000, 7000),
    "long": (5000, 8000, 6200, 8000, 15000, 11000),
}
MIN_SAMPLES = 3


def reply_gaps(
    messages: DataFrame, chat: str = "chat_id", ts: str = "ts", tie: str = "seq", width: int | None = None
) -> DataFrame:
    """Add ``gap_ms`` and ``prev_is_target`` of the message before, null on the first of a chat."""
    # Milliseconds, as chat exports and live messages carry them.
    stamp = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")
    cut = cut_chunks(messages, [chat], [ts, tie], width)
    seen = scan(
        cut, [chat], [ts, tie], chunk=F.col(CUT), lag={"__prev_ms": stamp, "prev_is_target": F.col("is_target")}
    )
    return seen.withColumn("gap_ms", stamp - F.col("__prev_ms")).drop("__prev_ms", CUT)


def reply_latency(gaps: DataFrame) -> DataFrame:
    """Target messages that answer somebody else within half an hour, with ``latency_ms``."""
    answer = F.col("is_target") & ~F.col("prev_is_target")
    return gaps.filter(answer & (F.col("gap_ms") > 0) & (F.col("gap_ms") < MAX_LATENCY)).withColumnRenamed(
        "gap_ms", "latency_ms"
    )


def double_message_rate(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Share of target messages sent within a minute of the previous own one; smoothed and bounded."""
    later = F.col("is_target") & F.col("prev_is_target").isNotNull()
    again = later & F.col("prev_is_target") & (F.col("gap_ms") > 0) & (F.col("gap_ms") < MINUTE)
    rows = gaps.groupBy(*keys).agg(F.count_if(again).alias("double_count"), F.count_if(later).alias("target_total"))
    return rows.withColumns(
        {
            "double_message_probability": clamp(beta_mean(F.col("double_count"), F.col("target_total")), 0.02, 0.35),
            "double_message_confidence": sample_confidence(F.col("target_total")),
        }
    )


def minute_quantised(messages: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Whether the times of a group look cut to whole minutes."""
    zero = F.second(F.col(ts).cast("timestamp")) == 0
    rows = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("message_count"), F.avg(zero.cast("int")).alias("zero_second_share")
    )
    return rows.withColumn("is_minute_quantised", (F.col("message_count") > 5) & (F.col("zero_second_share") > 0.7))


def floor_percentiles(values: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Element at position floor((n - 1) p) of each group, for several p.

    Works on value counts.  The running count is over distinct values of a group; latencies are
    whole milliseconds below half an hour, so a group has at most 1.8 million of them.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(*keys, value, F.sum("__n").over(upto).alias("__upto"), F.sum("__n").over(group).alias("__all"))
    wanted = {name: F.floor((F.col("__all") - 1) * F.lit(p)) + 1 for name, p in points.items()}
    return placed.groupBy(*keys).agg(
        *[F.min(F.when(F.col("__upto") >= at, F.col(value))).alias(name) for name, at in wanted.items()]
    )


def _sub_minute(latencies: DataFrame) -> DataFrame:
    return latencies.filter((F.col("latency_ms") < MINUTE) & (F.col("latency_ms") % MINUTE != 0))


def latency_profile(latencies: DataFrame, quantised: DataFrame, keys: list[str]) -> DataFrame:
    """Bounded median and p90 beside the raw ones; ``is_default`` where the data cannot tell."""
    sub = _sub_minute(latencies)
    sizes = latencies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if((F.col("latency_ms") < MINUTE) & (F.col("latency_ms") % MINUTE != 0)).alias("sub_minute_count"),
    )
    raw = floor_percentiles(sub, keys, "latency_ms", {"raw_median_ms": 0.5, "raw_p90_ms": 0.9})
    rows = (
        quantised.select(*keys, "is_minute_quantised")
        .join(sizes, keys, "left")
        .join(raw, keys, "left")
        .fillna(0, ["sample_size", "sub_minute_count"])
    )
    known = (F.col("sub_minute_count") >= MIN_SAMPLES) & ~F.col("is_minute_quantised")
    low_m, high_m, def_m, low_p, high_p, def_p = OVERALL
    return rows.withColumns(
        {
            "median_ms": F.when(known, clamp("raw_median_ms", low_m, high_m)).otherwise(F.lit(def_m)).cast("long"),
            "p90_ms": F.when(known, clamp("raw_p90_ms", low_p, high_p)).otherwise(F.lit(def_p)).cast("long"),
            "is_default": ~known,
        }
    )


def length_bucket(text: Column) -> Column:
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(size <= 20, "short").when(size <= 60, "medium").otherwise("long")


def latency_by_length(latencies: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Three rows per group that has latencies: bounded median and p90 by length of the reply."""
    rows = latencies.withColumn("bucket", length_bucket(F.col(content)))
    by = [*keys, "bucket"]
    sub_flag = (F.col("latency_ms") < MINUTE) & (F.col("latency_ms") % MINUTE != 0)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(sub_flag).alias("sub_minute_count"))
    raw = floor_percentiles(_sub_minute(rows), by, "latency_ms", {"raw_median_ms": 0.5, "raw_p90_ms": 0.9})
    total = sizes.groupBy(*keys).agg(F.sum("sample_size").alias("group_size"))
    frame = total.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    joined = frame.join(sizes, by, "left").join(raw, by, "left").fillna(0, ["sample_size", "sub_minute_count"])
    enough = (F.col("group_size") >= MIN_SAMPLES) & (F.col("sample_size") >= MIN_SAMPLES)
    exact = F.col("sub_minute_count") >= MIN_SAMPLES

    def bounded(raw_col: str, place: int) -> Column:
        value = F.lit(None).cast("long")
        for name, bounds in BUCKETS.items():
            low, high, default = bounds[place : place + 3]
            here = F.when(exact, clamp(raw_col, low, high)).otherwise(F.lit(default)).cast("long")
            value = F.when(F.col("bucket") == name, here).otherwise(value)
        return F.when(enough, value)

    return joined.select(
        *by,
        "sample_size",
        bounded("raw_median_ms", 0).alias("median_ms"),
        bounded("raw_p90_ms", 3).alias("p90_ms"),
        (enough & ~exact).alias("is_default"),
    )


def rhythm_table(
    messages: DataFrame, chat: str = "chat_id", ts: str = "ts", tie: str = "seq", content: str = "content",
    width: int | None = None,
) -> DataFrame:
    """One row per chat: latency profile, double messages, latency by length as columns."""
    gaps = reply_gaps(messages, chat, ts, tie, width)
    latencies = reply_latency(gaps)
    profile = latency_profile(latencies, minute_quantised(messages, [chat], ts), [chat])
    by_length = (
        latency_by_length(latencies, [chat], content)
        .groupBy(chat)
        .pivot("bucket", list(BUCKETS))
        .agg(F.first("median_ms").alias("median_ms"), F.first("p90_ms").alias("p90_ms"))
    )
    return profile.join(double_message_rate(gaps, [chat]), chat, "left").join(by_length, chat, "left")
