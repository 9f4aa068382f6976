"""Raw messages -> clean messages, speakers, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.clean import clean_sender, detect_media_type, is_system_sender, sanitize_message
from colloquy.functions.text import col, has, trim
from colloquy.plans.ordered import CUT, cut_chunks, scan

SESSION_GAP_SECONDS = 25 * 60


def parse_timestamp(c) -> Column:
    """Time of a raw stamp: epoch seconds or millis, ISO, Y-M-D or D.M.Y; null when unparseable."""
    raw = trim(col(c).cast("string"))
    number = raw.try_cast("double")
    seconds = F.when(number < 1e10, number).otherwise(number / 1000)
    ymd = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[ ,T]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"
    dmy = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2}),?\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s*UTC([+-]\d{2}:\d{2}))?"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(raw, pattern, i)

    def stamp(pattern: str, y: int, m: int, d: int, zone: Column) -> Column:
        year = F.when(F.length(part(pattern, y)) == 2, F.concat(F.lit("20"), part(pattern, y))).otherwise(
            part(pattern, y)
        )
        day = F.concat_ws("-", year, F.lpad(part(pattern, m), 2, "0"), F.lpad(part(pattern, d), 2, "0"))
        clock = F.concat_ws(
            ":",
            F.lpad(part(pattern, 4), 2, "0"),
            F.lpad(part(pattern, 5), 2, "0"),
            F.lpad(F.coalesce(F.nullif(part(pattern, 6), F.lit("")), F.lit("0")), 2, "0"),
        )
        return F.when(has(raw, pattern), F.concat(day, F.lit(" "), clock, zone).try_cast("timestamp"))

    offset = F.regexp_extract(raw, dmy, 7)
    return F.coalesce(
        F.when(number.isNotNull() & (number > 9999), seconds.cast("timestamp")),
        raw.try_cast("timestamp"),
        stamp(ymd, 1, 2, 3, F.lit("")),
        stamp(dmy, 3, 2, 1, offset),
    )


def normalize_messages(raw: DataFrame, chat: str = "chat_id", order: str = "line_no") -> DataFrame:
    """Raw messages to messages: ids, clean senders, cleaned content, notices and system senders gone.

    Input columns: chat, order (an integer, unique per chat), id, ts_raw, sender, content,
    reply_to_id, media_type.
    """
    numbered = scan(raw, [chat], [order], number="__no")
    name = clean_sender("sender")
    done = numbered.select(
        F.col(chat),
        F.col(order),
        F.coalesce(
            F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("msg_"), F.lpad(F.col("__no").cast("string"), 6, "0"))
        ).alias("id"),
        (F.col("ts") if "ts" in raw.columns else parse_timestamp("ts_raw")).alias("ts"),
        name.alias("sender"),
        sanitize_message(F.coalesce("content", F.lit("")), "media_type").alias("__m"),
        F.col("reply_to_id"),
        F.col("media_type").alias("__given"),
    )
    return (
        done.filter(~is_system_sender("sender") & ~F.col("__m.is_system"))
        .filter((F.col("__m.content") != "") | (F.col("__m.media_type") != "text"))
        .select(
            chat,
            order,
            "id",
            "ts",
            "sender",
            F.col("__m.content").alias("content"),
            "reply_to_id",
            F.coalesce(F.col("__m.media_type"), detect_media_type("__m.content", "__given")).alias("media_type"),
        )
    )


def order_messages(messages: DataFrame, chat: str = "chat_id", ts: str = "ts", order: str = "line_no") -> DataFrame:
    """Add ``seq``: 1-based position per chat by time, input order on ties."""
    cut = cut_chunks(messages, [chat], [ts, order])
    return scan(cut, [chat], [ts, order], chunk=F.col(CUT), number="seq").drop(CUT)


def speaker_counts(messages: DataFrame, chat: str = "chat_id", sender: str = "sender") -> DataFrame:
    return messages.groupBy(chat, sender).agg(F.count(F.lit(1)).alias("message_count"))


def pick_speakers(
    messages: DataFrame,
    chat: str = "chat_id",
    sender: str = "sender",
    seq: str = "seq",
    target: str | None = None,
    counterpart: str | None = None,
) -> DataFrame:
    """One row per chat: (target, counterpart).

    The target is given or the most frequent speaker, ties going to the one seen first; the
    counterpart is given or the most frequent other speaker.
    """
    counts = messages.groupBy(chat, sender).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(seq))).alias("first")
    )
    counts = counts.withColumn("rank", F.struct(F.col("n"), (-F.col(f"first.{seq}")).alias("f")))
    best = counts.groupBy(chat).agg(F.max_by(F.col(sender), "rank").alias("target"))
    if target is not None:
        best = best.withColumn("target", F.lit(target))
    others = (
        counts.join(best, chat)
        .filter(F.lower(sender) != F.lower("target"))
        .groupBy(chat)
        .agg(F.max_by(F.col(sender), "rank").alias("counterpart"))
    )
    picked = best.join(others, chat, "left")
    if counterpart is not None:
        same = F.lower("target") == F.lower(F.lit(counterpart))
        picked = picked.withColumn("counterpart", F.when(same, F.col("counterpart")).otherwise(F.lit(counterpart)))
    return picked


def mark_target(messages: DataFrame, picked: DataFrame, chat: str = "chat_id", sender: str = "sender") -> DataFrame:
    """Add ``is_target``; ``picked`` holds one row per chat."""
    targets = picked.select(chat, F.lower("target").alias("__target"))
    return (
        messages.join(targets, chat, "left")
        .withColumn("is_target", F.coalesce(F.lower(sender) == F.col("__target"), F.lit(False)))
        .drop("__target")
    )


def sessionize(
    messages: DataFrame,
    chat: str = "chat_id",
    ts: str = "ts",
    tie: str = "seq",
    gap_seconds: float = SESSION_GAP_SECONDS,
    width: int | None = None,
) -> DataFrame:
    """Add ``session_no``: a new session starts after a gap longer than ``gap_seconds``.

    Rows without a time come first and never open a session, unless they open the chat.
    """
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = cut_chunks(messages, [chat], [ts, tie], width)
    gaps = scan(cut, [chat], [ts, tie], chunk=F.col(CUT), lag={"__prev": stamp, "__had": F.lit(True)})
    far = F.coalesce((stamp - F.col("__prev")) > F.lit(int(gap_seconds * 1_000_000)), F.lit(False))
    opens = F.when(F.col("__had").isNull() | far, 1).otherwise(0)
    return scan(
        gaps.withColumn("__open", opens), [chat], [ts, tie], chunk=F.col(CUT), running={"session_no": F.col("__open")}
    ).drop("__prev", "__had", "__open", CUT)


def session_rollup(
    messages: DataFrame, chat: str = "chat_id", ts: str = "ts", session: str = "session_no"
) -> DataFrame:
    rolled = messages.groupBy(chat, session).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("message_count")
    )
    return rolled.withColumn(
        "session_id",
        F.concat(
            F.lit("session_"),
            F.lpad(F.col(session).cast("string"), F.greatest(F.lit(4), F.length(F.col(session).cast("string"))), F.lit("0")),
        ),
    )


def chat_summary(messages: DataFrame, chat: str = "chat_id", sender: str = "sender") -> DataFrame:
    """Totals per chat; the counts per speaker are ``speaker_counts``."""
    per_speaker = messages.groupBy(chat, sender).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_target").alias("t")
    )
    return per_speaker.groupBy(chat).agg(
        F.sum("n").alias("total_messages"),
        F.sum("t").alias("target_messages"),
        F.count(F.lit(1)).alias("speaker_count"),
    )
