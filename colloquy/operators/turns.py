"""Turns (reply with its context) and the train / validation / blind split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import trim
from colloquy.plans.ordered import preceding, scan

CONTEXT_SIZE = 5
TRAIN_SHARE = 0.70
VALIDATION_SHARE = 0.15


def build_turns(
    messages: DataFrame,
    chat: str = "chat_id",
    session: str = "session_no",
    seq: str = "seq",
    sender: str = "sender",
    content: str = "content",
    ts: str | None = "ts",
    context_size: int = CONTEXT_SIZE,
    width: int | None = None,
    numbered: bool = True,
) -> DataFrame:
    """One row per target message with something before it in its session.

    ``context`` holds up to ``context_size`` messages before it, oldest first.  Without ``numbered`` there is
    no ``turn_no`` and ``turn_id``, and the contexts are not dealt out again for them.
    """
    fields = [F.col(sender).alias("sender"), F.col(content).alias("content")]
    if ts:
        fields.append(F.col(ts).alias("ts"))
    with_context = preceding(
        messages, [chat, session], [seq], size=context_size, item=F.struct(*fields), name="context", width=width
    )
    kept = with_context.filter(
        F.col("is_target") & (F.size("context") > 0) & (F.coalesce(trim(content), F.lit("")) != "")
    )
    named = kept.withColumnsRenamed({content: "target_message", sender: "target_sender"})
    return turn_ids(named, chat, session, seq, width) if numbered else named


def turn_ids(
    turns: DataFrame, chat: str = "chat_id", session: str = "session_no", seq: str = "seq", width: int | None = None
) -> DataFrame:
    """Add ``turn_no`` per session and ``turn_id``."""
    numbered = scan(turns, [chat, session], [seq], width=width, number="turn_no")
    text = F.col("turn_no").cast("string")
    return numbered.withColumn(
        "turn_id",
        F.concat(
            F.lit("sample_"), F.col(session).cast("string"), F.lit("_"),
            F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")),
        ),
    )


def split_plan(
    turns: DataFrame,
    chat: str = "chat_id",
    session: str = "session_no",
    train: float = TRAIN_SHARE,
    validation: float = VALIDATION_SHARE,
) -> DataFrame:
    """One row per session that has turns, with what decides the split of its turns."""
    sessions = turns.groupBy(chat, session).agg(F.count(F.lit(1)).alias("turns"))
    placed = scan(sessions, [chat], [session], number="place", running={"upto": F.col("turns")})
    totals = sessions.groupBy(chat).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("turns").alias("n_turns")
    )
    n = F.col("n_sessions")
    raw_val = F.greatest(F.lit(1), F.floor(n * F.lit(validation)))
    raw_test = F.greatest(F.lit(1), F.floor(n * F.lit(1 - train - validation)))
    over = raw_val + raw_test >= n
    val, test = F.when(over, 1).otherwise(raw_val), F.when(over, 1).otherwise(raw_test)
    return placed.join(totals, chat).select(
        chat,
        session,
        "place",
        (F.col("upto") - F.col("turns")).alias("turns_before"),
        "n_sessions",
        "n_turns",
        F.greatest(F.lit(1), n - val - test).alias("n_train"),
        val.alias("n_val"),
        F.greatest(F.lit(1), F.floor(F.col("n_turns") * F.lit(train))).alias("first_turns"),
        F.floor(F.col("n_turns") * F.lit(validation)).alias("val_turns"),
    )


def split_turns(
    turns: DataFrame,
    chat: str = "chat_id",
    session: str = "session_no",
    train: float = TRAIN_SHARE,
    validation: float = VALIDATION_SHARE,
) -> DataFrame:
    """Add ``split``.

    With three or more sessions whole sessions go to one split; below that the turns of the chat
    are cut in order.
    """
    plan = split_plan(turns, chat, session, train, validation)
    by_session = (
        F.when(F.col("place") <= F.col("n_train"), "train")
        .when(F.col("place") <= F.col("n_train") + F.col("n_val"), "validation")
        .otherwise("test")
    )
    nth = F.col("turns_before") + F.col("turn_no")
    in_order = (
        F.when(nth <= F.col("first_turns"), "train")
        .when(nth <= F.col("first_turns") + F.col("val_turns"), "validation")
        .otherwise("test")
    )
    split = F.when(F.col("n_sessions") >= 3, by_session).otherwise(in_order)
    return turns.join(plan, [chat, session]).select(*turns.columns, split.alias("split"))
