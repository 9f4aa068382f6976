"""Perception of messages, working memory and counters of a session."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy import lexicons as lx
from colloquy.functions.text import col, has, trim
from colloquy.plans.ordered import top_k

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def perceive(text, lexicon: dict[str, list[str]] = lx.INTENTS) -> Column:
    """struct(intent, sentiment, pressure, affection, humor, importance, apology_strength)."""
    t = trim(F.lower(F.coalesce(col(text), F.lit(""))))
    on = {name: has(t, lx.any_of(words)) for name, words in lexicon.items()}

    def first(cases: list[tuple[str, float | str]], otherwise) -> Column:
        out = F.lit(otherwise)
        for name, value in reversed(cases):
            out = F.when(on[name], F.lit(value)).otherwise(out)
        return out

    early = [("crisis", "emotional_crisis"), ("demand", "demand"), ("confession", "confession")]
    returned = on["crisis"] | on["demand"] | on["confession"]
    late = [("affection", "affection"), ("provocation", "provocation"), ("complaint", "complaint"), ("apology", "apology")]
    plain = F.when(on["question"], "question").when(on["tease"], "tease").when(F.length(t) <= 3, "short_ack").otherwise("chat")
    intent = plain
    for name, value in reversed(early + late):
        intent = F.when(on[name], F.lit(value)).otherwise(intent)
    importance = (
        F.when(on["provocation"], 0.85).when(intent == "question", 0.5).when(intent == "short_ack", 0.2).otherwise(0.3)
    )
    attached = F.when(on["complaint"] & on["attachment"], 0.35).otherwise(0.0)
    return F.struct(
        intent.alias("intent"),
        first(
            [("crisis", -0.60), ("demand", -0.20), ("confession", 0.70), ("affection", 0.80), ("provocation", -0.85),
             ("complaint", -0.45), ("apology", 0.2)], 0.1,
        ).alias("sentiment"),
        first(
            [("crisis", 0.90), ("demand", 0.60), ("confession", 0.70), ("provocation", 0.80), ("complaint", 0.55)], 0.1
        ).alias("pressure"),
        F.when(on["crisis"] | on["demand"], 0.0)
        .when(on["confession"] | on["affection"], 0.85)
        .otherwise(attached)
        .alias("affection"),
        F.when(~returned & on["tease"], 0.70).otherwise(0.0).alias("humor"),
        F.when(on["crisis"], 0.95).when(on["demand"], 0.60).when(on["confession"], 0.80).otherwise(importance).alias("importance"),
        F.when(on["apology"], F.when(on["sincere"], 0.92).otherwise(0.75)).otherwise(0.0).alias("apology_strength"),
    )


def working_memory(messages: DataFrame, keys: list[str], order: list[str], size: int = 10) -> DataFrame:
    """The newest ``size`` messages per session, ``rank`` 1 being the newest."""
    return top_k(messages, keys, [F.col(c).desc() for c in order], size)


def working_memory_stream(
    messages: DataFrame, key: str, key_type: str = "long", ts: str = "ts", id: str = "message_id", text: str = "text", size: int = 10, watermark: str = "1 hour", idle_hours: float = 168.0
) -> DataFrame:
    """The buffer after every batch that brings something for a session (update mode).

    A session that brings nothing for ``idle_hours`` of event time is forgotten.
    """
    rows = messages.withWatermark(ts, watermark).select(key, ts, id, F.coalesce(text, F.lit("")).alias("text"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames), ignore_index=True)
        new = pd.DataFrame({"micros": new[ts].astype("datetime64[us]").astype("int64"), "id": new[id], "text": new["text"]})
        if state.exists:
            new = pd.concat([pd.DataFrame(dict(zip(("micros", "id", "text"), state.get, strict=True))), new])
        last = new.sort_values(["micros", "id"]).tail(size)
        lists = tuple(last[c].tolist() for c in ("micros", "id", "text"))
        state.update(lists)
        newest = max(int(lists[0][-1] // 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + int(idle_hours * 3_600_000))
        yield pd.DataFrame({key: [group[0]], "ids": [lists[1]], "texts": [lists[2]]})

    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, ids array<long>, texts array<string>", "micros array<long>, ids array<long>, texts array<string>",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def session_counters(messages: DataFrame, keys: list[str], ts: str = "ts", id: str = "message_id", watermark: str = "10 minutes") -> DataFrame:
    """First and last time and message count per session; a message id counts once."""
    if messages.isStreaming:
        rows = messages.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id])
    else:
        rows = messages.dropDuplicates([id])
    return rows.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("message_count")
    )


def session_counters_stream(
    messages: DataFrame, keys: list[str], ts: str = "ts", id: str = "message_id", watermark: str = "10 minutes", idle_hours: float = 168.0
) -> DataFrame:
    """The counters of each session that a batch brings something for (update mode).

    A message id counts once.  Messages older than the watermark are dropped, so a session keeps only the ids that are
    not; a message without a time or an id is dropped.  A session that brings nothing for ``idle_hours`` of event time is
    forgotten, and starts anew should it come back.
    """
    kinds = dict(messages.dtypes)
    rows = messages.withWatermark(ts, watermark).filter(F.col(ts).isNotNull() & F.col(id).isNotNull())
    rows = rows.select(*keys, ts, F.unix_micros(ts).alias("micros"), F.col(id).alias("id"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        late = max(0, state.getCurrentWatermarkMs()) * 1000
        first, last, n, micros, ids = state.get if state.exists else (None, None, 0, [], [])
        seen = {i: t for t, i in zip(micros, ids, strict=True) if t >= late}
        changed = False
        for frame in frames:
            for t, i in zip(frame["micros"].tolist(), frame["id"].tolist(), strict=True):
                if t >= late and i not in seen:
                    seen[i], n, changed = t, n + 1, True
                    first, last = (t, t) if first is None else (min(first, t), max(last, t))
        if n:
            state.update((first, last, n, list(seen.values()), list(seen)))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + int(idle_hours * 3_600_000))
        if changed:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, group, strict=True)}, "first": [first], "last": [last], "message_count": [n]})

    of_keys = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    counted = rows.groupBy(*keys).applyInPandasWithState(
        step, f"{of_keys}, first long, last long, message_count long",
        f"first long, last long, n long, micros array<long>, ids array<{kinds[id]}>", "update", GroupStateTimeout.EventTimeTimeout,
    )
    return counted.select(*keys, F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "message_count")
