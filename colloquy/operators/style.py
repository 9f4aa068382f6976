"""Conditional style and response behaviour over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.numbers import beta_mean, sample_confidence
from colloquy.functions.text import EMOJI_SIGN, col, has
from colloquy.lexicons import any_of

SHORT, LONG = 15, 35
# (name, feature, context marker, response feature)
CONDITIONS = [
    ("joking", "emoji", "humor", "has_emoji"),
    ("serious", "emoji", "serious", "has_emoji"),
    ("sadness", "emoji", "sadness", "has_emoji"),
    ("uncertainty", "ellipsis", "uncertainty", "has_ellipsis"),
    ("greeting", "short_reply", "greeting", "is_short"),
    ("explanation", "long_reply", "explanation", "is_long"),
    ("closing", "closing_signoff", "closing", "has_emoji"),
]
# Situation and its context marker.
SITUATIONS = {
    "joking": "humor",
    "emotional": "sadness",
    "greeting": "greeting",
    "explanation": "explanation",
    "closing": "closing",
    "uncertain": "uncertainty",
}


def context_text(context: str | Column = "context") -> Column:
    """The context messages joined by a space."""
    return F.array_join(F.transform(col(context), lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def context_markers(turns: DataFrame, context: str = "context", markers: dict[str, list[str]] = lx.MARKERS) -> DataFrame:
    """Add ``marker_<name>``, ``context_length`` and ``context_question``."""
    staged = turns.withColumn("__context", context_text(context))
    return staged.withColumns(
        {f"marker_{name}": has("__context", any_of(words)) for name, words in markers.items()}
        | {"context_length": F.length("__context"), "context_question": has("__context", "[?？]")}
    ).drop("__context")


def response_features(turns: DataFrame, text: str = "target_message") -> DataFrame:
    size = F.length(text)
    return turns.withColumns(
        {
            "has_emoji": has(text, EMOJI_SIGN),
            "has_ellipsis": has(text, r"\.{2,}|…"),
            "is_short": size <= SHORT,
            "is_long": size >= LONG,
            "response_length": size,
            "asks_back": has(text, "[?？]"),
        }
    )


def features(turns: DataFrame, text: str = "target_message", markers: dict[str, list[str]] = lx.MARKERS) -> DataFrame:
    return response_features(context_markers(turns, markers=markers), text)


def conditional_style(featured: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed P(response feature | context marker), one row per condition and group."""
    wide = featured.groupBy(*keys).agg(
        *[F.count_if(F.col(f"marker_{m}")).alias(f"n_{name}") for name, _, m, _ in CONDITIONS],
        *[F.count_if(F.col(f"marker_{m}") & F.col(r)).alias(f"s_{name}") for name, _, m, r in CONDITIONS],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("condition"),
                F.lit(feature).alias("feature"),
                F.col(f"n_{name}").alias("sample_size"),
                F.col(f"s_{name}").alias("raw_count"),
            )
            for name, feature, _, _ in CONDITIONS
        ]
    )
    return wide.select(*keys, F.inline(rows)).withColumns(
        {
            "probability": beta_mean(F.col("raw_count"), F.col("sample_size")),
            "confidence": sample_confidence(F.col("sample_size")),
        }
    )


def situation_stats(featured: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed emoji, short-reply and follow-up shares per situation that occurs."""
    parts = {"n": F.lit(True), "emoji": F.col("has_emoji"), "short": F.col("is_short"), "follow": F.col("asks_back")}
    wide = featured.groupBy(*keys).agg(
        *[
            F.count_if(F.col(f"marker_{marker}") & flag).alias(f"{part}_{name}")
            for name, marker in SITUATIONS.items()
            for part, flag in parts.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("situation_order"),
                F.lit(name).alias("situation"),
                *[F.col(f"{part}_{name}").alias(part) for part in parts],
            )
            for i, name in enumerate(SITUATIONS)
        ]
    )
    n = F.col("n")
    return (
        wide.select(*keys, F.inline(rows))
        .filter(n > 0)
        .select(
            *keys,
            "situation_order",
            "situation",
            n.alias("evidence_count"),
            beta_mean(F.col("emoji"), n).alias("emoji_probability"),
            beta_mean(F.col("short"), n).alias("short_reply_probability"),
            beta_mean(F.col("follow"), n).alias("follow_up_probability"),
        )
    )


def policy_table(featured: DataFrame, keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Situation statistics with an evidence label; groups without any get one 'unknown' row."""
    n = F.col("evidence_count")
    stats = situation_stats(featured, keys).withColumn(
        "confidence", F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low")
    )
    every = (groups if groups is not None else featured).select(*keys).distinct()
    nothing = F.lit(None).cast("double")
    empty = every.join(stats.select(*keys).distinct(), keys, "left_anti").select(
        *keys,
        F.lit(0).alias("situation_order"),
        F.lit("unknown").alias("situation"),
        F.lit(0).cast("long").alias("evidence_count"),
        nothing.alias("emoji_probability"),
        nothing.alias("short_reply_probability"),
        nothing.alias("follow_up_probability"),
        F.lit("none").alias("confidence"),
    )
    return stats.unionByName(empty)
