"""Emoji and sticker use: frequency, context tags, position, per group of ``keys``.

``texts`` holds all target texts (keys, seq, text); ``turns`` the train turns (keys, context,
target_message).  An asset seen in a turn takes its tags and positions from turns only; any other
asset takes them from the first text it occurs in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import round_half
from colloquy import lexicons as lx
from colloquy.functions.emoji import CASUAL, context_tags, extract_emojis, extract_stickers, position
from colloquy.functions.text import trim
from colloquy.operators.style import context_text
from colloquy.plans.ordered import top_k

POSITIONS = ["suffix", "prefix", "standalone", "inline"]


def asset_rows(
    texts: DataFrame, turns: DataFrame, keys: list[str], seq: str = "seq", extract=extract_emojis, rules=lx.EMOJI_TAGS
) -> tuple[DataFrame, DataFrame]:
    """(uses, sightings): one row per occurrence in a text, and per occurrence that carries context."""
    uses = texts.select(*keys, F.col(seq).alias("seq"), F.col("text"), F.posexplode(extract("text")).alias("nth", "asset"))
    both = trim(F.concat_ws(" ", context_text("context"), F.col("target_message")))
    in_turns = turns.select(*keys, F.col("target_message").alias("text"), both.alias("tagged")).select(
        *keys, "text", F.explode(extract("text")).alias("asset"), context_tags("tagged", rules).alias("tags")
    )
    seen = in_turns.select(*keys, "asset").distinct()
    # The first text of an asset without turns gives its context once.
    first = (
        uses.join(seen, [*keys, "asset"], "left_anti")
        .groupBy(*keys, "asset")
        .agg(F.min_by("text", F.struct("seq", "nth")).alias("text"))
        .select(*keys, "text", "asset", context_tags(trim("text"), rules).alias("tags"))
    )
    sightings = in_turns.unionByName(first).withColumn("position", position("text", "asset"))
    return uses, sightings


def context_counts(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """(asset, tag, count, share): the share is of all tag counts of the asset."""
    counts = (
        sightings.select(*keys, "asset", F.explode("tags").alias("tag"))
        .groupBy(*keys, "asset", "tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy(*keys, "asset").agg(F.sum("count").alias("all"))
    return counts.join(totals, [*keys, "asset"]).select(
        *keys, "asset", "tag", "count", round_half(F.col("count") / F.col("all"), 4).alias("share")
    )


def position_style(sightings: DataFrame, keys: list[str]) -> DataFrame:
    total = F.count(F.lit(1))
    return sightings.groupBy(*keys, "asset").agg(
        *[round_half(F.count_if(F.col("position") == p) / total, 4).alias(p) for p in POSITIONS]
    )


def asset_confidence(count: Column) -> Column:
    return F.when(count <= 1, 0.60).when(count <= 3, 0.75).when(count <= 10, 0.88).otherwise(0.95)


def asset_frequency(texts: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    totals = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"))
    counts = uses.groupBy(*keys, "asset").agg(F.count(F.lit(1)).alias("raw_count"))
    return counts.join(totals, keys).select(
        *keys,
        "asset",
        "raw_count",
        round_half(F.col("raw_count") / F.col("texts"), 4).alias("frequency"),
        asset_confidence(F.col("raw_count")).alias("confidence"),
    )


def _table(texts: DataFrame, turns: DataFrame, keys: list[str], seq: str, extract, rules) -> tuple[DataFrame, DataFrame]:
    uses, sightings = asset_rows(texts, turns, keys, seq, extract, rules)
    by = [*keys, "asset"]
    # One entry per tag of the rule list, so the map is small.
    maps = (
        context_counts(sightings, keys)
        .groupBy(*by)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "share")))).alias("context_distribution"))
        .withColumn("contexts", F.map_keys("context_distribution"))
    )
    every = asset_frequency(texts, uses, keys).join(maps, by, "left")
    contexts = F.coalesce("contexts", F.array(F.lit(CASUAL)))
    return every.withColumn("contexts", contexts), sightings


def emoji_table(
    texts: DataFrame, turns: DataFrame, keys: list[str], seq: str = "seq", rules=lx.EMOJI_TAGS
) -> DataFrame:
    """Emojis with count, frequency, confidence, context distribution and position style."""
    rows, sightings = _table(texts, turns, keys, seq, extract_emojis, rules)
    places = position_style(sightings, keys).select(*keys, "asset", F.struct(*POSITIONS).alias("position_style"))
    return rows.join(places, [*keys, "asset"], "left")


def sticker_table(
    texts: DataFrame, turns: DataFrame, keys: list[str], seq: str = "seq", rules=lx.EMOJI_TAGS
) -> DataFrame:
    """As ``emoji_table`` for bracketed stickers, without positions."""
    return _table(texts, turns, keys, seq, extract_stickers, rules)[0]


def asset_summary(texts: DataFrame, keys: list[str], seq: str = "seq", k: int = 8) -> DataFrame:
    """Totals per group: emojis, stickers, vocabulary, share of texts with an emoji, favourite emojis."""
    rows = texts.select(
        *keys, F.col(seq).alias("seq"), extract_emojis("text").alias("e"), F.size(extract_stickers("text")).alias("s")
    )
    totals = rows.groupBy(*keys).agg(
        F.sum(F.size("e")).alias("total_emojis"),
        F.sum("s").alias("total_stickers"),
        round_half(F.avg((F.size("e") > 0).cast("int")), 4).alias("emoji_rate"),
    )
    counts = rows.select(*keys, F.explode("e").alias("asset"), "seq").groupBy(*keys, "asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")
    )
    size = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("emoji_vocabulary_size"))
    top = (
        top_k(counts, keys, [F.col("n").desc(), F.col("first"), F.col("asset")], k)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset"))), lambda x: x["asset"]).alias("characteristic"))
    )
    return totals.join(size, keys, "left").join(top, keys, "left").fillna(0, ["emoji_vocabulary_size"])


def emoji_by_context(table: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Up to ``k`` most used emojis for each tag except casual chat."""
    rows = table.select(*keys, F.explode("contexts").alias("tag"), "asset", "raw_count").filter(F.col("tag") != CASUAL)
    return top_k(rows, [*keys, "tag"], [F.col("raw_count").desc(), F.col("asset")], k)
