"""Exemplar turns: short clean pairs that show the speaker in different phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions import clean
from colloquy.functions.text import col, has, trim
from colloquy.plans.ordered import top_k

CASUAL = "casual_sharing"
# Slots in the order they are filled.
SLOTS = ["greeting", "banter", "agreement", "affection", CASUAL, "banter"]
LEADING_MARK = r"^[，。！？?!~～、:：]"


def counterpart_burst(context, target_sender) -> Column:
    """Messages at the end of the context by one sender other than the target, oldest first."""
    messages = F.reverse(col(context))
    me = F.lower(col(target_sender))
    last = F.lower(F.get(messages, F.lit(0))["sender"])
    # Position of the first message, going back, by somebody else.
    other = F.array_position(F.transform(messages, lambda m: (F.lower(m["sender"]) != last).cast("int")), 1)
    run = F.when(other > 0, F.slice(messages, F.lit(1), (other - 1).cast("int"))).otherwise(messages)
    return F.when(last == me, F.slice(messages, F.lit(1), F.lit(0))).otherwise(F.reverse(run))


def _usable(c: str) -> Column:
    return F.length(c).between(2, 35) & ~clean.is_polluted(c) & ~has(c, LEADING_MARK)


def exemplar_pairs(turns: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, order, counterpart_sender, counterpart_text, target_text, phase) of the turns that qualify."""
    staged = turns.select(
        *keys,
        order,
        trim("target_message").alias("target_text"),
        counterpart_burst("context", "target_sender").alias("__burst"),
    ).filter(F.size("__burst") > 0)
    texts = F.filter(
        F.transform("__burst", lambda m: trim(F.coalesce(m["content"], F.lit("")))), lambda t: ~clean.is_polluted(t)
    )
    staged = staged.select(
        *keys,
        order,
        F.get("__burst", F.lit(0))["sender"].alias("counterpart_sender"),
        F.array_join(texts, "\n").alias("counterpart_text"),
        "target_text",
    )
    kept = staged.filter(
        _usable("target_text")
        & _usable("counterpart_text")
        & ~clean.is_system_sender("counterpart_sender")
        & (F.lower("target_text") != F.lower("counterpart_text"))
        & ~((F.length("counterpart_text") <= 3) & has("counterpart_text", "[?？]"))
    )
    return kept.withColumn("phase", exemplar_phase(F.concat_ws(" ", "counterpart_text", "target_text")))


def exemplar_phase(c, phases: dict[str, list[str]] = lx.PHASES) -> Column:
    hits = [F.when(has(c, lx.any_of(words)), F.lit(name)) for name, words in phases.items()]
    return F.coalesce(*hits, F.lit(CASUAL))


def select_exemplars(pairs: DataFrame, keys: list[str], order: str = "seq", k: int = 6) -> DataFrame:
    """Fill the slots with the earliest pair of each phase, then with the earliest others up to ``k``."""
    # No slot or filler needs more than the first k pairs of a phase.
    per_phase = top_k(pairs, [*keys, "phase"], [F.col(order)], k, rank="nth")
    slot = F.lit(None).cast("int")
    for phase in dict.fromkeys(SLOTS):
        for nth, place in enumerate([i for i, p in enumerate(SLOTS) if p == phase], start=1):
            slot = F.when((F.col("phase") == phase) & (F.col("nth") == nth), F.lit(place)).otherwise(slot)
    ranked = per_phase.withColumn("__slot", F.coalesce(slot, F.lit(len(SLOTS))))
    return top_k(ranked, keys, [F.col("__slot"), F.col(order)], k).drop("__slot", "nth")
