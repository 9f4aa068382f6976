"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.frames import conversations
from colloquy.operators import language
from colloquy.queries import behaviour, live, memory, messages, scores, talk, world  # noqa: F401
from colloquy.registry import REGISTRY

__all__ = ["REGISTRY", "flagship"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Message counts, length distribution and punctuation rates per role."""
    texts = language.base_texts(conversations(spark, sf), target_only=False)
    lengths = language.length_distribution(texts, ["sender"])
    rates = language.punctuation_rates(texts, ["sender"]).drop("sample_size")
    return lengths.join(rates, "sender").withColumnRenamed("sender", "role").select("role", F.expr("* except (role)"))
