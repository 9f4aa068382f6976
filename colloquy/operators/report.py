"""Similarity index, quality gates and failure list of scored samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import round_half
from colloquy.plans.ordered import top_k

WEIGHTS = {"lexical": 0.20, "style": 0.20, "behavior": 0.25, "context_score": 0.15, "judge_score": 0.20}
GATES = {"dsi": 0.80, "lexical": 0.80, "style": 0.80, "behavior": 0.75, "context_score": 0.90}
FAILURE_BELOW = 0.78


def weighted_index(columns: dict[str, str] | None = None) -> Column:
    """Weighted sum of the five dimensions; without a context score the others are scaled up."""
    names = columns or {name: name for name in WEIGHTS}
    rest = None
    for name, w in WEIGHTS.items():
        if name != "context_score":
            part = F.col(names[name]) * w
            rest = part if rest is None else rest + part
    context = F.col(names["context_score"])
    return F.when(context.isNotNull(), rest + context * WEIGHTS["context_score"]).otherwise(
        rest / (1 - WEIGHTS["context_score"])
    )


def sample_dsi(scored: DataFrame) -> DataFrame:
    return scored.withColumn("sample_dsi", round_half(weighted_index(), 3))


def evaluation_report(
    scored: DataFrame, keys: list[str], groups: DataFrame | None = None, gates: dict[str, float] = GATES
) -> DataFrame:
    """One row per group: means, index, gates, status, sub-metrics.

    Groups named in ``groups`` that have no sample get the status INSUFFICIENT_DATA.
    """
    means = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dataset_size"), *[round_half(F.avg(name), 3).alias(name) for name in WEIGHTS]
    )
    rows = means.withColumn("dsi", round_half(weighted_index(), 3))
    if groups is not None:
        rows = groups.select(*keys).distinct().join(rows, keys, "left").fillna(0, ["dataset_size"])
    empty = F.col("dataset_size") == 0
    passed = {name: F.coalesce(F.col(name) >= bound, ~empty if name == "context_score" else F.lit(False)) for name, bound in gates.items()}
    every = None
    for flag in passed.values():
        every = flag if every is None else every & flag
    status = (
        F.when(empty, "INSUFFICIENT_DATA")
        .when(every, "PASS")
        .when(F.col("dsi") >= 0.75, "NEEDS_OPTIMIZATION")
        .otherwise("FAIL")
    )
    short = {"context_score": "context"}
    return rows.withColumns(
        {f"{short.get(name, name)}_pass": flag for name, flag in passed.items()}
        | {
            "status": status,
            "dsi_scaled": round_half(F.col("dsi") * 100, 1),
            "emoji_fidelity": F.col("style"),
            "vocabulary_fidelity": F.col("lexical"),
            "sentence_rhythm": F.col("style"),
            "response_strategy": F.col("behavior"),
            "context_fidelity": F.col("context_score"),
        }
    )


def failure_cases(scored: DataFrame, keys: list[str], order: str = "sample_id", k: int = 15) -> DataFrame:
    """The first ``k`` samples below the bar or with an issue."""
    return top_k(failures(scored), keys, [F.col(order)], k)


def failures(scored: DataFrame) -> DataFrame:
    """All samples below the bar or with an issue."""
    rows = scored.withColumn("__dsi", weighted_index())
    failed = rows.filter((F.col("__dsi") < FAILURE_BELOW) | (F.size("issues") > 0)).withColumns(
        {
            "score": round_half("__dsi", 3),
            "issues": F.when(F.size("issues") > 0, F.col("issues")).otherwise(
                F.array(F.lit("sub-threshold behavioral match"))
            ),
        }
    )
    return failed.drop("__dsi")


def sample_limit(samples: DataFrame, keys: list[str], order: str = "sample_id", k: int | None = None) -> DataFrame:
    """The first ``k`` samples per group; all of them without ``k``."""
    return samples if k is None else top_k(samples, keys, [F.col(order)], k).drop("rank")


def issue_counts(failures: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that mention length, a missing emoji or the strategy."""

    def mentions(pattern: str) -> Column:
        return F.exists("issues", lambda i: F.regexp_like(i, F.lit(pattern)))

    return failures.groupBy(*keys).agg(
        F.count_if(mentions("too long|verbose")).alias("verbose_count"),
        F.count_if(mentions("missing(?: characteristic)? emoji")).alias("missing_emoji_count"),
        F.count_if(mentions("strategy|direct")).alias("strategy_count"),
    )


