"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import col


def round_half(c, digits: int = 0) -> Column:
    """Round halves up on the binary value, as ``floor(x * 10^d + 0.5) / 10^d``.

    ``F.round`` looks at the decimal text instead and differs on values such as 0.5085.
    """
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def beta_mean(successes: Column, total: Column) -> Column:
    """Posterior mean of a share under a uniform prior."""
    return round_half((successes + 1) / (total + 2), 3)


def sample_confidence(total: Column) -> Column:
    return round_half(F.tanh(total / F.lit(20.0)), 3)


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; null where both are zero."""
    return F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0))


def rate(flag: Column, digits: int = 4) -> Column:
    """Share of rows where the flag is set."""
    return round_half(F.avg(flag.cast("int")), digits)
