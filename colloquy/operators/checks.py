"""Rule checks of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named condition a row has to meet; null counts as met."""

    name: str
    column: str
    ok: Column


def required(column: str) -> Rule:
    return Rule("required", column, F.col(column).isNotNull())


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule("range", column, F.col(column).between(low, high))


def one_of(column: str, values: list[str]) -> Rule:
    return Rule("enum", column, F.col(column).isin(values))


def matches(column: str, pattern: str) -> Rule:
    return Rule("pattern", column, F.regexp_like(F.col(column).cast("string"), F.lit(pattern)))


def castable(column: str, kind: str) -> Rule:
    return Rule("type", column, F.col(column).isNull() | F.col(column).try_cast(kind).isNotNull())


def check_table(df: DataFrame, id: str, rules: list[Rule]) -> DataFrame:
    """One row (id, column, rule, value) per violation; one pass, no shuffle."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.coalesce(r.ok, F.lit(True)),
                    F.struct(
                        F.lit(r.column).alias("column"),
                        F.lit(r.name).alias("rule"),
                        F.col(r.column).cast("string").alias("value"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return df.select(F.col(id), F.inline(found))


def missing_components(present: DataFrame, expected: list[str], name: str = "component") -> DataFrame:
    """Names from ``expected`` that do not occur in ``present``."""
    wanted = present.sparkSession.createDataFrame([(e,) for e in expected], f"{name} string")
    return wanted.join(present.select(name), name, "left_anti")
