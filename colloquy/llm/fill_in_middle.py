"""Fill-in-the-middle transformation by counted quantifiers.

``regexp_count`` gives the units n of a text (code points).  Two cuts a <= b are drawn from a hash of the
document's id, and a pattern made for the row, ``\\A(unit{a}+)(unit{b-a}+)(rest)``, captures prefix, middle and
suffix in a single match whose replacement puts them in their new order.  The counts are possessive: nothing is
tried twice, so a match is linear in the text.  Everything is a column expression: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import text_of

UNIT = "(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units counted by one match, so that counting a long text makes few strings.
BLOCK = 256


def count_units(text: Column, unit: str = UNIT) -> Column:
    """Number of units, for a unit that matches every character: whole blocks first, then what is left."""
    blocks = F.regexp_count(text, F.lit(f"{unit}{{{BLOCK}}}+"))
    rest = F.regexp_replace(text, f"\\A(?:{unit}{{{BLOCK}}}+)++", "")
    return blocks.cast("long") * BLOCK + F.regexp_count(rest, F.lit(unit))


def draws(doc_id: Column, seed: str) -> Column:
    """Four numbers below 2^32 from the id: the first digits of a hash, eight a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    form is ``plain`` (output is the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
    Empty texts and texts that hold a mark themselves stay plain, their counts of prefix and middle are null.  Null
    text reads as empty, a null doc_id as an empty one; rows that repeat a doc_id are cut by the same draws, each
    within its own length, and give one row each.  Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", text_of().alias("text"), draws(F.col("doc_id"), seed).alias("h"))
    h = lambda k: F.col("h")[k]
    rows = rows.withColumn("n", count_units(F.col("text")))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (
        F.when((F.col("n") == 0) | marked | (h(2) % 100 >= 100 - plain_percent), "plain")
        .when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    )
    x, y = h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)
    rows = rows.withColumns({"form": form, "a": F.least(x, y), "b": F.greatest(x, y)})
    pattern = F.format_string(f"\\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)({UNIT}*+)", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    plain = F.col("form") == "plain"
    return rows.select(
        "doc_id", "n", "form", F.when(~plain, F.col("a")).alias("prefix_chars"), F.when(~plain, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made the output from.  No part holds a mark, so the first marks found are the real ones."""
    part = f"({UNIT}*?)"
    psm = F.regexp_replace(output, f"\\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}({UNIT}*+)", "$1$3$2")
    spm = F.regexp_replace(output, f"\\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}({UNIT}*+)", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
