"""Chat formatting by quotation linking.

Quoted lines (``>``, nested as ``> >``) are parsed to levels; runs of lines of one level are passages.  Normalised
passages and their lines are hashed and joined to the first message of the conversation that said them in its own
words, earlier than the quoting one.  The nearest level and the longest match name the message replied to.  What is
left of a message without quotes is put in reply order: by thread, depth and turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import stage

MARK = r"^(?:[ \t]*>)+"
#: A line that only announces the quote below it.
ANNOUNCES = r"wrote:[ \t]*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, "(" + MARK + ")", 1), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, MARK + r"[ \t]?", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n>]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Add ``own`` (the text without quotes), ``n_quoted``, ``max_level`` and ``lines`` as (i, level, body)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    at = messages.withColumn("__lines", lines)
    announces = lambda l, i: l.rlike(ANNOUNCES) & F.coalesce(F.get(F.col("__lines"), i + 1), F.lit("")).rlike(MARK)
    as_line = lambda l, i: F.struct(i.alias("i"), F.when(announces(l, i), F.lit(-1)).otherwise(_level(l)).alias("level"), l.alias("line"))
    at = at.withColumn("lines", F.when(F.col("text").rlike("(?m)" + MARK), F.transform("__lines", as_line)))
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    return at.drop("__lines").withColumns({
        "own": F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.regexp_replace(own, r"^\s+|\s+$", "")),
        "n_quoted": F.coalesce(F.size(quoted), F.lit(0)), "max_level": F.coalesce(F.array_max(F.transform(quoted, lambda x: x["level"])), F.lit(0)),
    }).withColumn("n_quoted", F.greatest(F.lit(0), F.col("n_quoted")))


def quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit, size): normalised passages of one level, and their lines."""
    rows = messages.filter(F.col("lines").isNotNull()).select("conv_id", "turn", F.xxhash64("text").alias("row"), F.explode("lines").alias("x"))
    rows = rows.select("conv_id", "turn", "row", "x.i", "x.level", _normal(_body(F.col("x.line"))).alias("unit")).filter("level > 0").distinct()
    run = F.col("i") - F.row_number().over(Window.partitionBy("conv_id", "turn", "row", "level").orderBy("i"))
    blocks = rows.withColumn("run", run).groupBy("conv_id", "turn", "row", "level", "run").agg(F.array_sort(F.collect_list(F.struct("i", "unit"))).alias("b"))
    blocks = blocks.select("conv_id", "turn", "level", _normal(F.array_join("b.unit", " ")).alias("unit"))
    every = blocks.union(rows.select("conv_id", "turn", "level", "unit")).filter("unit <> ''").distinct()
    return every.select("conv_id", "turn", "level", F.sha2("unit", 256).alias("unit"), F.length("unit").alias("size"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, unit, first): the first turn of a conversation that says a message or a line in its own words."""
    units = F.array_append(F.split("own", "\n", -1), F.col("own"))
    rows = messages.filter("own is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units).alias("unit"))
    rows = rows.withColumn("unit", _normal(F.col("unit"))).filter("unit <> ''")
    return rows.groupBy("conv_id", F.sha2("unit", 256).alias("unit")).agg(F.min("turn").alias("first"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, source_conv_id, source_turn): one row per message whose quote was found.

    parent_turn lies earlier in the same conversation; a quote found in other conversations only has the first of
    these, by conv_id and turn, as its source.
    """
    asked = stage(quotes(messages))
    said = originals(messages)
    here = asked.join(said, ["conv_id", "unit"]).filter(F.col("first") < F.col("turn")).groupBy("conv_id", "turn", "level", "first").agg(F.sum("size").alias("size"))
    here = here.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", -F.col("first"))).alias("best"))
    here = stage(here.select("conv_id", "turn", (-F.col("best.col3")).alias("parent_turn")))
    anywhere = said.groupBy("unit").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("first").alias("t"))).alias("from"))
    away = asked.join(here, ["conv_id", "turn"], "left_anti").join(anywhere, "unit").filter(F.col("from.c") != F.col("conv_id"))
    away = away.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("size"), "from")).alias("best"))
    near = here.select("conv_id", "turn", "parent_turn", F.col("conv_id").alias("source_conv_id"), F.col("parent_turn").alias("source_turn"))
    none = F.lit(None).cast(dict(near.dtypes)["parent_turn"])
    return near.union(away.select("conv_id", "turn", none, "best.from.c", "best.from.t"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent_turn): each round doubles the steps taken."""
    up = stage(replies.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = stage(up.join(above, ["conv_id", "root_turn"], "left"))
        if joined.filter("next is not null").isEmpty():
            return up
        up = stage(joined.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), n_quoted, max_level, parent_turn, source_conv_id,
    source_turn, root_turn, depth.  Ordered by conv_id, root_turn, depth, turn a conversation reads in reply order.

    A message without a quote that is found, or with nothing but unknown quotes, opens a thread of its own.  Null
    text stays null and an all-quote message is left empty; rows with a null conv_id or turn link to nothing; rows
    that repeat (conv_id, turn) share one link and have one result each; other columns are ignored.
    """
    rows = parsed(messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text")))
    found = stage(links(rows))
    order = threads(found.filter("parent_turn is not null"))
    joined = rows.drop("lines", "text").withColumnRenamed("own", "text").join(found, ["conv_id", "turn"], "left").join(order, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "text", F.col("n_quoted").cast("long").alias("n_quoted"), F.col("max_level").cast("long").alias("max_level"), "parent_turn",
        "source_conv_id", "source_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce(F.col("depth"), F.lit(0)).cast("long").alias("depth"),
    )
