"""Cleaning of generated replies as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.text import col, has, trim

THINK = r"(?is)<think>(?:(?!<think>).)*?</think>"
ARTIFACT = "(?i)(?:" + "|".join(lx.REPLY_ARTIFACTS) + ")"
EDGE_MARKS = " 　\t\r\n，。！？!?~～:：;；、."


def strip_reasoning(c) -> Column:
    """Without closed reasoning blocks, text before a dangling close tag, text after a dangling open tag."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<think>.*?</think>", ""), THINK, "")
    t = F.regexp_replace(t, r"(?is)^.*</think>", "")
    return trim(F.regexp_replace(t, r"(?is)<think>.*\z", ""))


def unwrap_fence(c) -> Column:
    """Content of the first code fence, else the text."""
    inside = trim(F.regexp_extract(col(c), r"(?s)^.*?```(?:json)?(.*?)```", 1))
    return F.coalesce(F.nullif(inside, F.lit("")), trim(c))


def unwrap_json_reply(c) -> Column:
    """First non-empty reply field of a JSON object in the text, else the text."""
    body = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "struct<" + ",".join(f"{f}:string" for f in lx.REPLY_FIELDS) + ">")
    found = F.coalesce(*[F.nullif(parsed[f], F.lit("")) for f in lx.REPLY_FIELDS])
    return trim(F.coalesce(F.when(body != "", found), col(c)))


def is_artifact(c) -> Column:
    return has(trim(c), ARTIFACT)


def drop_artifact_lines(c) -> Column:
    """Without headings, notices, media-only lines, and user lines when there are several lines."""
    lines = F.split(col(c), "\n")
    many = F.size(lines) > 1
    kept = F.filter(
        F.transform(lines, trim),
        lambda s: (s != "") & ~F.startswith(s, F.lit("#")) & ~is_artifact(s) & ~(many & has(s, lx.USER_LINE)),
    )
    return F.array_join(kept, "\n")


def strip_speaker_quotes(c, speaker: str | None = None) -> Column:
    """Strip speaker labels and matching quotes, however deeply they are nested."""
    labels = lx.SPEAKER_LABELS + ([re.escape(speaker)] if speaker else [])
    plain = "|".join(labels + lx.ANSWER_LABELS)
    label = rf"(?i)^(?:(?:(?:{plain})[:：]|[\[【(](?:{'|'.join(labels)})[\]】)][:：]?)\s*)+"

    def once(t: Column) -> Column:
        t = trim(F.regexp_replace(t, label, ""))
        for opening, closing in lx.QUOTE_PAIRS:
            t = F.regexp_replace(t, rf"(?s)^{opening}(.*){closing}\z", "$1")
        return trim(t)

    # Each round that changes a text takes at least one of these marks off it; the rounds end at the first that does not.
    marks = "[:：\\]】)" + "".join(opening for opening, _ in lx.QUOTE_PAIRS) + "]"
    start = trim(c)
    state = F.struct(start.alias("t"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        after = F.transform(F.array(acc["t"]), once)[0]
        return F.when(acc["done"], acc).otherwise(
            F.transform(F.array(after), lambda t: F.struct(t.alias("t"), (t == acc["t"]).alias("done")))[0]
        )

    return F.aggregate(F.sequence(F.lit(0), F.regexp_count(start, F.lit(marks))), state, step)["t"]


def finish_reply(c) -> Column:
    """Strip final periods; the first two clean lines joined by a space."""
    lines = F.transform(F.split(F.regexp_replace(col(c), r"[。.]+\z", ""), "\n"), trim)
    kept = F.filter(lines, lambda s: (s != "") & ~is_artifact(s))
    return F.array_join(F.slice(kept, F.lit(1), F.lit(2)), " ")


def _marker(word: str) -> str:
    return re.escape(word) + ("(?![a-z0-9])" if word.endswith("ai") else "")


def ai_marker(c, markers: list[str] = lx.AI_MARKERS) -> Column:
    """Whether a text calls its writer an AI."""
    return has(F.lower(trim(c)), "|".join(_marker(m) for m in markers))


def drop_ai_sentences(c, markers: list[str] = lx.AI_MARKERS) -> Column:
    """Without the sentences that hold an AI marker; '' when only marks are left."""
    pattern = r"(?i)[^。！？\n]*(?:" + "|".join(_marker(m) for m in markers) + r")[^。！？\n]*[。！？\n]?"
    left = trim(F.regexp_replace(col(c), pattern, ""))
    return F.when(~ai_marker(c, markers), trim(c)).when(F.btrim(left, F.lit(EDGE_MARKS)) == "", F.lit("")).otherwise(left)


def clean_reply(c, speaker: str | None = None) -> Column:
    """The whole chain from raw model output to a sendable line."""
    t = unwrap_json_reply(unwrap_fence(strip_reasoning(c)))
    t = finish_reply(strip_speaker_quotes(drop_artifact_lines(t), speaker))
    t = F.when(is_artifact(t), F.lit("")).otherwise(t)
    return drop_ai_sentences(t)


def parse_json_lenient(c) -> Column:
    """Variant of the JSON in a text: the text itself, its fence, its outer braces, its outer brackets."""
    t = strip_reasoning(c)
    return F.coalesce(
        F.try_parse_json(t),
        F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))),
        F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.lit(""))),
    )
