"""Emoji and sticker expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.text import PICTOGRAPH, col, extract_all, has, trim

_MODIFIED = rf"{PICTOGRAPH}(?:[\x{{FE0E}}\x{{FE0F}}]|[\x{{1F3FB}}-\x{{1F3FF}}])?"
COMPOUND_EMOJI = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|{_MODIFIED}(?:\x{{200D}}{_MODIFIED})*"
STICKER = r"(?i)\[(?:sticker|表情包|动画表情|动画贴图)[^\]]*\]"
CASUAL = "casual_chat"


def extract_emojis(c) -> Column:
    """Compound emojis in order: flags, skin tones and joined sequences stay whole."""

    def real(e: Column) -> Column:
        bare = F.regexp_replace(e, r"[\x{FE0E}\x{FE0F}]", "")
        return ~bare.isin(lx.NON_EMOJI) & ~has(e, r"^[\x{00}-\x{FF}]\z")

    return F.filter(extract_all(c, COMPOUND_EMOJI), real)


def extract_stickers(c) -> Column:
    return extract_all(c, STICKER)


def emoji_count(c) -> Column:
    """Pictographs in a text, joined sequences counted by their parts."""
    return F.regexp_count(col(c), F.lit(PICTOGRAPH))


def context_tags(c, rules: list[tuple[list[str], list[str]]] = lx.EMOJI_TAGS) -> Column:
    """All tags whose words occur in the text; 'casual_chat' without any."""
    none = F.array().cast("array<string>")
    hits = [
        F.when(has(c, lx.any_of(words)), F.array(*[F.lit(t) for t in tags])).otherwise(none) for tags, words in rules
    ]
    tags = F.concat(*hits)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(CASUAL)))


def position(text, asset) -> Column:
    """Where an asset stands in the trimmed text."""
    t = trim(text)
    return (
        F.when(t == col(asset), "standalone")
        .when(F.endswith(t, col(asset)), "suffix")
        .when(F.startswith(t, col(asset)), "prefix")
        .otherwise("inline")
    )
