"""Cleaning of chat messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.text import EMOJI_SIGN, WS, col, has, trim


def _alt(words) -> str:
    return "(?:" + "|".join(words) + ")"


_DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2})?"
DATE_HEADER = (
    rf"(?i)^#{{1,6}}\s*\[?({_DATE}(?:[,\sT]+{_CLOCK})?)\]?\s*{_alt(lx.WEEKDAYS)}?\s*\z"
)
_MEDIA_WORDS = [w for ws in lx.MEDIA_TOKENS.values() for w in ws] + lx.OTHER_MEDIA_TOKENS
MEDIA_TOKEN = rf"(?i)\[{_alt(_MEDIA_WORDS)}\]"
# A look at the first character spares trying every notice at every place of a long text.
_NOTICE = "(?=[" + "".join(sorted({w[0] if w[0] != "\\" else w[:2] for w in lx.NOTICES})) + "])" + _alt(lx.NOTICES)
NOTICE = "(?i)" + _NOTICE
_STARTS = "^" + _alt(lx.ANNOUNCEMENT_STARTS)
_ANNOUNCE = [
    rf"^{_alt(lx.ANNOUNCEMENT_LABELS)}[:：\s]",
    rf"^{lx.GROUP_SELF}\s*[“\"''『「\[【(（<《]",
    rf"^{lx.GROUP_SELF}(?![的得地有人为])",
    _STARTS,
    rf"(?:^|\n)\s*{_alt(lx.ANNOUNCEMENT_LINE_LABELS)}[:：]",
]
ANNOUNCEMENT = "(?i)" + _alt(_ANNOUNCE)
# A text that is thrown away as a whole.
PURGED = "(?i)" + _alt([lx.GROUP_SELF, _STARTS, *_ANNOUNCE, _NOTICE])
BAD_LINE = "(?i)" + _alt([PURGED[4:], DATE_HEADER[4:], r"^#{1,6}\s+"])
POLLUTED = "(?i)" + _alt(
    [
        PURGED[4:],
        rf"{_alt(lx.POLLUTION_LABELS)}[:：]",
        DATE_HEADER[4:],
        r"(?:^|\n)#{1,6}\s+",
        r"###\s*\[?\d{4}",
        MEDIA_TOKEN[4:],
        rf"^{_alt(lx.POLLUTION_STARTS)}[:：\s]",
    ]
)
SYSTEM_SENDER = "(?i)" + _alt(
    [
        lx.GROUP_SELF,
        "^" + _alt(lx.SYSTEM_SENDER_STARTS),
        "^" + _alt(lx.SYSTEM_SENDER_NAMES) + r"\z",
        *_ANNOUNCE,
        _NOTICE,
    ]
)


def strip_invisible(c) -> Column:
    """Drop zero-width characters, turn CRLF into LF, trim."""
    return trim(F.replace(F.regexp_replace(col(c), ZERO_WIDTH, ""), F.lit("\r\n"), F.lit("\n")))


def is_date_header(c) -> Column:
    return has(trim(c), DATE_HEADER)


def date_from_header(c) -> Column:
    """The date text of a date header line, else null."""
    return F.nullif(trim(F.regexp_extract(trim(c), DATE_HEADER, 1)), F.lit(""))


def strip_md_headers(c) -> Column:
    t = F.regexp_replace(col(c), rf"(?:^|\n)#{{1,6}}\s*\[?{_DATE}[^\n]*", "")
    t = F.regexp_replace(t, r"(?:^|\n)#{1,6}\s+[^\n]+", "")
    return trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_media_text(c) -> Column:
    """The text without media tokens and with squeezed spaces."""
    t = F.regexp_replace(col(c), MEDIA_TOKEN, " ")
    for pattern, with_ in (
        (r"[ \t]{2,}", " "),
        (r"\n[ \t]+", "\n"),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, with_)
    return trim(t)


def media_in(c) -> Column:
    """Type of the media tokens in a text, null without one."""
    kind = F.lit(None).cast("string")
    for name, tokens in reversed(lx.MEDIA_TOKENS.items()):
        kind = F.when(has(c, rf"(?i)\[{_alt(tokens)}\]"), F.lit(name)).otherwise(kind)
    return kind


def is_media_only(c) -> Column:
    rest = trim(F.regexp_replace(col(c), MEDIA_TOKEN, ""))
    return F.coalesce((rest == "") & (trim(c) != ""), F.lit(False))


def strip_media_tokens(c) -> Column:
    """struct(text, media_type, is_media_only)."""
    return F.struct(
        F.coalesce(strip_media_text(c), F.lit("")).alias("text"),
        media_in(c).alias("media_type"),
        is_media_only(c).alias("is_media_only"),
    )


def is_group_announcement(c) -> Column:
    return has(trim(c), ANNOUNCEMENT)


def is_system_notice(c) -> Column:
    return has(c, NOTICE)


def is_purged(c) -> Column:
    """Announcement, notice or group declaration: the whole text goes."""
    return has(trim(c), PURGED)


def is_system_sender(c) -> Column:
    return F.coalesce(trim(c), F.lit("")).eqNullSafe("") | has(trim(c), SYSTEM_SENDER)


def is_polluted(c) -> Column:
    t = trim(F.regexp_replace(col(c), ZERO_WIDTH, ""))
    return F.coalesce(t, F.lit("")).eqNullSafe("") | has(t, POLLUTED)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_message(c) -> Column:
    """Deep-cleaned text, '' when nothing is left."""

    def clean(start: Column) -> Column:
        lines = F.transform(F.split(strip_media_text(strip_md_headers(start)), "\n"), trim)
        kept = F.array_join(F.filter(lines, lambda s: (s != "") & ~has(s, BAD_LINE)), "\n")
        checked = _let(kept, lambda k: F.when(k.isNull() | is_purged(k), F.lit("")).otherwise(k))
        return F.when(is_purged(start), F.lit("")).otherwise(checked)

    return _let(strip_invisible(c), clean)


def sanitize_message(c, media_type=None) -> Column:
    """struct(content, media_type, is_system, is_media_only) of a raw message."""
    given = F.lit(None).cast("string") if media_type is None else col(media_type)
    start = strip_invisible(c)
    body = strip_md_headers(start)
    system = is_purged(start)
    only = is_media_only(body)
    found = media_in(body)
    return F.struct(
        F.when(system | only | col(c).isNull(), F.lit("")).otherwise(clean_message(body)).alias("content"),
        F.when(system, F.lit("system"))
        .when(only, F.coalesce(found, F.lit("image")))
        .otherwise(F.coalesce(given, found, F.lit("text")))
        .alias("media_type"),
        system.alias("is_system"),
        (only & ~system).alias("is_media_only"),
    )


def detect_media_type(c, explicit=None) -> Column:
    """Explicit type, else by token, bare link or emoji-only text, else 'text'."""
    given = F.lit(None).cast("string") if explicit is None else col(explicit)
    t = trim(c)
    kind = (
        F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("text"))
        .when(has(c, r"(?i)\[(?:sticker|表情包|动画表情)\]"), F.lit("sticker"))
        .when(has(c, r"(?i)\[(?:image|图片|photo)\]"), F.lit("image"))
        .when(has(c, r"(?i)\[(?:voice|语音|audio)\]"), F.lit("voice"))
        .when(has(t, r"^https?://\S+\z"), F.lit("link"))
        .when(has(t, rf"^(?:{EMOJI_SIGN}|{WS})+\z"), F.lit("emoji"))
        .otherwise(F.lit("text"))
    )
    return F.coalesce(given, kind)


def clean_sender(c) -> Column:
    """Sender without a leading time stamp; 'Unknown' when blank."""
    name = trim(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("Unknown")))
    bare = F.regexp_replace(name, rf"^\[?{_DATE}(?:[,\sT]+{_CLOCK})?\]?\s*", "")
    bare = trim(F.regexp_replace(trim(bare), rf"^\[?{_CLOCK}\]?\s*", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), name)
