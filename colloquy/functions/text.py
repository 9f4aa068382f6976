"""Small text helpers.  All of them are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when trimming (Unicode space separators and controls).
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = "一-龥"

# Code points with the Unicode property Extended_Pictographic (fixed values).
PICTOGRAPHS = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}"
    r"\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}"
    r"\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}"
    r"\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}"
    r"\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}"
    r"\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
    r"\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}"
    r"\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}"
    r"\x{1FC00}-\x{1FFFD}"
)
PICTOGRAPH = f"[{PICTOGRAPHS}]"
# Pictograph, skin tone, variation selector or joiner: any sign of an emoji.
EMOJI_SIGN = rf"[{PICTOGRAPHS}\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0F}}\x{{200D}}]"

SENTENCE_END = r"[。！？!?；;\n]+"
TOKEN = rf"[{CJK}]|[\p{{L}}\p{{N}}'&&[^{CJK}]]+|{EMOJI_SIGN}+"
WORD = rf"[{CJK}]|[a-zA-Z0-9']+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    """Trim all Unicode white space (``F.trim`` only knows U+0020)."""
    return F.btrim(col(c), F.lit(SPACES))


def has(c, pattern: str) -> Column:
    """True where the pattern occurs; false for null."""
    return F.coalesce(F.regexp_like(col(c), F.lit(pattern)), F.lit(False))


def extract_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def join_cjk_spaces(c) -> Column:
    """Remove white space between two CJK characters."""
    return trim(F.regexp_replace(col(c), rf"(?<=[{CJK}]){WS}+(?=[{CJK}])", ""))


def tokenize(c) -> Column:
    """Lower-case tokens: one CJK character, a word of any other script, or an emoji run."""
    return extract_all(F.lower(join_cjk_spaces(c)), TOKEN)


def words(c) -> Column:
    """Tokens for reply scoring: one CJK character or an ASCII word."""
    return extract_all(F.lower(col(c)), WORD)


def sentences(c) -> Column:
    """Trimmed non-empty sentences."""
    parts = F.transform(F.split(col(c), SENTENCE_END), trim)
    return F.filter(parts, lambda s: s != "")


def char_ngrams(c, n: int) -> Column:
    """All character n-grams in order; linear in the text, unlike ``substring`` per position."""
    return extract_all(c, f"(?s)(?=({'.' * n})).", 1)


def count_of(c, mark: str) -> Column:
    """How often a single character occurs."""
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(mark), F.lit("")))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))
