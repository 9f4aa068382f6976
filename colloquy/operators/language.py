"""Language fingerprint: distributions, rates and top lists per group of ``keys``.

All shares of one group come from a single aggregation over the messages; n-gram tables explode
the tokens once.  Groups may be of any size: counts combine before the shuffle, distributions are
taken over value counts, and top lists are cut per partition before they meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import rate, round_half
from colloquy import lexicons as lx
from colloquy.functions import clean
from colloquy.functions.text import CJK, WS, extract_all, has, join_cjk_spaces, sentences, tokenize, trim
from colloquy.plans import lineage
from colloquy.plans.ordered import top_k

CJK_CHAR = f"[{CJK}]"
#: Makes the tokens of a text column.
Segment = Callable[[str], Column]
REPEATED_CHAR = r"(.)\1{2,}"
REPETITION = rf"([{CJK}a-zA-Z])\1{{2,}}|([{CJK}]{{2}})\2+"


def base_texts(messages: DataFrame, content: str = "content", target_only: bool = True) -> DataFrame:
    """Target messages with usable text, as column ``text``."""
    rows = messages.filter("is_target") if target_only else messages
    return rows.withColumn("text", join_cjk_spaces(F.coalesce(content, F.lit("")))).filter(
        (F.col("text") != "") & ~clean.is_polluted("text")
    )


def _of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    total, v, n = F.sum("n"), F.col("v").cast("double"), F.col("n")
    mean = F.sum(v * n) / total
    # Central second moment from sums; the values are text lengths, so the sums stay exact.
    spread = F.sqrt(F.greatest(F.sum(v * v * n) / total - mean * mean, F.lit(0.0)))
    return counts.groupBy(*keys).agg(
        total.alias("sample_size"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        round_half(mean, 2).alias("mean"),
        round_half(F.percentile(v, F.lit(0.5), n), 2).alias("median"),
        round_half(F.percentile(v, F.lit(0.9), n), 2).alias("p90"),
        round_half(spread, 2).alias("std_dev"),
    )


def distribution(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """min, max, mean, median, p90 and population deviation of an integer column.

    Percentiles interpolate.  The aggregate works on value counts, so a group of any size costs
    only its distinct values.
    """
    counts = values.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return _of_counts(counts, keys)


def length_distribution(texts: DataFrame, keys: list[str]) -> DataFrame:
    return distribution(texts.select(*keys, F.length("text").alias("value")), keys)


def sentence_rows(texts: DataFrame, *carry: str) -> DataFrame:
    return texts.select(*carry, F.explode(sentences("text")).alias("sentence"))


def sentence_distribution(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Sentence lengths; groups without any sentence fall back to whole messages."""
    parts = sentences("text")
    rows = texts.select(
        *keys,
        F.when(F.size(parts) > 0, F.transform(parts, lambda s: F.struct(F.length(s).alias("v"), F.lit(1).alias("real"))))
        .otherwise(F.array(F.struct(F.length("text").alias("v"), F.lit(0).alias("real"))))
        .alias("parts"),
    )
    flat = rows.select(*keys, F.explode("parts").alias("p")).select(*keys, "p.v", "p.real")
    counts = flat.groupBy(*keys, "real", "v").agg(F.count(F.lit(1)).alias("n"))
    real = counts.groupBy(*keys).agg(F.max("real").alias("any_real"))
    kept = counts.join(real, keys).filter(F.col("real") == F.col("any_real"))
    return _of_counts(kept, keys)


PUNCTUATION_RATES = {
    "ellipsis_rate": r"\.{2,}|…",
    "question_rate": r"[?？]",
    "exclamation_rate": r"[!！]",
    "tilde_rate": r"[~～]",
    "comma_rate": r"[,，]",
    "period_rate": r"[。.]",
    "line_break_rate": r"\n",
    "repeated_char_rate": REPEATED_CHAR,
}
TERMINAL = r"[。！？!?.~～…]\z"


def _flags(particles: list[str]) -> dict[str, Column]:
    t = F.col("text")
    multi = has(t, r"\n")
    flags = {name: has(t, p) for name, p in PUNCTUATION_RATES.items()}
    flags["terminal_punctuation_drop_rate"] = ~has(t, TERMINAL)
    flags["capitalization_rate"] = has(t, "[A-Z]")
    flags["bilingual_mix_rate"] = has(t, CJK_CHAR) & has(t, "[a-zA-Z]")
    flags["number_rate"] = has(t, r"[0-9]")
    flags["overall_particle_rate"] = has(t, "|".join(particles)) if particles else F.lit(False)
    flags["single_line_rate"] = ~multi
    flags["multi_line_rate"] = multi
    flags["bullet_like_rate"] = multi & has(t, r"(?m)^[•\-*0-9.]")
    return flags


def style_rates(texts: DataFrame, keys: list[str], particles: list[str] = lx.PARTICLES) -> DataFrame:
    """All punctuation, habit, particle and structure shares in one pass."""
    return texts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"), *[rate(flag).alias(name) for name, flag in _flags(particles).items()]
    )


def punctuation_rates(texts: DataFrame, keys: list[str]) -> DataFrame:
    return style_rates(texts, keys).select(
        *keys, "sample_size", *PUNCTUATION_RATES, "terminal_punctuation_drop_rate"
    )


def habit_rates(texts: DataFrame, keys: list[str]) -> DataFrame:
    return style_rates(texts, keys).select(*keys, "capitalization_rate", "bilingual_mix_rate", "number_rate")


def structure_rates(texts: DataFrame, keys: list[str]) -> DataFrame:
    return style_rates(texts, keys).select(*keys, "single_line_rate", "multi_line_rate", "bullet_like_rate")


def particle_counts(texts: DataFrame, keys: list[str], particles: list[str] = lx.PARTICLES) -> DataFrame:
    """Messages that contain each particle; zero where a group never uses it."""
    wide = texts.groupBy(*keys).agg(
        *[F.count_if(F.contains("text", F.lit(p))).alias(f"p{i}") for i, p in enumerate(particles)]
    )
    pairs = F.array(
        *[F.struct(F.lit(p).alias("particle"), F.col(f"p{i}").alias("messages")) for i, p in enumerate(particles)]
    )
    return wide.select(*keys, F.inline(pairs))


def counted(rows: DataFrame, keys: list[str], item: str = "token") -> DataFrame:
    return rows.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("count"))


def top_items(counts: DataFrame, keys: list[str], k: int, item: str = "token") -> DataFrame:
    """The k most frequent items per group, ties by item."""
    return top_k(counts, keys, [F.col("count").desc(), F.col(item)], k)


def repetition_patterns(texts: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    rows = texts.select(*keys, F.explode(extract_all("text", REPETITION)).alias("token"))
    return top_items(counted(rows, keys), keys, k)


def ngram_rows(texts: DataFrame, keys: list[str], sizes: tuple[int, ...] = (1, 2, 3), segment: Segment = tokenize) -> DataFrame:
    """(keys, n, token): every n-gram occurrence; CJK neighbours join without a space.

    ``segment`` makes the tokens of a text column: the regular expression, or ``functions.segment.segmenter``.
    """
    tokens = texts.select(*keys, segment("text").alias("t"))

    def cjk(c: Column) -> Column:
        return has(c, CJK_CHAR)

    def at(i: Column, k: int) -> Column:
        return F.get(F.col("t"), i + k)

    def gap(i: Column, k: int) -> Column:
        return F.when(cjk(at(i, k)) & cjk(at(i, k + 1)), F.lit("")).otherwise(F.lit(" "))

    def grams(n: int) -> Column:
        def one(i: Column) -> Column:
            parts = [at(i, 0)]
            for k in range(n - 1):
                parts += [gap(i, k), at(i, k + 1)]
            return F.struct(F.lit(n).alias("n"), F.concat(*parts).alias("token"))

        starts = F.sequence(F.lit(0), F.size("t") - n)
        return F.when(F.size("t") >= n, F.transform(starts, one)).otherwise(
            F.array().cast("array<struct<n:int,token:string>>")
        )

    return tokens.select(*keys, F.explode(F.concat(*[grams(n) for n in sizes])).alias("g")).select(
        *keys, "g.n", "g.token"
    )


def unigrams(texts: DataFrame, keys: list[str], segment: Segment = tokenize) -> DataFrame:
    return counted(texts.select(*keys, F.explode(segment("text")).alias("token")), keys)


def unique_words(texts: DataFrame, keys: list[str], segment: Segment = tokenize) -> DataFrame:
    return unigrams(texts, keys, segment).groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_words"))


def ngrams(texts: DataFrame, keys: list[str], n: int, segment: Segment = tokenize) -> DataFrame:
    return counted(ngram_rows(texts, keys, (n,), segment).drop("n"), keys)


def is_vocab(c: Column | str) -> Column:
    """False for blanks, spaced CJK, media words and system words."""
    t = trim(c)
    media = "|".join(lx.MEDIA_WORDS)
    system = "|".join(lx.SYSTEM_WORDS)
    bad = rf"(?i)^(?:{media})\z|\[(?:{media})\]|^(?:{system})\z|{lx.GROUP_SELF}|{CJK_CHAR}{WS}+{CJK_CHAR}"
    return (F.coalesce(t, F.lit("")) != "") & ~has(t, bad)


def top_ngrams(
    texts: DataFrame, keys: list[str], n: int, k: int, stopwords: list[str] | None = None, segment: Segment = tokenize
) -> DataFrame:
    counts = ngrams(texts, keys, n, segment).filter(is_vocab("token"))
    if stopwords:
        counts = counts.filter(~F.col("token").isin(stopwords))
    return top_items(counts, keys, k)


def top_vocabulary(texts: DataFrame, keys: list[str], stopwords: list[str] = lx.STOPWORDS, segment: Segment = tokenize) -> DataFrame:
    return top_ngrams(texts, keys, 1, 50, stopwords, segment)


def top_bigrams(texts: DataFrame, keys: list[str], segment: Segment = tokenize) -> DataFrame:
    return top_ngrams(texts, keys, 2, 30, segment=segment)


def top_trigrams(texts: DataFrame, keys: list[str], segment: Segment = tokenize) -> DataFrame:
    return top_ngrams(texts, keys, 3, 20, segment=segment)


def _phrase_ok(c: str, stopwords: list[str]) -> Column:
    return is_vocab(c) & ~clean.is_polluted(c) & (~F.col(c).isin(stopwords) if stopwords else F.lit(True))


def pattern_phrases(
    texts: DataFrame,
    keys: list[str],
    patterns: dict[str, str] = lx.PHRASES,
    k: int = 10,
    stopwords: list[str] = lx.STOPWORDS,
) -> DataFrame:
    """Most frequent first matches of each pattern."""
    found = F.array(*[F.regexp_extract("text", f"(?i)({p})", 1) for p in patterns.values()])
    rows = texts.select(*keys, F.explode(F.filter(found, lambda s: s != "")).alias("raw"))
    rows = rows.select(*keys, join_cjk_spaces("raw").alias("token")).filter(_phrase_ok("token", stopwords))
    return top_items(counted(rows, keys), keys, k)


def repeated_sentences(
    texts: DataFrame, keys: list[str], k: int = 5, stopwords: list[str] = lx.STOPWORDS
) -> DataFrame:
    """Short sentences said at least twice."""
    rows = sentence_rows(texts, *keys).select(*keys, join_cjk_spaces("sentence").alias("token"))
    rows = rows.filter(F.length("token").between(2, 12))
    counts = counted(rows, keys).filter((F.col("count") >= 2) & _phrase_ok("token", stopwords))
    return top_items(counts, keys, k)


def catchphrases(
    texts: DataFrame,
    keys: list[str],
    patterns: dict[str, str] = lx.PHRASES,
    stopwords: list[str] = lx.STOPWORDS,
) -> DataFrame:
    """Pattern phrases, repeated sentences and frequent bigrams; each phrase once, in that order."""
    bigram = ngrams(texts, keys, 2).filter(
        (F.col("count") >= 2) & F.length("token").between(2, 15) & _phrase_ok("token", stopwords)
    )
    parts = [
        pattern_phrases(texts, keys, patterns, stopwords=stopwords),
        repeated_sentences(texts, keys, stopwords=stopwords),
        top_items(bigram, keys, 5),
    ]
    rows = [
        p.select(*keys, "token", F.struct(F.lit(i).alias("source"), F.col("rank")).alias("place"))
        for i, p in enumerate(parts)
    ]
    merged = rows[0].unionByName(rows[1]).unionByName(rows[2])
    once = merged.groupBy(*keys, "token").agg(F.min("place").alias("place"))
    return once.filter(F.length("token").between(2, 15) & _phrase_ok("token", stopwords)).select(
        *keys, F.col("token").alias("phrase"), F.col("place.source").alias("source"), F.col("place.rank").alias("rank")
    )


def _candidate(content: str) -> tuple[Column, Column]:
    text = clean.clean_message(content)
    return text, F.length(text).between(1, 25) & ~clean.is_polluted(text) & ~F.startswith(text, F.lit("#"))


def openers(
    messages: DataFrame,
    keys: list[str],
    session: list[str],
    seq: str = "seq",
    content: str = "content",
    words: list[str] = lx.OPENINGS,
    k: int = 8,
) -> DataFrame:
    """Opening lines: the first usable target message of each session, where it is an opening."""
    text, usable = _candidate(content)
    rows = messages.filter("is_target").select(*dict.fromkeys([*keys, *session]), seq, text.alias("token"), usable.alias("ok"))
    first = rows.filter("ok").groupBy(*dict.fromkeys([*keys, *session])).agg(F.min_by("token", seq).alias("token"))
    # A session has one opener whoever of the targets says it, so the rest of the keys follow the session.
    hits = first.filter((F.length("token") <= 20) & has("token", "(?iu)^(?:" + "|".join(words) + ")"))
    return top_items(counted(hits, keys), keys, k)


def closers(
    messages: DataFrame,
    keys: list[str],
    session: list[str],
    seq: str = "seq",
    content: str = "content",
    words: list[str] = lx.CLOSINGS,
    k: int = 8,
) -> DataFrame:
    """Closing lines: the last message of each session, where it is a usable target closing."""
    extra = [c for c in keys if c not in session]
    last = messages.groupBy(*session).agg(
        F.max_by(F.struct(*extra, F.col(content).alias("content"), "is_target"), seq).alias("m")
    )
    text, usable = _candidate("content")
    rows = last.select(*session, "m.*").filter("is_target")
    rows = rows.select(*keys, text.alias("token"), usable.alias("ok")).filter("ok")
    hits = rows.filter((F.length("token") <= 20) & has("token", "(?iu)(?:" + "|".join(words) + ")"))
    return top_items(counted(hits, keys), keys, k)


def fingerprint(
    messages: DataFrame,
    keys: list[str],
    session: list[str] | None = None,
    content: str = "content",
    particles: list[str] = lx.PARTICLES,
    phrases: dict[str, str] = lx.PHRASES,
    stopwords: list[str] = lx.STOPWORDS,
    phrase_stopwords: list[str] = lx.STOPWORDS,
    openings: list[str] = lx.OPENINGS,
    closings: list[str] = lx.CLOSINGS,
) -> DataFrame:
    """One row per group with lengths, rates and top lists as structs; groups without text get zeros.

    The texts are cleaned once and written to the checkpoint folder; what is counted reads them from there.
    """
    texts = lineage.cut(base_texts(messages, content).select(*keys, "text"))
    groups = messages.select(*keys).distinct()

    def top(df: DataFrame, name: str, item: str = "token") -> DataFrame:
        entry = F.struct("rank", F.col(item).alias("token"), "count")
        ordered = F.array_sort(F.collect_list(entry))  # at most k entries
        return df.groupBy(*keys).agg(
            F.transform(ordered, lambda e: F.struct(e["token"].alias("token"), e["count"].alias("count"))).alias(name)
        )

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    parts = [
        packed(length_distribution(texts, keys), "message_length"),
        packed(sentence_distribution(texts, keys), "sentence_length"),
        style_rates(texts, keys, particles),
        unique_words(texts, keys),
        top(repetition_patterns(texts, keys), "repetitions"),
        top(top_vocabulary(texts, keys, stopwords), "top_vocabulary"),
        top(top_bigrams(texts, keys), "top_bigrams"),
        top(top_trigrams(texts, keys), "top_trigrams"),
        catchphrases(texts, keys, phrases, phrase_stopwords).groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("source", "rank", "phrase"))), lambda e: e["phrase"]).alias(
                "catchphrases"
            )
        ),
    ]
    if session:
        parts += [
            top(openers(messages, keys, session, content=content, words=openings), "openers"),
            top(closers(messages, keys, session, content=content, words=closings), "closers"),
        ]
    out = groups
    for part in parts:
        out = out.join(part, keys, "left")
    zeros = {c: 0.0 for c, kind in out.dtypes if kind == "double"} | {"sample_size": 0, "unique_words": 0}
    return out.fillna(zeros)


def metric_rows(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of ``fingerprint`` rows: ``message_length.p90``, ``top_bigrams.1.<token>`` and so on.

    The value of a list entry is its count, that of a catchphrase its place.
    """

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("metric"), value.cast("double").alias("value"))

    def rows(c: str, kind: str) -> Column:
        if kind == "array<string>":
            return F.transform(c, lambda p, i: entry(F.concat_ws(".", F.lit(c), i + 1, p), i + 1))
        if kind.startswith("array"):
            return F.transform(c, lambda e, i: entry(F.concat_ws(".", F.lit(c), i + 1, e["token"]), e["count"]))
        if kind.startswith("struct"):
            return F.array(*[entry(F.lit(f"{c}.{f.name}"), F.col(f"{c}.{f.name}")) for f in fingerprints.schema[c].dataType])
        return F.array(entry(F.lit(c), F.col(c)))

    parts = [rows(c, kind) for c, kind in fingerprints.dtypes if c not in keys]
    filled = [F.coalesce(p, F.array().cast("array<struct<metric:string,value:double>>")) for p in parts]
    return fingerprints.select(*keys, F.inline(F.concat(*filled))).filter("value is not null")
