"""What a speaker's own turns say of how they write, and scores of replies against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.operators import language, scoring, style
from colloquy.plans import lineage

RATES = ["ellipsis_rate", "question_rate", "exclamation_rate", "tilde_rate", "terminal_punctuation_drop_rate", "repeated_char_rate"]


def speaker_profiles(
    train: DataFrame, speaker: str = "speaker", session: list[str] | None = None, phrases: dict[str, str] = lx.PHRASES,
    stopwords: list[str] = lx.STOPWORDS, openings: list[str] = lx.OPENINGS, closings: list[str] = lx.CLOSINGS,
    markers: dict[str, list[str]] = lx.MARKERS, phrase_stopwords: list[str] = lx.STOPWORDS,
) -> DataFrame:
    """One row per speaker of the train turns (``turns.build_turns``): the columns that ``score_samples`` looks for.

    Style rates and the median length; up to 50 words and some 30 phrases (catchphrases, openers, closers); per situation
    the shares of emojis, short replies and questions back.  All but the rates are top lists, so a row stays small
    however much a speaker has written.  The turns are read once; what is made from them reads a copy of their texts.
    """
    keys = [speaker]
    session = session or ["chat_id", "session_no"]
    carried = dict.fromkeys([speaker, *session, "seq"])
    said = train.select(*carried, F.col("target_message").alias("content"), F.lit(True).alias("is_target"), style.context_text("context").alias("around"))
    said = lineage.cut(said)
    texts = language.base_texts(said)
    rates = language.style_rates(texts, keys).select(*keys, *RATES)
    lengths = language.length_distribution(texts, keys).select(*keys, F.col("median").alias("median_length"))
    words = language.top_vocabulary(texts, keys, stopwords).groupBy(*keys).agg(F.collect_list("token").alias("top_vocabulary"))
    known = [
        language.catchphrases(texts, keys, phrases, phrase_stopwords).select(*keys, "phrase"),
        language.openers(said, keys, session, words=openings).select(*keys, F.col("token").alias("phrase")),
        language.closers(said, keys, session, words=closings).select(*keys, F.col("token").alias("phrase")),
    ]
    known = known[0].union(known[1]).union(known[2]).groupBy(*keys).agg(F.collect_list("phrase").alias("phrases"))
    context = F.array(F.struct(F.col("around").alias("content")))
    featured = style.features(said.withColumn("context", context), "content", markers)
    stats = style.situation_stats(featured, keys)
    policy = F.struct("situation_order", "situation", "emoji_probability", "short_reply_probability", "follow_up_probability")
    policies = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(policy)).alias("policies"))
    out = said.select(*keys).distinct()
    for part in (rates, lengths, words, known, policies):
        out = out.join(part, keys, "left")
    return out


def score_samples(
    samples: DataFrame, profiles: DataFrame, speaker: str = "speaker", situations: dict[str, list[str]] = lx.SITUATIONS,
    behavior: dict[str, list[str]] = lx.BEHAVIOR, leak: list[str] = lx.IDENTITY_LEAK,
) -> DataFrame:
    """Samples with ``lexical``, ``style`` and ``behavior``, each against the profile of the sample's own speaker.

    A speaker without a profile is scored as ``scoring`` does without one.
    """
    rows = samples.join(profiles, speaker, "left")
    return scoring.behavior_score(scoring.style_score(scoring.lexical_score(rows)), situations, behavior, leak)
