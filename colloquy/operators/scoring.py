"""Scores of candidate replies against true replies.

``samples``: (sample_id, speaker, context array<struct<sender, content>>, target, candidate).
``profile``: one row per speaker, all columns optional but the key: top_vocabulary and phrases
(short arrays of strings), the style rates, median_length, emoji_density, policies (array of
struct<situation, emoji_probability, short_reply_probability, follow_up_probability>).
Scores are column expressions over one joined row; only the n-gram cosine and the grounding need
more than that.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy import lexicons as lx
from colloquy.functions.emoji import emoji_count
from colloquy.functions.numbers import ratio, round_half
from colloquy.functions.text import PICTOGRAPH, char_ngrams, clamp, col, count_of, has, trim, words
from colloquy.operators.style import context_text

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NGRAM_WEIGHTS = {1: 0.35, 2: 0.35, 3: 0.30}
STYLE_RATES = {
    "ellipsis_rate": "ellipsis",
    "question_rate": "question",
    "exclamation_rate": "exclamation",
    "tilde_rate": "tilde",
    "terminal_punctuation_drop_rate": "clean_terminal",
    "repeated_char_rate": "repetition",
}


def _cosine(counts: list[tuple[Counter, Counter]]) -> float:
    """Weighted sum of the cosines; zero where a side has no n-grams."""
    score = 0.0
    for (x, y), weight in zip(counts, NGRAM_WEIGHTS.values()):
        dot = sum(v * y[g] for g, v in x.items() if g in y)
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        score += (dot / norm if norm else 0.0) * weight
    return score


def char_ngram_cosine(samples: DataFrame, id: str = "sample_id") -> DataFrame:
    """(id, ngram_score): weighted cosine of lower-case character 1-, 2- and 3-gram counts.

    The compact rows are shuffled once and sorted by id; a task then counts one id after the other, so the
    n-grams are never rows and what it holds are the different ones of one id.  The texts are looked at after the
    shuffle, so that rows which a caller has dealt out by id are not dealt out again.
    """
    rows = samples.select(id, "target", "candidate").repartition(id).sortWithinPartitions(id)
    rows = rows.select(id, F.lower("target").alias("target"), F.lower("candidate").alias("candidate"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, counts, last = None, None, None

        def out(ids: list, scores: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(scores, pa.float64())], [id, "ngram_score"])

        for batch in batches:
            kind, ids, scores = batch.schema.field(0).type, [], []
            for key, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                if None in texts or not any(texts):
                    continue
                if counts is None or key != last:
                    if counts is not None:
                        ids.append(last)
                        scores.append(_cosine(counts))
                    last, counts = key, [(Counter(), Counter()) for _ in NGRAM_WEIGHTS]
                for n, sides in zip(NGRAM_WEIGHTS, counts):
                    for text, side in zip(texts, sides):
                        side.update(text[i : i + n] for i in range(len(text) - n + 1))
            yield out(ids, scores)
        if counts is not None:
            yield out([last], [_cosine(counts)])

    return rows.mapInArrow(score, T.StructType([samples.schema[id], T.StructField("ngram_score", T.DoubleType())]))


def vocab_fidelity(candidate, vocabulary, phrases) -> Column:
    """Share of candidate tokens in the speaker's vocabulary, plus a bonus per known phrase."""
    tokens = words(candidate)
    known = F.size(F.filter(tokens, lambda t: F.array_contains(col(vocabulary), t)))
    usable = (F.size(tokens) > 0) & (F.coalesce(F.size(col(vocabulary)), F.lit(0)) > 0)
    share = F.when(usable, known / F.size(tokens)).otherwise(F.lit(0.75))
    hits = F.size(F.filter(F.coalesce(col(phrases), F.array().cast("array<string>")), lambda p: F.contains(col(candidate), p)))
    return F.when(hits > 0, F.least(F.lit(1.0), share + hits * 0.10)).otherwise(share)


def punct_similarity(a, b) -> Column:
    la, lb = F.greatest(F.length(col(a)), F.lit(1)), F.greatest(F.length(col(b)), F.lit(1))
    gaps = [F.abs(count_of(a, m) / la - count_of(b, m) / lb) for m in lx.PUNCTUATION]
    return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(Column.__add__, gaps) * 4.0)


def length_ratio(a, b) -> Column:
    return ratio(F.length(col(a)), F.length(col(b)))


def sentence_length_ratio(a, b) -> Column:
    def mean(c) -> Column:
        parts = F.filter(F.split(col(c), r"[。！？!?\n]+"), lambda s: s != "")
        return F.length(col(c)) / F.greatest(F.size(parts), F.lit(1))

    return F.least(mean(a), mean(b)) / F.greatest(mean(a), mean(b))


def _outcome(score: Column, low: float) -> Column:
    """Empty texts score the floor, equal ones 1, others the bounded score."""
    empty = (F.coalesce("target", F.lit("")) == "") | (F.coalesce("candidate", F.lit("")) == "")
    return F.when(empty, F.lit(0.05)).when(F.col("target") == F.col("candidate"), F.lit(1.0)).otherwise(
        clamp(round_half(score, 3), low, 1.0)
    )


def lexical_score(samples: DataFrame, id: str = "sample_id") -> DataFrame:
    """Adds ``lexical`` and its parts; ``samples`` may carry top_vocabulary and phrases."""
    empty = F.lit(None).cast("array<string>")
    # Both sides of the join read one exchange, if nobody asks for more columns than the cosine.
    rows = samples.repartition(id)
    # Grouped, the scores are known to have one row an id: who does not ask for them does not run them.
    cosine = char_ngram_cosine(rows, id).groupBy(id).agg(F.max("ngram_score").alias("ngram_score"))
    rows = rows.join(cosine, id, "left").fillna(0.0, ["ngram_score"])
    rows = rows.withColumns(
        {
            "vocab_fidelity": vocab_fidelity(
                "candidate",
                F.col("top_vocabulary") if "top_vocabulary" in samples.columns else empty,
                F.col("phrases") if "phrases" in samples.columns else empty,
            ),
            "punct_similarity": punct_similarity("target", "candidate"),
            "length_ratio": length_ratio("target", "candidate"),
            "sentence_length_ratio": sentence_length_ratio("target", "candidate"),
        }
    )
    score = (
        F.col("ngram_score") * 0.30
        + F.col("vocab_fidelity") * 0.20
        + F.col("punct_similarity") * 0.20
        + F.col("length_ratio") * 0.15
        + F.col("sentence_length_ratio") * 0.15
    )
    return rows.withColumn("lexical", _outcome(score, 0.05))


def style_features(c) -> Column:
    t = col(c)
    size = F.length(t)
    return F.struct(
        emoji_count(t).alias("emojis"),
        has(t, r"\.{2,}|…").alias("ellipsis"),
        has(t, "[?？]").alias("question"),
        has(t, "[!！]").alias("exclamation"),
        has(t, "[~～]").alias("tilde"),
        (~has(trim(t), r"[。！？!?.~～…]\z")).alias("clean_terminal"),
        F.when(size <= 8, 0).when(size <= 22, 1).when(size <= 55, 2).otherwise(3).alias("bucket"),
        has(t, r"(?i)([一-龥a-z])\1{2,}").alias("repetition"),
    )


def local_style_match(a: str, b: str) -> Column:
    """Weighted agreement of two feature structs."""

    def same(name: str, otherwise: float) -> Column:
        return F.when(F.col(f"{a}.{name}") == F.col(f"{b}.{name}"), 1.0).otherwise(otherwise)

    delta = F.abs(F.col(f"{a}.emojis") - F.col(f"{b}.emojis"))
    emoji = F.when(delta == 0, 1.0).when(delta == 1, 0.80).otherwise(F.greatest(F.lit(0.20), 1.0 - delta * 0.25))
    step = F.abs(F.col(f"{a}.bucket") - F.col(f"{b}.bucket"))
    bucket = F.when(step == 0, 1.0).when(step == 1, 0.70).otherwise(0.35)
    return (
        emoji * 0.18
        + same("ellipsis", 0.40) * 0.13
        + same("question", 0.50) * 0.13
        + same("exclamation", 0.60) * 0.10
        + same("tilde", 0.65) * 0.10
        + same("clean_terminal", 0.65) * 0.14
        + bucket * 0.12
        + same("repetition", 0.55) * 0.10
    )


def distribution_similarity(feature: str, candidate: str, columns: list[str]) -> Column | None:
    """Closeness of a candidate to the speaker's rates, over the rates the row carries."""
    gaps = [
        F.abs(F.col(f"{feature}.{flag}").cast("double") - F.col(name))
        for name, flag in STYLE_RATES.items()
        if name in columns
    ]
    size = F.length(candidate)
    if "emoji_density" in columns:
        density = F.col(f"{feature}.emojis") / F.greatest(size, F.lit(1))
        gaps.append(F.least(F.lit(1.0), F.abs(density - F.col("emoji_density")) * 2.0))
    if "median_length" in columns:
        median = F.col("median_length")
        gaps.append(
            F.when(median > 0, F.least(F.lit(1.0), F.abs(size - median) / F.greatest(size.cast("double"), median)))
        )
    if not gaps:
        return None
    known = reduce(Column.__add__, [g.isNotNull().cast("int") for g in gaps])
    total = reduce(Column.__add__, [F.coalesce(g, F.lit(0.0)) for g in gaps])
    return F.when(known > 0, F.greatest(F.lit(0.15), 1.0 - total / known * 0.85))


def style_score(samples: DataFrame) -> DataFrame:
    """Adds ``style`` and its parts; ``samples`` may carry the speaker's rates."""
    rows = samples.withColumns({"__t": style_features("target"), "__c": style_features("candidate")})
    rows = rows.withColumn("local_style_match", local_style_match("__t", "__c"))
    near = distribution_similarity("__c", "candidate", samples.columns)
    near = F.col("local_style_match") if near is None else F.coalesce(near, F.col("local_style_match"))
    rows = rows.withColumn("distribution_similarity", near)
    rows = rows.withColumn(
        "style", _outcome(F.col("distribution_similarity") * 0.60 + F.col("local_style_match") * 0.40, 0.05)
    )
    return rows.withColumns({"target_emojis": F.col("__t.emojis"), "candidate_emojis": F.col("__c.emojis")}).drop("__t", "__c")


def situation_flags(context, situations: dict[str, list[str]] = lx.SITUATIONS) -> Column:
    return F.struct(*[has(context, lx.any_of(w)).alias(name) for name, w in situations.items()])


def behavior_features(c, lexicon: dict[str, list[str]] = lx.BEHAVIOR) -> Column:
    return F.struct(
        *[has(c, lx.any_of(w)).alias(name) for name, w in lexicon.items()],
        has(c, "[?？]").alias("asks_back"),
        (F.length(col(c)) <= 15).alias("brief"),
    )


def identity_leak(c, markers: list[str] = lx.IDENTITY_LEAK) -> Column:
    return has(c, lx.any_of(markers))


def behavior_score(
    samples: DataFrame,
    situations: dict[str, list[str]] = lx.SITUATIONS,
    lexicon: dict[str, list[str]] = lx.BEHAVIOR,
    leak: list[str] = lx.IDENTITY_LEAK,
) -> DataFrame:
    """Adds ``behavior``, its parts and the flags it is made of."""
    rows = samples.withColumn("__context", context_text("context"))
    rows = rows.withColumns(
        {
            "__s": situation_flags("__context", situations),
            "__t": behavior_features("target", lexicon),
            "__c": behavior_features("candidate", lexicon),
            "identity_leak": identity_leak("candidate", leak),
        }
    )
    s = {n: F.col(f"__s.{n}") for n in situations}

    def same(name: str, otherwise: float) -> Column:
        return F.when(F.col(f"__t.{name}") == F.col(f"__c.{name}"), 1.0).otherwise(otherwise)

    weight = F.when(s["teasing"], 1.5).otherwise(0.0) + F.when(s["emotional"], 1.5).otherwise(0.0) + 2.8
    total = (
        F.when(s["teasing"], same("playful", 0.35) * 1.5).otherwise(0.0)
        + F.when(s["emotional"], same("gentle", 0.30) * 1.5).otherwise(0.0)
        + same("asks_back", 0.65)
        + same("formal", 0.45)
        + same("brief", 0.60) * 0.8
    )
    rows = rows.withColumn("pairwise_match", total / weight)

    emoji = has("candidate", PICTOGRAPH).cast("double")
    brief, asks = F.col("__c.brief").cast("double"), F.col("__c.asks_back").cast("double")
    model = F.lit(None).cast("double")
    if "policies" in samples.columns:
        fits = F.filter(
            "policies",
            lambda p: (s["teasing"] & (p["situation"] == "joking"))
            | (s["emotional"] & p["situation"].isin("venting", "emotional"))
            | (s["inquiry"] & p["situation"].isin("inquiry", "question")),
        )
        best = F.get(fits, F.lit(0))
        gaps = [
            1.0 - F.abs(actual - best[name])
            for actual, name in (
                (emoji, "emoji_probability"),
                (brief, "short_reply_probability"),
                (asks, "follow_up_probability"),
            )
        ]
        known = reduce(Column.__add__, [g.isNotNull().cast("int") for g in gaps])
        model = reduce(Column.__add__, [F.coalesce(g, F.lit(0.0)) for g in gaps]) / F.nullif(known, F.lit(0))
    if "p_emoji_given_joking" in samples.columns and "policies" not in samples.columns:
        model = F.when(s["teasing"], 1.0 - F.abs(emoji - F.col("p_emoji_given_joking")))
    rows = rows.withColumn("policy_match", F.coalesce(model, F.col("pairwise_match")))
    alignment = (
        F.when(s["emotional"], F.when(F.col("__c.gentle"), 1.0).otherwise(0.40))
        .when(s["teasing"], F.when(F.col("__c.playful"), 1.0).otherwise(0.50))
        .when(s["formal"], F.when(F.col("__c.formal"), 1.0).otherwise(0.50))
        .when(s["inquiry"], F.when(F.col("__c.asks_back") | (F.length("candidate") >= 6), 0.90).otherwise(0.60))
        .otherwise(0.80)
    )
    rows = rows.withColumn("context_alignment", alignment)
    score = F.col("pairwise_match") * 0.40 + F.col("policy_match") * 0.40 + F.col("context_alignment") * 0.20
    plain = _outcome(score, 0.10)
    differs = F.col("target") != F.col("candidate")
    return rows.withColumns(
        {
            "behavior": F.when(F.col("identity_leak") & differs, F.lit(0.05)).otherwise(plain),
            "lacks_play": s["teasing"] & F.col("__t.playful") & ~F.col("__c.playful"),
            "lacks_comfort": s["emotional"] & F.col("__t.gentle") & ~F.col("__c.gentle"),
        }
    ).drop("__s", "__t", "__c", "__context")


#: Samples and items that one automaton meets.
SAMPLES_A_BLOCK, ITEMS_A_BLOCK = 4096, 50_000


def _blocks(rows: DataFrame, scope: str, size: int, name: str) -> DataFrame:
    """Scopes that need several blocks of about ``size`` rows, with how many: a row in ``size`` at most, so they are broadcast."""
    counts = rows.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    return F.broadcast(counts.filter(F.col(name) > 1))


def found_items(
    texts: DataFrame, items: DataFrame, id: str, scope: str,
    fold: Callable[[dict, list[dict], list[dict]], Iterable[tuple]] | None = None, kinds: str = "__key long, in_said boolean",
) -> DataFrame:
    """(id, __key, in_said): items whose value occurs in ``said`` or ``around`` of a sample of their scope.

    ``items``: (scope, __key long, value).  A scope's items and samples are dealt into blocks of bounded size; each pair of
    blocks builds one Aho-Corasick automaton and reads its texts once, so what leaves it is in proportion to the hits.
    ``fold`` makes rows of ``kinds`` from a sample, its items in ``said`` and those in ``around`` alone, all of them dicts of
    the columns they come with; what leaves then is in proportion to the samples.
    """
    texts, items = texts.filter(F.col(scope).isNotNull()), items.filter(F.col(scope).isNotNull())
    numbers = [_blocks(texts, scope, SAMPLES_A_BLOCK, "__s_n"), _blocks(items, scope, ITEMS_A_BLOCK, "__i_n")]
    numbered = lambda rows: reduce(lambda df, n: df.join(n, scope, "left"), numbers, rows).fillna(1, ["__s_n", "__i_n"])
    block = lambda key, n, name: F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = numbered(texts).select(*texts.columns, block(id, "__s_n", "__s"), each("__i_n", "__i"))
    right = numbered(items).select(
        F.col(scope).alias("__scope"), *[c for c in items.columns if c != scope], block("__key", "__i_n", "__b"), each("__s_n", "__a")
    )
    each_hit = lambda sample, now, before: [(i["__key"], flag) for own, flag in ((now, True), (before, False)) for i in own]
    fold = fold or each_hit
    schema = T.StructType([texts.schema[id], *T.StructType.fromDDL(kinds).fields])

    def meet(samples: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        out = [[] for _ in schema.names]
        if samples.num_rows and known.num_rows:
            automaton, own = ahocorasick.Automaton(), {}
            for item in known.drop_columns(["__scope", "__b", "__a"]).to_pylist():
                own.setdefault(item["value"], []).append(item)
            for value in own:
                automaton.add_word(value, value)
            automaton.make_automaton()
            for sample in samples.drop_columns([scope, "__s", "__i"]).to_pylist():
                now = {value for _, value in automaton.iter(sample["said"])}
                before = {value for _, value in automaton.iter(sample["around"])} - now
                if now or before:
                    for row in fold(sample, *([i for value in values for i in own[value]] for values in (now, before))):
                        for c, v in zip(out, (sample[id], *row)):
                            c.append(v)
        return pa.table([pa.array(v, kind) for v, kind in zip(out, [samples.schema.field(id).type, *to_arrow_schema(schema).types[1:]])], names=schema.names)

    pairs = left.groupBy(scope, "__s", "__i").cogroup(right.groupBy("__scope", "__a", "__b"))
    return pairs.applyInArrow(meet, schema)


def _grounded(sample: dict, now: list[dict], before: list[dict]) -> list[tuple]:
    """How many known items a sample says, and what it gets wrong; ``alike`` are the texts of all samples of its id, if several."""
    said = sample["alike"] or [sample["said"]]
    issues = []
    for item in now:
        label, found = item["label"], []
        if item["entity"]:
            for text in said:
                wrong = [c for c, low in zip(item["contradictions"], item["lowered"]) if low is not None and low in text]
                found += [None if label is None else f'entity contradiction: "{label}" with "{c}"' for c in wrong]
        elif item["negated"]:
            found = [None if label is None else f'fact contradiction: "{label}" asserted when negated'] * len(said)
        issues += found * item["copies"]
    return [(len(said) * sum(item["copies"] for item in now), issues)]


def grounding(samples: DataFrame, items: DataFrame, id: str = "sample_id", scope: str = "speaker") -> DataFrame:
    """What each sample says of known entities and facts.

    ``items``: (scope, kind 'entity' or 'fact', label, value, contradictions array<string>, negated boolean).  The hits of a
    sample are added up where they are found; they are never rows.
    """
    same = Window.partitionBy(id)
    texts = samples.filter(F.col(id).isNotNull()).select(
        id,
        scope,
        F.lower(F.concat_ws("\x1f", context_text("context"), "target")).alias("around"),
        F.lower(F.coalesce("candidate", F.lit(""))).alias("said"),
    )
    texts = texts.withColumn("alike", F.when(F.count(F.lit(1)).over(same) > 1, F.collect_list("said").over(same)))
    value, none = F.lower("value").alias("value"), F.array().cast("array<string>")
    known = items.filter(F.coalesce("value", F.lit("")) != "").groupBy(scope, "kind", "label", value, "contradictions", "negated")
    known = known.agg(F.count(F.lit(1)).alias("copies")).select(
        scope, "label", "value", "copies",
        F.coalesce(F.col("kind") == "entity", F.lit(False)).alias("entity"),
        F.coalesce("negated", F.lit(False)).alias("negated"),
        F.coalesce("contradictions", none).alias("contradictions"),
        F.transform(F.coalesce("contradictions", none), F.lower).alias("lowered"),
        F.xxhash64(scope, "kind", "label", "value", "contradictions", "negated").alias("__key"),
    )
    met = found_items(texts, known, id, scope, _grounded, "grounded long, issues array<string>")
    return met.groupBy(id).agg(
        F.sum("grounded").alias("grounded"),
        F.sum(F.size("issues")).alias("contradicted"),
        # A sample text holds a bounded number of items.
        F.array_sort(F.flatten(F.collect_list("issues"))).alias("grounding_issues"),
    )


def context_score(
    samples: DataFrame, items: DataFrame | None = None, id: str = "sample_id", scope: str = "speaker",
    question: list[str] = lx.DIRECT_QUESTION,
) -> DataFrame:
    """Adds ``context_consistency``: null where nothing can be verified."""
    if items is None:
        rows = samples.withColumns(
            {
                "grounded": F.lit(None).cast("long"),
                "contradicted": F.lit(0).cast("long"),
                "grounding_issues": F.array().cast("array<string>"),
            }
        )
    else:
        rows = samples.join(grounding(samples, items, id, scope), id, "left")
    last = F.coalesce(F.element_at("context", -1)["content"], F.lit(""))
    asked = F.coalesce(F.size("context") > 0, F.lit(False)) & F.when(F.size("context") > 0, has(last, lx.any_of(question))).otherwise(
        F.lit(False)
    )
    rows = rows.withColumn("evasive", asked & (F.length(F.coalesce("candidate", F.lit(""))) < 2))
    known = F.col("grounded").isNotNull() | F.coalesce(F.size("context") > 0, F.lit(False))
    bonus = F.least(F.lit(1.0), F.lit(0.85) + F.coalesce("grounded", F.lit(0)) * 0.05)
    score = bonus - F.coalesce("contradicted", F.lit(0)) * 0.25 - F.when(F.col("evasive"), 0.20).otherwise(0.0)
    return rows.withColumn(
        "context_consistency",
        F.when(F.col("target") == F.col("candidate"), F.lit(1.0)).when(known, round_half(clamp(score, 0.10, 1.0), 3)),
    )


def issue_tags() -> Column:
    """All issues of a scored row, in the order of the dimensions."""
    longer = F.length("candidate") > F.length("target")
    differs = F.col("target") != F.col("candidate")
    flags = [
        (F.col("length_ratio") < 0.35) & longer, "response too verbose / long",
        (F.col("length_ratio") < 0.35) & ~longer, "response too brief / short",
        (F.col("target_emojis") > 0) & (F.col("candidate_emojis") == 0), "missing characteristic emoji",
        (F.col("target_emojis") == 0) & (F.col("candidate_emojis") >= 3), "excessive emoji spam",
        F.col("identity_leak"), "CRITICAL: AI identity leak detected",
        F.col("lacks_play") & ~F.col("identity_leak"), "lacks playful bantering response strategy",
        F.col("lacks_comfort") & ~F.col("identity_leak"), "insufficient emotional acknowledgment",
    ]
    usable = differs & (F.coalesce("target", F.lit("")) != "") & (F.coalesce("candidate", F.lit("")) != "")
    plain = F.array_compact(F.array(*[F.when(usable & flag, F.lit(text)) for flag, text in zip(flags[::2], flags[1::2])]))
    none = F.array().cast("array<string>")
    ground = F.when(differs, F.coalesce("grounding_issues", none)).otherwise(none)
    evasive = F.when(
        differs & F.col("evasive"), F.array(F.lit("evasive or empty response to direct inquiry"))
    ).otherwise(none)
    return F.concat(plain, ground, evasive)


def judge_heuristic(samples: DataFrame) -> DataFrame:
    """Adds ``judge_score``, ``judge_tie`` and ``judge_reasons`` from lengths and emojis."""
    near = F.coalesce(length_ratio("target", "candidate"), F.lit(0.0))
    many = F.abs(emoji_count("target") - emoji_count("candidate")) > 2
    reasons = F.array_compact(
        F.array(F.when(near < 0.4, "message_length_mismatch"), F.when(many, "emoji_overuse"))
    )
    return samples.withColumns(
        {
            "judge_score": round_half(clamp(near * 0.35 + 0.55, 0.40, 0.95), 3),
            "judge_tie": near >= 0.85,
            "judge_reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("natural_dialogue_heuristic"))),
        }
    )


def blind_assignment(samples: DataFrame, id: str = "sample_id", seed: int = 42) -> DataFrame:
    """Adds ``target_is_a``: which side the true reply is shown on, fixed by id and seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    return samples.withColumn("target_is_a", F.substring(digest, 32, 1).isin(*"02468ace"))


def judge_composite(samples: DataFrame, judgements: DataFrame, id: str = "sample_id") -> DataFrame:
    """Joins external judgements (id, winner, style_, behavior_ and context_similarity)."""
    rows = samples.join(judgements, id)
    favoured = (
        (F.col("target_is_a") & (F.col("winner") == "B"))
        | (~F.col("target_is_a") & (F.col("winner") == "A"))
        | (F.col("winner") == "TIE")
    )
    score = F.col("style_similarity") * 0.40 + F.col("behavior_similarity") * 0.35 + F.col("context_similarity") * 0.25
    return rows.withColumns({"judge_score": round_half(score, 3), "favoured_or_tie": favoured})


def score_samples(
    samples: DataFrame,
    profile: DataFrame | None = None,
    items: DataFrame | None = None,
    id: str = "sample_id",
    speaker: str = "speaker",
) -> DataFrame:
    """All dimensions, the heuristic judge and the issues for every sample."""
    rows = samples if profile is None else samples.join(profile, speaker, "left")
    rows = behavior_score(style_score(lexical_score(rows, id)))
    rows = judge_heuristic(context_score(rows, items, id, speaker))
    return rows.withColumn("issues", issue_tags()).withColumnRenamed("context_consistency", "context_score")
