"""Reply scores and the evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.frames import SAMPLES, SQL_SPLIT, chat, samples, table
from colloquy.operators import profiles, report, scoring, style, turns
from colloquy.plans.lineage import stored
from colloquy.queries import behaviour, talk
from colloquy.registry import query

SITUATIONS = {"teasing": ["哈哈", "que"], "emotional": ["好的", "ung"], "inquiry": ["怎么", "ver"], "formal": ["喜欢", "des"]}
BEHAVIOR = {"playful": ["哈哈", "en"], "gentle": ["好的", "er"], "formal": ["怎么", "la"]}
LEAK = ["晚安", "ungen"]
POLICIES = [("greeting", 0.1, 0.2, 0.3), ("joking", 0.25, 0.5, 0.125), ("emotional", 0.5, 0.75, 0.25), ("question", 0.125, 0.25, 0.75)]
VOCABULARY = ["the", "la", "en", "de", "哈", "好", "的", "die", "that", "que"]
PHRASES = ["哈哈", "好的", "the", "en ", "? "]
RATES = {
    "ellipsis_rate": 0.1, "question_rate": 0.3, "exclamation_rate": 0.2, "tilde_rate": 0.25, "terminal_punctuation_drop_rate": 0.8,
    "repeated_char_rate": 0.15, "median_length": 60.0,
}
EMOJI = "[😂👍]"


def _with_profile(rows):
    """The same profile for every speaker."""
    policy = [
        F.struct(
            F.lit(s).alias("situation"), F.lit(e).alias("emoji_probability"), F.lit(b).alias("short_reply_probability"),
            F.lit(q).alias("follow_up_probability"),
        )
        for s, e, b, q in POLICIES
    ]
    return rows.withColumns(
        {"top_vocabulary": F.array(*map(F.lit, VOCABULARY)), "phrases": F.array(*map(F.lit, PHRASES)), "policies": F.array(*policy)}
        | {name: F.lit(v) for name, v in RATES.items()}
    )


def _profiled(spark, sf):
    return _with_profile(samples(spark, sf))


def _grams(n: int) -> str:
    return f"""SELECT sample_id, {n} AS n, substr(lower(target), i, {n}) AS g, 1 AS t, 0 AS c
  FROM (SELECT *, unnest(range(1, length(target) - {n} + 2)) AS i FROM samples)
  UNION ALL SELECT sample_id, {n}, substr(lower(candidate), i, {n}), 0, 1 FROM (SELECT *, unnest(range(1, length(candidate) - {n} + 2)) AS i FROM samples)"""


_COSINE = f"""gr AS ({' UNION ALL '.join(_grams(n) for n in (1, 2, 3))}),
gc AS (SELECT sample_id, n, g, sum(t) AS t, sum(c) AS c FROM gr GROUP BY ALL),
co AS (SELECT sample_id, n, CASE WHEN sum(t * t) = 0 OR sum(c * c) = 0 THEN 0 ELSE sum(t * c) / (sqrt(sum(t * t)) * sqrt(sum(c * c))) END AS cos FROM gc GROUP BY ALL),
ng AS (SELECT sample_id, sum(cos * CASE n WHEN 3 THEN 0.30 ELSE 0.35 END :: DOUBLE) AS ngram_score FROM co GROUP BY 1)"""


@query(f"WITH {SAMPLES}, {_COSINE} SELECT sample_id, round(ngram_score, 6) AS ngram_score FROM ng")
def ngram_cosine(spark, sf):
    return scoring.char_ngram_cosine(samples(spark, sf)).withColumn("ngram_score", F.round("ngram_score", 6))


def _ratio(a: str, b: str) -> str:
    return f"(least({a}, {b}) / greatest({a}, {b}))"


def _sentence(x: str) -> str:
    return f"(length({x}) / greatest(1, len(list_filter(string_split_regex({x}, '[。！？!?\\n]+'), lambda s: s <> ''))))"


_PUNCT = " + ".join(
    f"abs((length(target) - length(replace(target, '{m}', ''))) / greatest(1, length(target)) - (length(candidate) - length(replace(candidate, '{m}', ''))) / greatest(1, length(candidate)))"
    for m in lx.PUNCTUATION
)
_LEX = f"""{_COSINE},
tk AS (SELECT *, regexp_extract_all(lower(candidate), '[一-龥]|[a-zA-Z0-9'']+') AS tok FROM samples JOIN ng USING (sample_id)),
lp AS (SELECT *, CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda s: s IN {tuple(VOCABULARY)})) / len(tok) ELSE 0.75 END AS v0,
  len(list_filter({PHRASES}, lambda s: contains(candidate, s))) AS hits, greatest(0, 1 - 4.0 :: DOUBLE * ({_PUNCT})) AS punct_similarity,
  {_ratio('length(target)', 'length(candidate)')} AS length_ratio, {_ratio(_sentence('target'), _sentence('candidate'))} AS sentence_length_ratio FROM tk),
lq AS (SELECT *, CASE WHEN hits > 0 THEN least(1, v0 + hits * 0.1 :: DOUBLE) ELSE v0 END AS vocab_fidelity FROM lp),
lex AS (SELECT *, CASE WHEN target = candidate THEN 1 ELSE greatest(0.05 :: DOUBLE, least(1, round(ngram_score * 0.3 :: DOUBLE + vocab_fidelity * 0.2 :: DOUBLE
  + punct_similarity * 0.2 :: DOUBLE + length_ratio * 0.15 :: DOUBLE + sentence_length_ratio * 0.15 :: DOUBLE, 3))) END AS lexical FROM lq)"""
_LEX_PARTS = ["vocab_fidelity", "punct_similarity", "length_ratio", "sentence_length_ratio"]


def _rounded(df, parts):
    return df.withColumns({p: F.round(p, 6) for p in parts})


@query(f"WITH {SAMPLES}, {_LEX} SELECT sample_id, lexical, {', '.join(f'round({p}, 6) AS {p}' for p in _LEX_PARTS)} FROM lex")
def lexical_score(spark, sf):
    return _rounded(scoring.lexical_score(_profiled(spark, sf)), _LEX_PARTS).select("sample_id", "lexical", *_LEX_PARTS)


_REPEAT = "|".join(c + "{3,}" for c in "abcdefghijklmnopqrstuvwxyz哈好的晚安喜欢怎么")


def _feat(x: str, p: str) -> str:
    t = f"trim({x}, chr(32) || chr(10) || chr(9))"
    return f"""len(regexp_extract_all({x}, '{EMOJI}')) AS {p}emojis, regexp_matches({x}, '[.]{{2,}}|…') AS {p}ellipsis, regexp_matches({x}, '[?？]') AS {p}question,
  regexp_matches({x}, '[!！]') AS {p}exclamation, regexp_matches({x}, '[~～]') AS {p}tilde, NOT regexp_matches({t}, '[。！？!?.~～…]$') AS {p}clean_terminal,
  CASE WHEN length({x}) <= 8 THEN 0 WHEN length({x}) <= 22 THEN 1 WHEN length({x}) <= 55 THEN 2 ELSE 3 END AS {p}bucket, regexp_matches({x}, '(?i){_REPEAT}') AS {p}repetition"""


def _same(name: str, other: float, weight: float) -> str:
    return f"CASE WHEN t_{name} = c_{name} THEN 1 ELSE {other} END :: DOUBLE * {weight} :: DOUBLE"


_FLAG = {"ellipsis_rate": "ellipsis", "question_rate": "question", "exclamation_rate": "exclamation", "tilde_rate": "tilde",
         "terminal_punctuation_drop_rate": "clean_terminal", "repeated_char_rate": "repetition"}
_GAPS = " + ".join(f"abs(CAST(c_{f} AS INT) - {RATES[r]} :: DOUBLE)" for r, f in _FLAG.items())
_STYLE = f"""sf AS (SELECT *, {_feat('target', 't_')}, {_feat('candidate', 'c_')} FROM lex),
sl AS (SELECT *, CASE abs(t_emojis - c_emojis) WHEN 0 THEN 1 WHEN 1 THEN 0.8 ELSE greatest(0.2, 1 - abs(t_emojis - c_emojis) * 0.25) END :: DOUBLE * 0.18 :: DOUBLE
  + {_same('ellipsis', 0.4, 0.13)} + {_same('question', 0.5, 0.13)} + {_same('exclamation', 0.6, 0.10)} + {_same('tilde', 0.65, 0.10)}
  + {_same('clean_terminal', 0.65, 0.14)} + CASE abs(t_bucket - c_bucket) WHEN 0 THEN 1 WHEN 1 THEN 0.7 ELSE 0.35 END :: DOUBLE * 0.12 :: DOUBLE
  + {_same('repetition', 0.55, 0.10)} AS local_style_match,
  greatest(0.15 :: DOUBLE, 1 - ({_GAPS} + least(1, abs(length(candidate) - 60) / greatest(length(candidate), 60))) / 7 * 0.85 :: DOUBLE) AS distribution_similarity FROM sf),
sty AS (SELECT *, CASE WHEN target = candidate THEN 1 ELSE greatest(0.05 :: DOUBLE, least(1, round(distribution_similarity * 0.6 :: DOUBLE + local_style_match * 0.4 :: DOUBLE, 3))) END AS style FROM sl)"""


@query(f"WITH {SAMPLES}, {_LEX}, {_STYLE} SELECT sample_id, style, round(local_style_match, 6) AS local_style_match, round(distribution_similarity, 6) AS distribution_similarity FROM sty")
def style_score(spark, sf):
    parts = ["local_style_match", "distribution_similarity"]
    return _rounded(scoring.style_score(_profiled(spark, sf)), parts).select("sample_id", "style", *parts)


def _on(words: list[str], x: str) -> str:
    return f"regexp_matches({x}, '(?i)({'|'.join(words)})')"


def _behave(x: str, p: str) -> str:
    return ", ".join(f"{_on(w, x)} AS {p}{n}" for n, w in BEHAVIOR.items()) + f", regexp_matches({x}, '[?？]') AS {p}asks, length({x}) <= 15 AS {p}brief"


def _pair(name: str, other: float) -> str:
    return f"CASE WHEN bt_{name} = bc_{name} THEN 1 ELSE {other} END :: DOUBLE"


_P = {name: rest for name, *rest in POLICIES}


def _policy(i: int) -> str:
    return f"""CASE WHEN s_teasing THEN {_P['joking'][i]} WHEN s_emotional THEN {_P['emotional'][i]} WHEN s_inquiry THEN {_P['question'][i]} END :: DOUBLE"""


_BEHAVE = f"""bf AS (SELECT *, {', '.join(f"{_on(w, 'ctx')} AS s_{n}" for n, w in SITUATIONS.items())}, {_behave('target', 'bt_')}, {_behave('candidate', 'bc_')},
  {_on(LEAK, 'candidate')} AS identity_leak, regexp_matches(candidate, '{EMOJI}') AS bc_emoji FROM sty),
bp AS (SELECT *, (CASE WHEN s_teasing THEN {_pair('playful', 0.35)} * 1.5 :: DOUBLE ELSE 0 END + CASE WHEN s_emotional THEN {_pair('gentle', 0.3)} * 1.5 :: DOUBLE ELSE 0 END
  + {_pair('asks', 0.65)} + {_pair('formal', 0.45)} + {_pair('brief', 0.6)} * 0.8 :: DOUBLE)
  / (CASE WHEN s_teasing THEN 1.5 ELSE 0 END + CASE WHEN s_emotional THEN 1.5 ELSE 0 END + 2.8) :: DOUBLE AS pairwise_match,
  (3 - abs(CAST(bc_emoji AS INT) - {_policy(0)}) - abs(CAST(bc_brief AS INT) - {_policy(1)}) - abs(CAST(bc_asks AS INT) - {_policy(2)})) / 3 AS pm,
  CASE WHEN s_emotional THEN CASE WHEN bc_gentle THEN 1 ELSE 0.4 END WHEN s_teasing THEN CASE WHEN bc_playful THEN 1 ELSE 0.5 END
    WHEN s_formal THEN CASE WHEN bc_formal THEN 1 ELSE 0.5 END WHEN s_inquiry THEN CASE WHEN bc_asks OR length(candidate) >= 6 THEN 0.9 ELSE 0.6 END
    ELSE 0.8 END :: DOUBLE AS context_alignment FROM bf),
beh AS (SELECT *, coalesce(pm, pairwise_match) AS policy_match, CASE WHEN target = candidate THEN 1 WHEN identity_leak THEN 0.05 :: DOUBLE ELSE greatest(0.1 :: DOUBLE, least(1,
  round(pairwise_match * 0.4 :: DOUBLE + coalesce(pm, pairwise_match) * 0.4 :: DOUBLE + context_alignment * 0.2 :: DOUBLE, 3))) END AS behavior FROM bp)"""


@query(
    f"""WITH {SAMPLES}, {_LEX}, {_STYLE}, {_BEHAVE} SELECT sample_id, behavior, identity_leak, round(pairwise_match, 6) AS pairwise_match,
  round(policy_match, 6) AS policy_match, context_alignment FROM beh"""
)
def behavior_score(spark, sf):
    out = scoring.behavior_score(_profiled(spark, sf), SITUATIONS, BEHAVIOR, LEAK)
    parts = ["pairwise_match", "policy_match"]
    return _rounded(out, parts).select("sample_id", "behavior", "identity_leak", *parts, "context_alignment")


# What a speaker is known to have said: long words of the even turns as entities, short words of the odd ones as facts.
_ITEMS = """items AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS speaker, 'entity' AS kind, w AS label, w AS value, 'en ' AS contra, FALSE AS negated
  FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations WHERE turn % 2 = 0)
  UNION SELECT CAST(conv_id AS VARCHAR), 'fact', w, w, NULL, conv_id % 2 = 0
  FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,4}')) AS w FROM conversations WHERE turn % 2 = 1))"""
_GROUND = f"""{_ITEMS}, hit AS (SELECT sample_id, kind, label, contra, negated, contains(lower(candidate), value) AS said, lower(candidate) AS cand
  FROM samples JOIN items USING (speaker) WHERE contains(lower(candidate), value) OR contains(lower(ctx || chr(31) || target), value)),
ground AS (SELECT sample_id, count(*) FILTER (said) AS grounded, count(*) FILTER (said AND CASE WHEN kind = 'entity' THEN contains(cand, contra) ELSE negated END) AS contradicted,
  list(CASE WHEN kind = 'entity' THEN 'entity contradiction: "' || label || '" with "' || contra || '"' ELSE 'fact contradiction: "' || label || '" asserted when negated' END)
  FILTER (said AND CASE WHEN kind = 'entity' THEN contains(cand, contra) ELSE negated END) AS grounding_issues FROM hit GROUP BY 1),
con AS (SELECT s.*, grounded, coalesce(contradicted, 0) AS contradicted, coalesce(grounding_issues, []) AS grounding_issues,
  CASE WHEN target = candidate THEN 1 ELSE round(greatest(0.1 :: DOUBLE, least(1, least(1, 0.85 :: DOUBLE + coalesce(grounded, 0) * 0.05 :: DOUBLE) - coalesce(contradicted, 0) * 0.25 :: DOUBLE
    - CASE WHEN regexp_matches(context[-1].content, '怎么|[?？]') AND length(candidate) < 2 THEN 0.2 ELSE 0 END :: DOUBLE)), 3) END AS context_score FROM beh s LEFT JOIN ground USING (sample_id))"""


def _items(spark, sf):
    c = table(spark, sf, "conversations").withColumn("speaker", F.col("conv_id").cast("string"))
    word = lambda p: F.explode(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).alias("value")
    none = F.lit(None).cast("array<string>")
    entities = c.filter("turn % 2 = 0").select("speaker", F.lit("entity").alias("kind"), word("[a-z]{5,}"), F.array(F.lit("en ")).alias("contradictions"), F.lit(False).alias("negated"))
    told = c.filter("turn % 2 = 1").select("speaker", F.lit("fact").alias("kind"), word("[a-z]{3,4}"), none.alias("contradictions"), (F.col("conv_id") % 2 == 0).alias("negated"))
    return entities.union(told).distinct().select("speaker", "kind", F.col("value").alias("label"), "value", "contradictions", "negated")


def _scored(spark, sf):
    # The samples feed the cosine, the grounding and the scores, so they are made once; the profile is no part of what is kept.
    rows = _with_profile(stored(samples(spark, sf)))
    rows = scoring.behavior_score(scoring.style_score(scoring.lexical_score(rows)), SITUATIONS, BEHAVIOR, LEAK)
    rows = scoring.judge_heuristic(scoring.context_score(rows, _items(spark, sf), question=["怎么", "[?？]"]))
    return rows.withColumn("issues", scoring.issue_tags()).withColumnRenamed("context_consistency", "context_score")


_BASE = f"{SAMPLES}, {_LEX}, {_STYLE}, {_BEHAVE}, {_GROUND}"


@query(f"WITH {_BASE} SELECT sample_id, grounded, contradicted, context_score FROM con")
def context_score(spark, sf):
    rows = scoring.context_score(_profiled(spark, sf), _items(spark, sf), question=["怎么", "[?？]"])
    return rows.select("sample_id", "grounded", F.coalesce("contradicted", F.lit(0)).alias("contradicted"), F.col("context_consistency").alias("context_score"))


_REASONS = f"""CASE WHEN length_ratio < 0.4 AND abs(len(regexp_extract_all(target, '{EMOJI}')) - len(regexp_extract_all(candidate, '{EMOJI}'))) > 2 THEN 'message_length_mismatch,emoji_overuse'
  WHEN length_ratio < 0.4 THEN 'message_length_mismatch' WHEN abs(len(regexp_extract_all(target, '{EMOJI}')) - len(regexp_extract_all(candidate, '{EMOJI}'))) > 2 THEN 'emoji_overuse'
  ELSE 'natural_dialogue_heuristic' END"""
_JUDGE = "round(greatest(0.4 :: DOUBLE, least(0.95 :: DOUBLE, length_ratio * 0.35 :: DOUBLE + 0.55 :: DOUBLE)), 3)"


@query(
    f"""WITH {SAMPLES}, r AS (SELECT *, {_ratio('length(target)', 'length(candidate)')} AS length_ratio FROM samples)
SELECT sample_id, {_JUDGE} AS judge_score, length_ratio >= 0.85 AS judge_tie, {_REASONS} AS judge_reasons FROM r"""
)
def judge_heuristic(spark, sf):
    rows = scoring.judge_heuristic(samples(spark, sf))
    return rows.select("sample_id", "judge_score", "judge_tie", F.array_join("judge_reasons", ",").alias("judge_reasons"))


_ISSUES = """list_filter([
  CASE WHEN target <> candidate AND length_ratio < 0.35 AND length(candidate) > length(target) THEN 'response too verbose / long' END,
  CASE WHEN target <> candidate AND length_ratio < 0.35 AND length(candidate) <= length(target) THEN 'response too brief / short' END,
  CASE WHEN target <> candidate AND t_emojis > 0 AND c_emojis = 0 THEN 'missing characteristic emoji' END,
  CASE WHEN target <> candidate AND t_emojis = 0 AND c_emojis >= 3 THEN 'excessive emoji spam' END,
  CASE WHEN target <> candidate AND identity_leak THEN 'CRITICAL: AI identity leak detected' END,
  CASE WHEN target <> candidate AND NOT identity_leak AND s_teasing AND bt_playful AND NOT bc_playful THEN 'lacks playful bantering response strategy' END,
  CASE WHEN target <> candidate AND NOT identity_leak AND s_emotional AND bt_gentle AND NOT bc_gentle THEN 'insufficient emotional acknowledgment' END], lambda x: x IS NOT NULL)"""
_FULL = f"""{_BASE}, sc AS (SELECT *, {_JUDGE} AS judge_score,
  list_concat(list_concat({_ISSUES}, CASE WHEN target <> candidate THEN list_sort(grounding_issues) ELSE [] END),
    CASE WHEN target <> candidate AND regexp_matches(context[-1].content, '怎么|[?？]') AND length(candidate) < 2 THEN ['evasive or empty response to direct inquiry'] ELSE [] END) AS issues FROM con),
dsi AS (SELECT *, lexical * 0.2 :: DOUBLE + style * 0.2 :: DOUBLE + behavior * 0.25 :: DOUBLE + judge_score * 0.2 :: DOUBLE + context_score * 0.15 :: DOUBLE AS d FROM sc)"""


@query(f"WITH {_FULL} SELECT sample_id, array_to_string(issues, '|') AS issues, round(d, 3) AS sample_dsi FROM dsi")
def sample_dsi(spark, sf):
    rows = report.sample_dsi(_scored(spark, sf))
    return rows.select("sample_id", F.array_join("issues", "|").alias("issues"), "sample_dsi")


_MEANS = ["lexical", "style", "behavior", "context_score", "judge_score"]
_REPORT = f"""{_FULL}, mean AS (SELECT CAST(CAST(speaker AS BIGINT) % 5 AS BIGINT) AS part, count(*) AS dataset_size, {', '.join(f'round(avg({m}), 3) AS {m}' for m in _MEANS)} FROM sc GROUP BY 1),
rep AS (SELECT *, round(lexical * 0.2 :: DOUBLE + style * 0.2 :: DOUBLE + behavior * 0.25 :: DOUBLE + judge_score * 0.2 :: DOUBLE + context_score * 0.15 :: DOUBLE, 3) AS dsi FROM mean)"""


@query(
    f"""WITH {_REPORT} SELECT part, dataset_size, {', '.join(_MEANS)}, dsi, dsi >= 0.8 AS dsi_pass, lexical >= 0.8 AS lexical_pass, style >= 0.8 AS style_pass,
  behavior >= 0.75 AS behavior_pass, context_score >= 0.9 AS context_pass,
  CASE WHEN dsi >= 0.8 AND lexical >= 0.8 AND style >= 0.8 AND behavior >= 0.75 AND context_score >= 0.9 THEN 'PASS' WHEN dsi >= 0.75 THEN 'NEEDS_OPTIMIZATION' ELSE 'FAIL' END AS status FROM rep
UNION ALL SELECT 99, 0, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, FALSE, FALSE, FALSE, FALSE, 'INSUFFICIENT_DATA'"""
)
def evaluation_report(spark, sf):
    scored = _scored(spark, sf).withColumn("part", F.col("speaker").cast("long") % 5)
    parts = table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("part")).union(spark.range(99, 100).toDF("part"))
    out = report.evaluation_report(scored, ["part"], groups=parts)
    return out.select(
        "part", "dataset_size", *_MEANS, "dsi", "dsi_pass", "lexical_pass", "style_pass", "behavior_pass", "context_pass", "status"
    )


_FAILED = f"""{_FULL}, failed AS (SELECT CAST(speaker AS BIGINT) % 5 AS part, sample_id, CASE WHEN len(issues) > 0 THEN issues ELSE ['sub-threshold behavioral match'] END AS issues,
  round(d, 3) AS score FROM dsi WHERE d < 0.78 OR len(issues) > 0)"""


@query(
    f"""WITH {_FAILED} SELECT part, sample_id, array_to_string(issues, '|') AS issues, score, row_number() OVER (PARTITION BY part ORDER BY sample_id) AS rank
FROM failed QUALIFY rank <= 15"""
)
def failure_cases(spark, sf):
    scored = _scored(spark, sf).withColumn("part", F.col("speaker").cast("long") % 5)
    out = report.failure_cases(scored, ["part"])
    return out.select("part", "sample_id", F.array_join("issues", "|").alias("issues"), "score", "rank")


def _mention(p: str) -> str:
    return f"count(*) FILTER (len(list_filter(issues, lambda x: regexp_matches(x, '{p}'))) > 0)"


@query(
    f"""WITH {_FAILED} SELECT part, {_mention('too long|verbose')} AS verbose_count, {_mention('missing(?: characteristic)? emoji')} AS missing_emoji_count,
  {_mention('strategy|direct')} AS strategy_count FROM failed GROUP BY 1"""
)
def issue_counts(spark, sf):
    scored = _scored(spark, sf).withColumn("part", F.col("speaker").cast("long") % 5)
    return report.issue_counts(report.failures(scored), ["part"])


@query(f"WITH {SAMPLES} SELECT sample_id FROM samples QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY sample_id) <= 15")
def sample_limit(spark, sf):
    return report.sample_limit(samples(spark, sf), ["speaker"], k=15).select("sample_id")


@query(
    f"""WITH {SAMPLES} SELECT sample_id, substr(md5('42:' || sample_id), 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS target_is_a FROM samples"""
)
def blind_assignment(spark, sf):
    return scoring.blind_assignment(samples(spark, sf)).select("sample_id", "target_is_a")


@query(
    f"""WITH {SAMPLES} SELECT sample_id, round((sample_id % 7) / 7 * 0.4 :: DOUBLE + (sample_id % 5) / 5 * 0.35 :: DOUBLE + (sample_id % 3) / 3 * 0.25 :: DOUBLE, 3) AS judge_score,
  CASE sample_id % 3 WHEN 0 THEN sample_id % 2 = 1 WHEN 1 THEN sample_id % 2 = 0 ELSE TRUE END AS favoured_or_tie FROM samples"""
)
def judge_composite(spark, sf):
    s = samples(spark, sf).withColumn("target_is_a", F.col("sample_id") % 2 == 0)
    k = F.col("sample_id")
    judged = s.select(
        "sample_id", F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("TIE").alias("winner"), (k % 7 / 7).alias("style_similarity"),
        (k % 5 / 5).alias("behavior_similarity"), (k % 3 / 3).alias("context_similarity"),
    )
    return scoring.judge_composite(s, judged).select("sample_id", "judge_score", "favoured_or_tie")


# Profiles of the speakers' own train turns, in place of the literal ones above.
_OWN_TEXTS = """own AS (SELECT CAST(chat_id AS VARCHAR) AS sender, chat_id, session_no, seq, content AS said, context,
  array_to_string(list_transform(context, lambda c: c.content), ' ') AS ctx FROM split WHERE split = 'train'),
texts AS (SELECT * EXCLUDE (said, context, ctx), regexp_replace(said, '([一-龥])\\s+([一-龥])', '\\1\\2', 'g') AS content FROM own)"""
_OWN_RATES = ", ".join(
    f"{talk._share(flag)} AS {name}" for name, flag in {
        "ellipsis_rate": talk._like("[.]{2,}|…"), "question_rate": talk._like("[?？]"), "exclamation_rate": talk._like("[!！]"), "tilde_rate": talk._like("[~～]"),
        "repeated_char_rate": talk._TRIPLE, "terminal_punctuation_drop_rate": "NOT " + talk._like("[。！？!?.~～…]$"),
    }.items()
)
_OWN_PHRASES = f"""{talk._named('a', talk._PHRASES, 10)}, {talk._named('b', talk._REPEATED, 5)}, {talk._named('c', talk._FREQUENT, 5)},
ph AS (SELECT DISTINCT sender, token FROM (SELECT sender, token FROM a UNION ALL SELECT sender, token FROM b UNION ALL SELECT sender, token FROM c) WHERE length(token) BETWEEN 2 AND 15),
fo AS (SELECT sender, arg_min(said, seq) AS token FROM own WHERE length(said) BETWEEN 1 AND 25 GROUP BY chat_id, session_no, sender),
{talk._named('op', f"SELECT * FROM fo WHERE length(token) <= 20 AND regexp_matches(token, '(?i)^(?:{talk._OPEN})')", 8)},
fc AS (SELECT sender, said AS token FROM own QUALIFY row_number() OVER (PARTITION BY chat_id, session_no ORDER BY seq DESC) = 1),
{talk._named('cl', f"SELECT * FROM fc WHERE length(token) BETWEEN 1 AND 20 AND regexp_matches(token, '(?i)(?:{talk._CLOSE})')", 8)},
phr AS (SELECT sender, list(token) AS phrases FROM (SELECT sender, token FROM ph UNION ALL SELECT sender, token FROM op UNION ALL SELECT sender, token FROM cl) GROUP BY 1)"""


def _own_situation(i: int, name: str, marker: str) -> str:
    emoji, few, asks = [f"round((count(*) FILTER ({f}) + 1) / (count(*) + 2), 3)" for f in (f"regexp_matches(said, '{behaviour.EMOJI}')", "length(said) <= 15", "regexp_matches(said, '[?？]')")]
    return f"SELECT sender, {i} AS o, '{name}' AS situation, {emoji} AS e, {few} AS b, {asks} AS q FROM own WHERE {behaviour._m(marker)} GROUP BY sender"


_OWN_POLICIES = f"""st AS ({' UNION ALL '.join(_own_situation(i, n, m) for i, (n, m) in enumerate(style.SITUATIONS.items()))}),
pol AS (SELECT sender, list({{'situation': situation, 'e': e, 'b': b, 'q': q}} ORDER BY o) AS policies FROM st GROUP BY 1)"""
_OWN = f"""{SAMPLES.replace("samples AS (", "plain AS (")}, {SQL_SPLIT}, {_OWN_TEXTS}, rt AS (SELECT sender, {_OWN_RATES}, round(quantile_cont(length(content), 0.5), 2) AS median_length FROM texts GROUP BY 1),
{talk._SENT}, {talk._TOKENS}, {talk._named('w', talk._gram(1) + f" WHERE t[i] NOT IN {tuple(talk.STOP)}", 50)}, voc AS (SELECT sender, list(token) AS vocabulary FROM w GROUP BY 1),
{_OWN_PHRASES}, {_OWN_POLICIES},
samples AS (SELECT plain.*, rt.* EXCLUDE (sender), vocabulary, coalesce(phrases, []) AS phrases, coalesce(policies, []) AS policies FROM plain LEFT JOIN rt ON speaker = rt.sender
  LEFT JOIN voc ON speaker = voc.sender LEFT JOIN phr ON speaker = phr.sender LEFT JOIN pol ON speaker = pol.sender)"""
_OWN_LEX = _LEX.replace(f"s IN {tuple(VOCABULARY)}", "list_contains(vocabulary, s)").replace(str(PHRASES), "phrases").replace(
    "CASE WHEN len(tok) > 0 THEN", "CASE WHEN len(tok) > 0 AND coalesce(len(vocabulary), 0) > 0 THEN"
)
_OWN_GAPS = " + ".join(f"abs(CAST(c_{f} AS INT) - {r})" for r, f in _FLAG.items())
_OWN_STYLE = _STYLE.replace(_GAPS, _OWN_GAPS).replace("abs(length(candidate) - 60) / greatest(length(candidate), 60)", "abs(length(candidate) - median_length) / greatest(length(candidate), median_length)")
_FIT = "list_filter(policies, lambda p: (s_teasing AND p.situation = 'joking') OR (s_emotional AND p.situation IN ('venting', 'emotional')) OR (s_inquiry AND p.situation IN ('inquiry', 'question')))[1]"
_OWN_BEHAVE = _BEHAVE
for _i, _k in enumerate("ebq"):
    _OWN_BEHAVE = _OWN_BEHAVE.replace(_policy(_i), f"{_FIT}.{_k}")


@query(
    f"""WITH {_OWN}, {_OWN_LEX}, {_OWN_STYLE}, {_OWN_BEHAVE} SELECT sample_id, lexical, style, behavior, round(vocab_fidelity, 6) AS vocab_fidelity,
  round(distribution_similarity, 6) AS distribution_similarity, round(policy_match, 6) AS policy_match FROM beh"""
)
def score_samples(spark, sf):
    """Every sample against the profile of its own speaker, made from the train part of the speaker's turns."""
    split = turns.split_turns(turns.build_turns(chat(spark, sf), ts=None))
    train = split.filter("split = 'train'").withColumn("speaker", F.col("chat_id").cast("string"))
    own = profiles.speaker_profiles(
        train, phrases=talk.PHRASES, stopwords=talk.STOP, openings=talk.OPENINGS, closings=talk.CLOSINGS, markers=behaviour.MARKERS, phrase_stopwords=[],
    )
    parts = ["vocab_fidelity", "distribution_similarity", "policy_match"]
    out = profiles.score_samples(samples(spark, sf), own, "speaker", SITUATIONS, BEHAVIOR, LEAK)
    return _rounded(out, parts).select("sample_id", "lexical", "style", "behavior", *parts)
