"""Conditional style, rhythm, emoji use."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, SQL_SPLIT, chat, events, sql_events, sql_turns
from colloquy.operators import assets, rhythm, style, turns
from colloquy.registry import REGISTRY, query

KEY = ["chat_id"]
MARKERS = {
    "humor": ["哈哈", "que"], "serious": ["好的", "ung"], "sadness": ["喜欢", "ion"], "uncertainty": ["怎么", "ver"],
    "greeting": ["la", "des"], "explanation": ["les", "die"], "closing": ["晚安", "et"],
}
_TURNS = f"{CHAT}, {sql_turns('chat')}"
EMOJI = "[😂👍]"


def _featured(spark, sf):
    return style.features(turns.build_turns(chat(spark, sf), ts=None), markers=MARKERS)


def _m(name: str) -> str:
    return f"regexp_matches(ctx, '(?i)({'|'.join(MARKERS[name])})')"


_FEATURES = f"""{_TURNS}, x AS (SELECT *, array_to_string(list_transform(context, lambda c: c.content), ' ') AS ctx FROM turns),
feat AS (SELECT chat_id, seq, {', '.join(f'{_m(n)} AS marker_{n}' for n in MARKERS)}, length(ctx) AS context_length,
  regexp_matches(ctx, '[?？]') AS context_question, regexp_matches(content, '{EMOJI}') AS has_emoji,
  regexp_matches(content, '[.]{{2,}}|…') AS has_ellipsis, length(content) <= 15 AS is_short, length(content) >= 35 AS is_long,
  length(content) AS response_length, regexp_matches(content, '[?？]') AS asks_back FROM x)"""


@query(f"WITH {_FEATURES} SELECT * FROM feat")
def turn_features(spark, sf):
    f = _featured(spark, sf)
    return f.select(
        "chat_id", "seq", *[f"marker_{n}" for n in MARKERS], "context_length", "context_question", "has_emoji", "has_ellipsis",
        "is_short", "is_long", "response_length", "asks_back",
    )


def _condition(name, feature, marker, response):
    return f"""SELECT chat_id, '{name}' AS "condition", '{feature}' AS feature, count(*) FILTER (marker_{marker}) AS sample_size,
  count(*) FILTER (marker_{marker} AND {response}) AS raw_count FROM feat GROUP BY chat_id"""


@query(
    f"""WITH {_FEATURES}, c AS ({' UNION ALL '.join(_condition(*c) for c in style.CONDITIONS)})
SELECT *, round((raw_count + 1) / (sample_size + 2), 3) AS probability, round(tanh(sample_size / 20.0 :: DOUBLE), 3) AS confidence FROM c"""
)
def conditional_style(spark, sf):
    return style.conditional_style(_featured(spark, sf), KEY)


def _situation(i, name, marker):
    return f"""SELECT chat_id, {i} AS situation_order, '{name}' AS situation, count(*) AS evidence_count,
  round((count(*) FILTER (has_emoji) + 1) / (count(*) + 2), 3) AS emoji_probability,
  round((count(*) FILTER (is_short) + 1) / (count(*) + 2), 3) AS short_reply_probability,
  round((count(*) FILTER (asks_back) + 1) / (count(*) + 2), 3) AS follow_up_probability FROM feat WHERE marker_{marker} GROUP BY chat_id"""


_SITUATIONS = " UNION ALL ".join(_situation(i, n, m) for i, (n, m) in enumerate(style.SITUATIONS.items()))


@query(f"WITH {_FEATURES} {_SITUATIONS}")
def situation_stats(spark, sf):
    return style.situation_stats(_featured(spark, sf), KEY)


@query(
    f"""WITH {_FEATURES}, s AS ({_SITUATIONS})
SELECT *, CASE WHEN evidence_count >= 10 THEN 'high' WHEN evidence_count >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s
UNION ALL SELECT DISTINCT chat_id, 0, 'unknown', 0, NULL, NULL, NULL, 'none' FROM chat WHERE chat_id NOT IN (SELECT chat_id FROM s)"""
)
def policy_table(spark, sf):
    return style.policy_table(_featured(spark, sf), KEY, groups=chat(spark, sf))


_GAPS = f"""{sql_events(3)}, gaps AS (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap_ms, lag(is_target) OVER w AS prev_is_target
  FROM msg WINDOW w AS (PARTITION BY chat_id ORDER BY ts, seq)),
lat AS (SELECT *, gap_ms AS latency_ms FROM gaps WHERE is_target AND NOT prev_is_target AND gap_ms > 0 AND gap_ms < 1800000)"""


def _gaps(spark, sf):
    return rhythm.reply_gaps(events(spark, sf, 3))


@query(f"WITH {_GAPS} SELECT seq AS event_id, latency_ms FROM lat")
def reply_latency(spark, sf):
    return rhythm.reply_latency(_gaps(spark, sf)).select(F.col("seq").alias("event_id"), "latency_ms")


@query(
    f"""WITH {_GAPS}, d AS (SELECT chat_id, count(*) FILTER (is_target AND prev_is_target AND gap_ms > 0 AND gap_ms < 60000) AS double_count,
  count(*) FILTER (is_target AND prev_is_target IS NOT NULL) AS target_total FROM gaps GROUP BY 1)
SELECT *, greatest(0.02 :: DOUBLE, least(0.35 :: DOUBLE, round((double_count + 1) / (target_total + 2), 3))) AS double_message_probability,
  round(tanh(target_total / 20.0 :: DOUBLE), 3) AS double_message_confidence FROM d"""
)
def double_messages(spark, sf):
    return rhythm.double_message_rate(_gaps(spark, sf), KEY)


_QUANT = """quant AS (SELECT chat_id, count(*) AS message_count, avg(CAST(second(ts) = 0 AS INT)) AS zero_second_share,
  count(*) > 5 AND avg(CAST(second(ts) = 0 AS INT)) > 0.7 AS is_minute_quantised FROM msg GROUP BY 1)"""


@query(f"WITH {sql_events(3)}, {_QUANT} SELECT * REPLACE (round(zero_second_share, 6) AS zero_second_share) FROM quant")
def minute_quantised(spark, sf):
    out = rhythm.minute_quantised(events(spark, sf, 3), KEY)
    return out.withColumn("zero_second_share", F.round("zero_second_share", 6))


def _at(p: str) -> str:
    return f"list_sort(list(latency_ms))[CAST(floor((count(*) - 1) * {p} :: DOUBLE) AS INT) + 1]"


@query(
    f"""WITH {_GAPS}, {_QUANT}, s AS (SELECT chat_id, count(*) AS sub_minute_count, {_at('0.5')} AS raw_median_ms, {_at('0.9')} AS raw_p90_ms
  FROM lat WHERE latency_ms < 60000 GROUP BY 1), n AS (SELECT chat_id, count(*) AS sample_size FROM lat GROUP BY 1),
j AS (SELECT chat_id, is_minute_quantised, coalesce(sample_size, 0) AS sample_size, coalesce(sub_minute_count, 0) AS sub_minute_count, raw_median_ms, raw_p90_ms,
  coalesce(sub_minute_count, 0) >= 3 AND NOT is_minute_quantised AS known FROM quant LEFT JOIN n USING (chat_id) LEFT JOIN s USING (chat_id))
SELECT * EXCLUDE (known), CASE WHEN known THEN greatest(2000, least(4000, raw_median_ms)) ELSE 2800 END AS median_ms,
  CASE WHEN known THEN greatest(4000, least(12000, raw_p90_ms)) ELSE 7500 END AS p90_ms, NOT known AS is_default FROM j"""
)
def latency_profile(spark, sf):
    m = events(spark, sf, 3)
    return rhythm.latency_profile(rhythm.reply_latency(_gaps(spark, sf)), rhythm.minute_quantised(m, KEY), KEY)


# The props of events are short, so a longer text stands for some replies.
_TEXT = "CASE seq % 3 WHEN 0 THEN content WHEN 1 THEN repeat(content, 4) ELSE repeat(content, 9) END"


@query(
    f"""WITH {_GAPS}, b AS (SELECT chat_id, latency_ms, CASE WHEN length({_TEXT}) <= 20 THEN 'short' WHEN length({_TEXT}) <= 60 THEN 'medium' ELSE 'long' END AS bucket FROM lat),
s AS (SELECT chat_id, bucket, count(*) AS sub, {_at('0.5')} AS m, {_at('0.9')} AS p FROM b WHERE latency_ms < 60000 GROUP BY ALL),
n AS (SELECT chat_id, bucket, count(*) AS sample_size, sum(count(*)) OVER (PARTITION BY chat_id) AS total FROM b GROUP BY 1, 2),
f AS (SELECT DISTINCT chat_id, total, x.bucket, lo, hi, d, lo9, hi9, d9 FROM n, (VALUES ('short', 1500, 3000, 2200, 3000, 6000, 4500),
  ('medium', 3000, 5500, 3800, 5000, 9000, 7000), ('long', 5000, 8000, 6200, 8000, 15000, 11000)) x(bucket, lo, hi, d, lo9, hi9, d9)),
j AS (SELECT f.*, coalesce(sample_size, 0) AS sample_size, coalesce(sub, 0) AS sub, m, p FROM f LEFT JOIN n USING (chat_id, bucket) LEFT JOIN s USING (chat_id, bucket))
SELECT chat_id, bucket, sample_size, CASE WHEN f.total >= 3 AND sample_size >= 3 THEN CASE WHEN sub >= 3 THEN greatest(lo, least(hi, m)) ELSE d END END AS median_ms,
  CASE WHEN f.total >= 3 AND sample_size >= 3 THEN CASE WHEN sub >= 3 THEN greatest(lo9, least(hi9, p)) ELSE d9 END END AS p90_ms,
  f.total >= 3 AND sample_size >= 3 AND sub < 3 AS is_default FROM j f"""
)
def latency_by_length(spark, sf):
    m = F.col("seq") % 3
    text = F.when(m == 0, F.col("content")).when(m == 1, F.repeat("content", 4)).otherwise(F.repeat("content", 9))
    return rhythm.latency_by_length(rhythm.reply_latency(_gaps(spark, sf)).withColumn("content", text), KEY)


@query(
    f"""SELECT p.*, d.* EXCLUDE (chat_id), {', '.join(f"{b}_{m}" for b in rhythm.BUCKETS for m in ('median_ms', 'p90_ms'))}
FROM ({REGISTRY['latency_profile'].sql}) p LEFT JOIN ({REGISTRY['double_messages'].sql}) d USING (chat_id)
LEFT JOIN (SELECT chat_id, {', '.join(f"max({m}) FILTER (bucket = '{b}') AS {b}_{m}" for b in rhythm.BUCKETS for m in ('median_ms', 'p90_ms'))}
  FROM ({REGISTRY['latency_by_length'].sql}) GROUP BY 1) l USING (chat_id)"""
)
def rhythm_table(spark, sf):
    m = F.col("seq") % 3
    text = F.when(m == 0, F.col("content")).when(m == 1, F.repeat("content", 4)).otherwise(F.repeat("content", 9))
    return rhythm.rhythm_table(events(spark, sf, 3).withColumn("content", text))


TAGS = [(["joking"], ["哈哈"]), (["agreement"], ["好的"]), (["tired_night", "tired_sleep"], ["晚安"]), (["asking"], ["怎么"])]
_TAGS = "list_concat(" + ", ".join(
    f"CASE WHEN regexp_matches(tagged, '(?i)({'|'.join(w)})') THEN {t} ELSE [] END" for t, w in TAGS
) + ")"
_EMOJI_RE = "[😂]|👍🏽?"
# Target texts of every chat, and the turns of its train part.
_ASSETS = f"""{_TURNS}, {SQL_SPLIT}, tx AS (SELECT chat_id, seq, content FROM chat WHERE is_target),
uses AS (SELECT chat_id, seq, content, unnest(regexp_extract_all(content, '{_EMOJI_RE}')) AS asset, generate_subscripts(regexp_extract_all(content, '{_EMOJI_RE}'), 1) AS nth FROM tx),
tt AS (SELECT chat_id, content, trim(array_to_string(list_transform(context, lambda c: c.content), ' ') || ' ' || content) AS tagged FROM split WHERE split = 'train'),
a1 AS (SELECT chat_id, content, tagged, unnest(regexp_extract_all(content, '{_EMOJI_RE}')) AS asset FROM tt),
a2 AS (SELECT chat_id, arg_min(content, (seq, nth)) AS content, arg_min(content, (seq, nth)) AS tagged, asset FROM uses
  WHERE (chat_id, asset) NOT IN (SELECT chat_id, asset FROM a1) GROUP BY chat_id, asset),
sight AS (SELECT *, CASE WHEN len({_TAGS}) > 0 THEN {_TAGS} ELSE ['casual_chat'] END AS tags,
  CASE WHEN content = asset THEN 'standalone' WHEN ends_with(content, asset) THEN 'suffix' WHEN starts_with(content, asset) THEN 'prefix' ELSE 'inline' END AS pos
  FROM (SELECT chat_id, content, tagged, asset FROM a1 UNION ALL SELECT chat_id, content, tagged, asset FROM a2))"""


def _tables(spark, sf):
    m = chat(spark, sf)
    texts = m.filter("is_target").withColumn("text", F.col("content"))
    return texts, turns.split_turns(turns.build_turns(m, ts=None)).filter("split = 'train'").drop("split")


@query(
    f"""WITH {_ASSETS}, t AS (SELECT chat_id, count(*) AS n FROM tx GROUP BY 1), u AS (SELECT chat_id, asset, count(*) AS raw_count FROM uses GROUP BY ALL)
SELECT chat_id, asset, raw_count, round(raw_count / n, 4) AS frequency,
  CAST(CASE WHEN raw_count <= 1 THEN 0.6 WHEN raw_count <= 3 THEN 0.75 WHEN raw_count <= 10 THEN 0.88 ELSE 0.95 END AS DOUBLE) AS confidence FROM u JOIN t USING (chat_id)"""
)
def emoji_frequency(spark, sf):
    texts, train = _tables(spark, sf)
    return assets.asset_frequency(texts, assets.asset_rows(texts, train, KEY)[0], KEY)


@query(
    f"""WITH {_ASSETS}, c AS (SELECT chat_id, asset, tag, count(*) AS "count" FROM (SELECT chat_id, asset, unnest(tags) AS tag FROM sight) GROUP BY ALL)
SELECT *, round("count" / sum("count") OVER (PARTITION BY chat_id, asset), 4) AS share FROM c"""
)
def emoji_contexts(spark, sf):
    texts, train = _tables(spark, sf)
    return assets.context_counts(assets.asset_rows(texts, train, KEY, rules=TAGS)[1], KEY)


@query(
    f"""WITH {_ASSETS} SELECT chat_id, asset, {', '.join(f"round(count(*) FILTER (pos = '{p}') / count(*), 4) AS {p}" for p in assets.POSITIONS)}
FROM sight GROUP BY ALL"""
)
def emoji_positions(spark, sf):
    texts, train = _tables(spark, sf)
    return assets.position_style(assets.asset_rows(texts, train, KEY, rules=TAGS)[1], KEY)


@query(
    f"""WITH {_ASSETS}, c AS (SELECT chat_id, asset, count(*) AS n, min(seq) AS f FROM uses GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, f, asset) AS k FROM c),
s AS (SELECT chat_id, CAST(sum(len(regexp_extract_all(content, '{_EMOJI_RE}'))) AS BIGINT) AS total_emojis, CAST(0 AS BIGINT) AS total_stickers,
  round(avg(CAST(regexp_matches(content, '{_EMOJI_RE}') AS INT)), 4) AS emoji_rate FROM tx GROUP BY 1)
SELECT s.*, coalesce(v.n, 0) AS emoji_vocabulary_size, v.characteristic FROM s LEFT JOIN (SELECT chat_id, count(*) AS n,
  string_agg(asset, ' ' ORDER BY k) FILTER (k <= 8) AS characteristic FROM r GROUP BY 1) v USING (chat_id)"""
)
def asset_summary(spark, sf):
    out = assets.asset_summary(_tables(spark, sf)[0], KEY)
    return out.withColumn("characteristic", F.array_join("characteristic", " "))


@query(
    f"""WITH {_ASSETS}, u AS (SELECT chat_id, asset, count(*) AS raw_count FROM uses GROUP BY ALL),
c AS (SELECT DISTINCT chat_id, asset, tag FROM (SELECT chat_id, asset, unnest(tags) AS tag FROM sight) WHERE tag <> 'casual_chat')
SELECT chat_id, tag, asset, raw_count, row_number() OVER (PARTITION BY chat_id, tag ORDER BY raw_count DESC, asset) AS rank
FROM c JOIN u USING (chat_id, asset) QUALIFY rank <= 3"""
)
def emoji_by_context(spark, sf):
    texts, train = _tables(spark, sf)
    return assets.emoji_by_context(assets.emoji_table(texts, train, KEY, rules=TAGS), KEY)


# As for emojis, of texts in which "ou" stands for a sticker.
_MARKED = "replace(content, 'ou', '[sticker:ou]')"
_STICKERS = (
    _ASSETS.replace(_EMOJI_RE, "(?i)\\[sticker[^\\]]*\\]")
    .replace("tx AS (SELECT chat_id, seq, content FROM chat", f"tx AS (SELECT chat_id, seq, {_MARKED} AS content FROM chat")
    .replace("FROM split WHERE split = 'train'", f"FROM (SELECT * REPLACE ({_MARKED} AS content) FROM split) WHERE split = 'train'")
)


@query(
    f"""WITH {_STICKERS}, t AS (SELECT chat_id, count(*) AS n FROM tx GROUP BY 1), u AS (SELECT chat_id, asset, count(*) AS raw_count FROM uses GROUP BY ALL),
c AS (SELECT chat_id, asset, tag, count(*) AS k FROM (SELECT chat_id, asset, unnest(tags) AS tag FROM sight) GROUP BY ALL),
s AS (SELECT *, CAST(round(10000 * round(k / sum(k) OVER (PARTITION BY chat_id, asset), 4)) AS BIGINT) AS share FROM c),
m AS (SELECT chat_id, asset, string_agg(tag || ':' || share, ' ' ORDER BY tag) AS contexts FROM s GROUP BY ALL)
SELECT chat_id, asset, raw_count, round(raw_count / n, 4) AS frequency,
  CAST(CASE WHEN raw_count <= 1 THEN 0.6 WHEN raw_count <= 3 THEN 0.75 WHEN raw_count <= 10 THEN 0.88 ELSE 0.95 END AS DOUBLE) AS confidence, contexts
FROM u JOIN t USING (chat_id) LEFT JOIN m USING (chat_id, asset)"""
)
def sticker_table(spark, sf):
    """The context distribution is shown as tag:share in ten-thousandths."""
    texts, train = _tables(spark, sf)
    mark = lambda c: F.replace(c, F.lit("ou"), F.lit("[sticker:ou]"))
    found = assets.sticker_table(texts.withColumn("text", mark("content")), train.withColumn("target_message", mark("target_message")), KEY, rules=TAGS)
    shares = F.transform(F.map_entries("context_distribution"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 10000).cast("long").cast("string")))
    return found.select("chat_id", "asset", "raw_count", "frequency", "confidence", F.array_join(F.array_sort(shares), " ").alias("contexts"))
