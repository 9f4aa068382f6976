"""Language fingerprint."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, TEXTS, chat, conversations, sql_trim
from colloquy.functions.segment import segmenter
from colloquy.operators import language
from colloquy.registry import REGISTRY, query

KEY = ["sender"]
# Words of the enlivened prose that stand for particles, phrases, openings and closings.
PARTICLES = ["哈哈", "好的", "喜欢", "le", "la", "de", "en", "th"]
PHRASES = {"laugh": "哈哈(?: \\w+)?", "good": "好的", "art": "\\b(?:les|des|the|die) \\w+", "asks": "怎么"}
OPENINGS = ["哈哈", "好的", "en", "th", "un", "a", "la"]
CLOSINGS = ["哈哈", "晚安", "en", "er", "th", "la"]
BASE = TEXTS.replace("WHERE is_target AND", "WHERE")
STOP = ["the", "la", "en", "de"]


def _texts(spark, sf):
    return language.base_texts(chat(spark, sf), target_only=False)


def _dist(source: str, value: str) -> str:
    return f"""SELECT sender, count(*) AS sample_size, min({value}) AS "min", max({value}) AS "max", round(avg({value}), 2) AS mean,
  round(quantile_cont({value}, 0.5), 2) AS median, round(quantile_cont({value}, 0.9), 2) AS p90, round(stddev_pop({value}), 2) AS std_dev
  FROM {source} GROUP BY sender"""


@query(f"WITH {BASE} {_dist('texts', 'length(content)')}")
def length_distribution(spark, sf):
    return language.length_distribution(_texts(spark, sf), KEY)


_SENT = f"""sent AS (SELECT sender, {sql_trim('s')} AS s FROM (SELECT sender, unnest(string_split_regex(content, '[。！？!?；;\\n]+')) AS s FROM texts)
  WHERE {sql_trim('s')} <> '')"""


@query(f"WITH {BASE}, {_SENT} {_dist('sent', 'length(s)')}")
def sentence_distribution(spark, sf):
    return language.sentence_distribution(_texts(spark, sf), KEY)


def _share(flag: str) -> str:
    return f"round(avg(CAST({flag} AS INT)), 4)"


def _like(pattern: str) -> str:
    return f"regexp_matches(content, '{pattern}')"


_TRIPLE = (
    "len(list_filter(range(1, greatest(length(content) - 1, 1)), lambda i: substr(content, i, 1) = substr(content, i + 1, 1)"
    " AND substr(content, i, 1) = substr(content, i + 2, 1) AND substr(content, i, 1) <> chr(10) AND length(content) >= 3)) > 0"
)


@query(
    f"""WITH {BASE} SELECT sender, count(*) AS sample_size, {_share(_like('[.]{2,}|…'))} AS ellipsis_rate, {_share(_like('[?？]'))} AS question_rate,
  {_share(_like('[!！]'))} AS exclamation_rate, {_share(_like('[~～]'))} AS tilde_rate, {_share(_like('[,，]'))} AS comma_rate,
  {_share(_like('[。.]'))} AS period_rate, {_share("contains(content, chr(10))")} AS line_break_rate, {_share(_TRIPLE)} AS repeated_char_rate,
  {_share("NOT " + _like('[。！？!?.~～…]$'))} AS terminal_punctuation_drop_rate FROM texts GROUP BY sender"""
)
def punctuation_rates(spark, sf):
    return language.punctuation_rates(_texts(spark, sf), KEY)


@query(
    f"""WITH {BASE} SELECT sender, {_share(_like('[A-Z]'))} AS capitalization_rate,
  {_share(_like('[一-龥]') + ' AND ' + _like('[a-zA-Z]'))} AS bilingual_mix_rate, {_share(_like('[0-9]'))} AS number_rate FROM texts GROUP BY sender"""
)
def habit_rates(spark, sf):
    return language.habit_rates(_texts(spark, sf), KEY)


@query(
    f"""WITH {BASE} SELECT sender, particle, count(*) FILTER (contains(content, particle)) AS messages
  FROM texts, (SELECT unnest({PARTICLES}) AS particle) GROUP BY ALL"""
)
def particle_counts(spark, sf):
    return language.particle_counts(_texts(spark, sf), KEY, PARTICLES)


@query(
    f"""WITH {BASE} SELECT sender, {_share('NOT contains(content, chr(10))')} AS single_line_rate, {_share('contains(content, chr(10))')} AS multi_line_rate,
  {_share("contains(content, chr(10)) AND regexp_matches(content, '(?m)^[•*0-9.-]')")} AS bullet_like_rate FROM texts GROUP BY sender"""
)
def structure_rates(spark, sf):
    return language.structure_rates(_texts(spark, sf), KEY)


def _top(rows: str, k: int) -> str:
    """Top k tokens of a (sender, token) query."""
    return f"""cnt AS (SELECT sender, token, count(*) AS n FROM ({rows}) GROUP BY ALL),
top AS (SELECT sender, token, n AS "count", row_number() OVER (PARTITION BY sender ORDER BY n DESC, token) AS rank FROM cnt QUALIFY rank <= {k})
SELECT * FROM top"""


_LETTERS = "|".join(c + "{3,}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "|(?:哈哈){2,}|(?:好的){2,}|(?:晚安){2,}|(?:喜欢){2,}|(?:怎么){2,}|哈{3,}"


@query(f"WITH {BASE}, {_top(f'''SELECT sender, unnest(regexp_extract_all(content, '{_LETTERS}')) AS token FROM texts''', 10)}")
def repetition_patterns(spark, sf):
    return language.repetition_patterns(_texts(spark, sf), KEY)


_TOKENS = """tok AS (SELECT sender, chat_id, seq, regexp_extract_all(lower(content), '[一-龥]|[\\p{Latin}\\p{N}'']+|[😂👍🏽]+') AS t FROM texts)"""


def _gram(n: int) -> str:
    parts = ["t[i]"]
    for k in range(1, n):
        parts.append(f"CASE WHEN regexp_matches(t[i + {k - 1}], '[一-龥]') AND regexp_matches(t[i + {k}], '[一-龥]') THEN '' ELSE ' ' END || t[i + {k}]")
    return f"SELECT sender, {' || '.join(parts)} AS token FROM (SELECT sender, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tok)"


@query(f"WITH {BASE}, {_TOKENS}, {_top(_gram(1) + f' WHERE t[i] NOT IN {tuple(STOP)}', 50)}")
def top_unigrams(spark, sf):
    return language.top_vocabulary(_texts(spark, sf), KEY, STOP)


# No word of this dictionary begins inside another, so the cheapest path is the leftmost match.
DICTIONARY = {"哈哈": 9.0, "好的": 5.0, "喜欢": 4.0, "晚安": 3.0, "怎么": 2.0, "今天": 2.0, "我们": 3.0}
_WORDS = _TOKENS.replace("'[一-龥]|", f"'{'|'.join(DICTIONARY)}|[一-龥]|")


@query(f"WITH {BASE}, {_WORDS}, {_top(_gram(1), 50)}")
def segmented_vocabulary(spark, sf):
    """Words by a dictionary instead of single CJK characters."""
    return language.top_vocabulary(_texts(spark, sf), KEY, [], segmenter(DICTIONARY))


@query(f"WITH {BASE}, {_TOKENS} SELECT sender, count(DISTINCT token) AS unique_words FROM ({_gram(1)}) GROUP BY 1")
def unique_words(spark, sf):
    return language.unique_words(_texts(spark, sf), KEY)


@query(f"WITH {BASE}, {_TOKENS}, {_top(_gram(2), 30)}")
def top_bigrams(spark, sf):
    return language.top_bigrams(_texts(spark, sf), KEY)


@query(f"WITH {BASE}, {_TOKENS}, {_top(_gram(3), 20)}")
def top_trigrams(spark, sf):
    return language.top_trigrams(_texts(spark, sf), KEY)


_FOUND = "[" + ", ".join(f"regexp_extract(content, '(?i)({p})', 1)" for p in PHRASES.values()) + "]"
_PHRASES = f"SELECT sender, token FROM (SELECT sender, unnest({_FOUND}) AS token FROM texts) WHERE token <> ''"


@query(f"WITH {BASE}, {_top(_PHRASES, 10)}")
def pattern_phrases(spark, sf):
    return language.pattern_phrases(_texts(spark, sf), KEY, PHRASES, stopwords=[])


_REPEATED = "SELECT sender, s AS token FROM (SELECT *, count(*) OVER (PARTITION BY sender, s) AS c FROM sent) WHERE length(s) BETWEEN 2 AND 12 AND c >= 2"


@query(f"WITH {BASE}, {_SENT}, {_top(_REPEATED, 5)}")
def repeated_sentences(spark, sf):
    return language.repeated_sentences(_texts(spark, sf), KEY, stopwords=[])


def _named(name: str, rows: str, k: int) -> str:
    return f"""{name} AS (SELECT sender, token, row_number() OVER (PARTITION BY sender ORDER BY n DESC, token) AS rank
  FROM (SELECT sender, token, count(*) AS n FROM ({rows}) GROUP BY ALL) QUALIFY rank <= {k})"""


_FREQUENT = f"SELECT sender, token FROM (SELECT *, count(*) OVER (PARTITION BY sender, token) AS c FROM ({_gram(2)})) WHERE c >= 2 AND length(token) BETWEEN 2 AND 15"


@query(
    f"""WITH {BASE}, {_SENT}, {_TOKENS}, {_named('a', _PHRASES, 10)}, {_named('b', _REPEATED, 5)}, {_named('c', _FREQUENT, 5)},
u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)
SELECT sender, token AS phrase, source, rank FROM u WHERE length(token) BETWEEN 2 AND 15
QUALIFY row_number() OVER (PARTITION BY sender, token ORDER BY source, rank) = 1"""
)
def catchphrases(spark, sf):
    return language.catchphrases(_texts(spark, sf), KEY, PHRASES, [])


_OPEN, _CLOSE = "|".join(OPENINGS), "|".join(CLOSINGS)


@query(
    f"""WITH {CHAT}, f AS (SELECT sender, arg_min(content, seq) AS token FROM chat WHERE is_target AND length(content) BETWEEN 1 AND 25
  GROUP BY chat_id, session_no, sender), {_top(f'''SELECT * FROM f WHERE length(token) <= 20 AND regexp_matches(token, '(?i)^(?:{_OPEN})')''', 8)}"""
)
def openers(spark, sf):
    return language.openers(chat(spark, sf), KEY, ["chat_id", "session_no"], words=OPENINGS)


@query(
    f"""WITH {CHAT}, f AS (SELECT * FROM chat QUALIFY row_number() OVER (PARTITION BY chat_id, session_no ORDER BY seq DESC) = 1),
{_top(f'''SELECT sender, content AS token FROM f WHERE is_target AND length(content) BETWEEN 1 AND 20 AND regexp_matches(content, '(?i)(?:{_CLOSE})')''', 8)}"""
)
def closers(spark, sf):
    return language.closers(chat(spark, sf), KEY, ["chat_id", "session_no"], words=CLOSINGS)


def _metric(name: str, column: str, sql: str) -> str:
    return f"""SELECT sender, '{name}' AS metric, CAST("{column}" AS DOUBLE) AS value FROM ({sql})"""


def _list(name: str, sql: str) -> str:
    return f"""SELECT sender, '{name}.' || rank || '.' || token, CAST("count" AS DOUBLE) FROM ({sql})"""


_STATS = ["sample_size", "min", "max", "mean", "median", "p90", "std_dev"]
_PARTS = {"unique_words": REGISTRY["unique_words"].sql}
_PARTS |= dict.fromkeys(["sample_size", *language.PUNCTUATION_RATES, "terminal_punctuation_drop_rate"], REGISTRY["punctuation_rates"].sql)
_PARTS |= dict.fromkeys(["capitalization_rate", "bilingual_mix_rate", "number_rate"], REGISTRY["habit_rates"].sql)
_PARTS |= dict.fromkeys(["single_line_rate", "multi_line_rate", "bullet_like_rate"], REGISTRY["structure_rates"].sql)
_PARTS["overall_particle_rate"] = f"WITH {BASE} SELECT sender, {_share(_like('|'.join(PARTICLES)))} AS overall_particle_rate FROM texts GROUP BY 1"
_LISTS = {"repetitions": "repetition_patterns", "top_vocabulary": "top_unigrams", "top_bigrams": "top_bigrams", "top_trigrams": "top_trigrams", "openers": "openers", "closers": "closers"}


@query(
    " UNION ALL ".join([
        *[_metric(f"{name}.{c}", c, REGISTRY[q].sql) for name, q in (("message_length", "length_distribution"), ("sentence_length", "sentence_distribution")) for c in _STATS],
        *[_metric(c, c, sql) for c, sql in _PARTS.items()],
        *[_list(name, REGISTRY[q].sql.replace("WHERE is_target AND", "WHERE")) for name, q in _LISTS.items()],
        f"""SELECT sender, 'catchphrases.' || k || '.' || phrase, CAST(k AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY source, rank) AS k FROM ({REGISTRY['catchphrases'].sql}))""",
    ])
)
def fingerprint(spark, sf):
    """All of the above in one table, every speaker being a target."""
    m = chat(spark, sf).withColumn("is_target", F.lit(True))
    out = language.fingerprint(
        m, KEY, ["chat_id", "session_no"], particles=PARTICLES, phrases=PHRASES, stopwords=STOP, phrase_stopwords=[], openings=OPENINGS, closings=CLOSINGS
    )
    return language.metric_rows(out, KEY)
