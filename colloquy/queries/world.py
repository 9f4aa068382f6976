"""Facts, entities, timeline, exemplars."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, chat, events, lively, sql_lively, sql_trim, sql_turns, table
from colloquy.functions.text import trim
from colloquy.operators import exemplars, facts, turns
from colloquy.registry import query

CATEGORIES = {"school": ["ung", "que"], "place": ["la", "les"], "hobby": ["the", "哈哈"]}


def _case(x: str, rules: dict[str, list[str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i)({'|'.join(w)})') THEN '{n}'" for n, w in rules.items()) + f" ELSE {other} END"


@query(f"WITH {CHAT} SELECT chat_id, seq, {_case('content', CATEGORIES)} AS category FROM chat WHERE category IS NOT NULL")
def fact_tags(spark, sf):
    return facts.tag_facts(chat(spark, sf), categories=CATEGORIES).select("chat_id", "seq", "category")


# Lines of documents as notes: the first letter decides heading, 'key: value' or plain text.
_NOTES = """nl AS (SELECT doc_id AS chat_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
nn AS (SELECT *, CASE WHEN line_no % 5 = 1 THEN '# 关系 ' || s WHEN line_no % 5 = 2 THEN '地点' || substr(s, 1, 4) || '：' || substr(s, 5)
  WHEN line_no % 5 = 3 THEN '时间: ' || s ELSE s END AS line FROM nl),
nt AS (SELECT chat_id, line_no, trim(line, chr(32) || chr(9) || chr(13)) AS line FROM nn),
ns AS (SELECT *, last_value(CASE WHEN starts_with(line, '#') THEN regexp_replace(line, '^#+\\s*', '') END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY line_no) AS section,
  CASE WHEN instr(line, ':') > 0 THEN instr(line, ':') ELSE instr(line, '：') END AS sep FROM nt WHERE line <> ''),
notes AS (SELECT chat_id, line_no, coalesce(section, 'General') AS section, CASE WHEN sep > 0 THEN trim(substr(line, 1, sep - 1)) ELSE 'note' END AS key,
  CASE WHEN sep > 0 THEN trim(substr(line, sep + 1)) ELSE line END AS value FROM ns WHERE NOT starts_with(line, '#'))"""


def _notes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chat_id"), F.posexplode(F.split("text", "\n")).alias("p", "s"))
    n, s = F.col("line_no"), F.col("s")
    line = (
        F.when(n % 5 == 1, F.concat(F.lit("# 关系 "), s))
        .when(n % 5 == 2, F.concat(F.lit("地点"), F.substring(s, 1, 4), F.lit("："), F.expr("substring(s, 5)")))
        .when(n % 5 == 3, F.concat(F.lit("时间: "), s))
        .otherwise(s)
    )
    lines = d.select("chat_id", (F.col("p") + 1).cast("long").alias("line_no"), "s").withColumn("line", line)
    return facts.parse_notes(lines, "chat_id", "line_no")


@query(f"WITH {_NOTES} SELECT * FROM notes")
def parse_notes(spark, sf):
    return _notes(spark, sf)


_SLUG = "'entity_' || regexp_replace(lower(key), '[^a-z0-9]', '_', 'g')"
_PLACE = "regexp_matches(key || '|' || section, '学校|地区|国家|World|Environment|地点|校区')"


@query(
    f"""WITH {_NOTES} SELECT chat_id, line_no, {_SLUG} AS entity_id, CASE WHEN {_PLACE} THEN CASE WHEN value <> '' THEN value ELSE key END ELSE key END AS name,
  CASE WHEN {_PLACE} THEN 'location' ELSE 'concept' END AS type, CASE WHEN {_PLACE} THEN section || ': ' || key || ' - ' || value ELSE value END AS description FROM notes"""
)
def classified_notes(spark, sf):
    return facts.classify_notes(_notes(spark, sf)).select("chat_id", F.col("order.at").alias("line_no"), "entity_id", "name", "type", "description")


@query(
    f"""WITH {_NOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY line_no) AS k FROM notes WHERE regexp_matches(key, '时间|认识|事件|入学|体测'))
SELECT chat_id, 'evt_ctx_' || (k + 2) AS event_id, key AS title, value AS description FROM n"""
)
def timeline_notes(spark, sf):
    return facts.timeline_notes(_notes(spark, sf)).select("chat_id", "event_id", "title", "description")


@query(f"WITH {CHAT} SELECT DISTINCT chat_id, 'entity_' || sender AS entity_id, sender AS name, 'person' AS type FROM chat")
def participant_entities(spark, sf):
    return facts.participant_entities(chat(spark, sf)).select("chat_id", "entity_id", "name", "type")


_FIRST = f"""{CHAT}, sp AS (SELECT chat_id, sender, min(seq) AS f FROM chat GROUP BY ALL), sr AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY f) AS k FROM sp),
pr AS (SELECT a.chat_id, a.sender AS a, b.sender AS b FROM sr a LEFT JOIN sr b ON a.chat_id = b.chat_id AND b.k = 2 WHERE a.k = 1)"""


@query(
    f"""WITH {_NOTES}, {_FIRST} SELECT chat_id, a AS source_entity, 'interacts_with' AS relation, b AS target_entity, 'ongoing' AS temporal_state FROM pr WHERE b IS NOT NULL
UNION ALL SELECT n.chat_id, coalesce(a, 'User'), CASE WHEN value <> '' THEN value ELSE key END, coalesce(b, 'Target'), 'defined_in_context' FROM notes n LEFT JOIN pr USING (chat_id)
WHERE regexp_matches(key, '关系|加|认识') OR regexp_matches(section, '关系')"""
)
def participant_relations(spark, sf):
    out = facts.participant_relations(chat(spark, sf), _notes(spark, sf))
    return out.select("chat_id", "source_entity", "relation", "target_entity", "temporal_state")


_BOUNDS = """SELECT user_id AS chat_id, 'evt_first_chat' AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS at, 'First message initiated by ' || arg_min(event_type, event_id) AS description FROM events GROUP BY 1
UNION ALL SELECT user_id, 'evt_latest_chat', strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), 'Latest interaction recorded' FROM events GROUP BY 1"""


@query(_BOUNDS)
def timeline_bounds(spark, sf):
    out = facts.timeline_bounds(events(spark, sf))
    return out.select("chat_id", "event_id", F.date_format(F.col("date_or_period").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "description")


# Sources of documents as entities told by their texts, some of them by a supplied source.
_ENTITIES = """en AS (SELECT doc_id % 10 AS chat_id, doc_id AS ord, upper(substr(source, 1, 1)) || substr(source, 2) || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END AS name, lang AS type,
  text AS description, CASE WHEN doc_id % 97 = 0 THEN 'supplied_context' ELSE 'historical_conversation' END AS source FROM documents)"""


def _entities(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    name = F.concat(F.upper(F.substring("source", 1, 1)), F.expr("substring(source, 2)"), F.when(k % 3 == 0, " ").otherwise(""))
    return d.select(
        (k % 10).alias("chat_id"), k.alias("order"), name.alias("name"), F.col("lang").alias("type"), F.col("text").alias("description"),
        F.when(k % 97 == 0, "supplied_context").otherwise("historical_conversation").alias("source"),
    )


_MERGED = f"""{_ENTITIES}, k AS (SELECT *, lower(trim(name)) AS kk FROM en),
a AS (SELECT chat_id, kk, arg_min(name, ord) AS name, arg_min(type, ord) AS type, CASE WHEN count(*) FILTER (source = 'supplied_context') > 0 THEN 'supplied_context' ELSE arg_min(source, ord) END AS source FROM k GROUP BY ALL),
b AS (SELECT chat_id, kk, description FROM k QUALIFY row_number() OVER (PARTITION BY chat_id, kk ORDER BY length(description) DESC, ord) = 1),
merged AS (SELECT chat_id, name, type, description, source FROM a JOIN b USING (chat_id, kk))"""


@query(f"WITH {_MERGED} SELECT * FROM merged")
def merge_entities(spark, sf):
    return facts.merge_entities(_entities(spark, sf), ["chat_id"]).select("chat_id", "name", "type", "description", "source")


@query(
    """SELECT user_id % 10 AS chat_id, arg_min(event_id, event_id) AS event_id FROM events
GROUP BY 1, lower(event_type), user_id % 7"""
)
def merge_relations(spark, sf):
    e = events(spark, sf).select(
        (F.col("user_id") % 10).alias("chat_id"), F.col("sender").alias("source_entity"), F.lit("").alias("relation"),
        (F.col("user_id") % 7).cast("string").alias("target_entity"), F.col("seq").alias("order"),
    )
    return facts.merge_relations(e, ["chat_id"]).select("chat_id", F.col("order").alias("event_id"))


@query("SELECT user_id % 10 AS chat_id, min(event_id) AS event_id FROM events GROUP BY 1, CAST(ts AS DATE), event_type")
def merge_timeline(spark, sf):
    e = events(spark, sf).select(
        (F.col("user_id") % 10).alias("chat_id"), F.date_format("ts", "yyyy-MM-dd").alias("date_or_period"), F.col("sender").alias("title"),
        F.col("seq").alias("order"),
    )
    return facts.merge_timeline(e, ["chat_id"]).select("chat_id", F.col("order").alias("event_id"))


@query(
    f"""WITH {_MERGED} SELECT chat_id, source, count(*) AS "rows", 'entities' AS "table" FROM merged GROUP BY ALL
UNION ALL SELECT user_id % 10, 'historical_conversation', 2 * count(DISTINCT user_id), 'timeline' FROM events GROUP BY 1"""
)
def provenance_counts(spark, sf):
    timeline = facts.timeline_bounds(events(spark, sf)).withColumn("chat_id", F.col("chat_id") % 10)
    return facts.provenance_counts(["chat_id"], entities=facts.merge_entities(_entities(spark, sf), ["chat_id"]), timeline=timeline)


@query(
    """WITH n AS (SELECT user_id % 3 AS chat_id, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events),
c AS (SELECT *, (k - 1) // 15 AS chunk_no, CAST(ceil(n / 15) AS BIGINT) AS chunks FROM n)
SELECT chat_id, event_id, chunk_no FROM c WHERE chunks <= 6 OR chunk_no <= 1 OR chunk_no IN (chunks // 2 - 1, chunks // 2) OR chunk_no >= chunks - 2"""
)
def positional_sample(spark, sf):
    out = facts.positional_sample(events(spark, sf, 3), ["chat_id"])
    return out.select("chat_id", F.col("seq").alias("event_id"), "chunk_no")


@query(
    f"""WITH {_MERGED}, f AS (SELECT user_id % 10 AS chat_id, strftime(min(ts), '%Y-%m-%d') AS first_ts FROM events GROUP BY 1),
t AS (SELECT user_id % 10 AS chat_id, event_type AS title, CAST(ts AS DATE) AS d FROM events GROUP BY ALL)
SELECT chat_id, 'L1' AS layer, title AS key, title || ': ' || title AS value, CAST(CASE title WHEN 'error' THEN 0.95 WHEN 'purchase' THEN 0.85 WHEN 'signup' THEN 0.7 ELSE 0.55 END AS DOUBLE) AS importance_score,
  strftime(d, '%Y-%m-%d') AS valid_from, CAST(NULL AS DOUBLE) AS confidence, 'exact_or_period' AS temporal_precision FROM t
UNION ALL SELECT chat_id, 'L2', 'entity_' || name, description, NULL, first_ts, 0.75, 'inferred_from_session' FROM merged JOIN f USING (chat_id)"""
)
def memory_seed(spark, sf):
    e = events(spark, sf).withColumn("chat_id", F.col("user_id") % 10)
    level = F.when(F.col("sender") == "error", "critical").when(F.col("sender") == "purchase", "high").when(F.col("sender") == "signup", "medium")
    timeline = facts.merge_timeline(
        e.select("chat_id", F.date_format("ts", "yyyy-MM-dd").alias("date_or_period"), F.col("sender").alias("title"), F.col("sender").alias("description"),
                 F.lit("historical_conversation").alias("provenance"), F.col("seq").cast("string").alias("event_id"), level.alias("significance"), F.col("seq").alias("order")),
        ["chat_id"],
    )
    entities = facts.merge_entities(_entities(spark, sf), ["chat_id"]).withColumn("entity_id", F.col("name"))
    first = e.groupBy("chat_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_ts"))
    return facts.memory_seed(timeline, entities, first).select(
        "chat_id", "layer", "key", "value", "importance_score", "valid_from", "confidence", "temporal_precision"
    )


_PHASE = _case("c || ' ' || t", {
    "banter": ["哈哈", "233", "逗", "笑死"], "agreement": ["好(?:呀|的|吧|嘞)", "收到"], "greeting": ["早(?:呀|安)?", "晚安", "hi", "hello"],
    "affection": ["爱", "喜欢", "想你"],
}, "'casual_sharing'")
_BAD = "[，。！？?!~～、:：]"
# A lively talk of short messages: three words of a text each, said by two in turn.
_SHORT = f"""said AS (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS w FROM conversations),
bit AS (SELECT conv_id, turn, k, array_to_string(w[3 * k + 1:3 * k + 3], ' ') AS s FROM said, unnest(range(0, CAST(ceil(len(w) / 3) AS BIGINT))) AS u(k)),
chat AS (SELECT conv_id AS chat_id, turn + 1 AS session_no, turn * 1000 + k AS seq, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END AS sender,
  {sql_trim(sql_lively('s'))} AS content, k % 2 = 1 AS is_target FROM bit WHERE {sql_trim('s')} <> '')"""
_PAIRS = f"""{_SHORT}, {sql_turns('chat')},
b AS (SELECT chat_id, seq, content AS t, list_reverse(context) AS r FROM turns),
c0 AS (SELECT *, r[1].sender AS who, coalesce(list_position(list_transform(r, lambda m: m.sender <> r[1].sender), TRUE), 0) AS p FROM b WHERE r[1].sender <> 'assistant'),
c1 AS (SELECT *, array_to_string(list_transform(list_reverse(CASE WHEN p > 0 THEN r[1:p - 1] ELSE r END), lambda m: m.content), chr(10)) AS c FROM c0),
pairs AS (SELECT chat_id, seq, who AS counterpart_sender, c AS counterpart_text, t AS target_text, {_PHASE} AS phase FROM c1 WHERE length(t) BETWEEN 2 AND 35 AND length(c) BETWEEN 2 AND 35 AND lower(t) <> lower(c)
  AND NOT regexp_matches(t, '^{_BAD}') AND NOT regexp_matches(c, '^{_BAD}') AND NOT (length(c) <= 3 AND regexp_matches(c, '[?？]')) AND who <> 'system')"""


def _exemplars(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", F.split(F.trim("text"), r"\s+"))
    bits = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 3).cast("int") - 1), lambda k: F.array_join(F.slice("w", k * 3 + 1, F.lit(3)), " "))
    short = c.select("conv_id", "turn", F.posexplode(bits).alias("k", "s")).filter(trim("s") != "").select(
        F.col("conv_id").alias("chat_id"), (F.col("turn") + 1).alias("session_no"), (F.col("turn") * 1000 + F.col("k")).alias("seq"),
        F.when(F.col("k") % 2 == 0, "user").otherwise("assistant").alias("sender"), trim(lively(F.col("s"))).alias("content"), (F.col("k") % 2 == 1).alias("is_target"),
    )
    return exemplars.exemplar_pairs(turns.build_turns(short, ts=None).withColumn("part", F.col("chat_id") % 4), ["chat_id", "part"])


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def exemplar_pairs(spark, sf):
    return _exemplars(spark, sf).drop("part")


_SLOT = """CASE WHEN phase = 'greeting' AND n = 1 THEN 0 WHEN phase = 'banter' AND n = 1 THEN 1 WHEN phase = 'agreement' AND n = 1 THEN 2 WHEN phase = 'affection' AND n = 1 THEN 3
  WHEN phase = 'casual_sharing' AND n = 1 THEN 4 WHEN phase = 'banter' AND n = 2 THEN 5 ELSE 6 END"""


@query(
    f"""WITH {_PAIRS}, o AS (SELECT chat_id % 4 AS part, chat_id * 1000000 + seq AS pos, phase, row_number() OVER (PARTITION BY chat_id % 4, phase ORDER BY chat_id * 1000000 + seq) AS n FROM pairs)
SELECT part, pos, phase, row_number() OVER (PARTITION BY part ORDER BY {_SLOT}, pos) AS rank FROM o QUALIFY rank <= 6"""
)
def select_exemplars(spark, sf):
    pairs = _exemplars(spark, sf).withColumn("pos", F.col("chat_id") * 1_000_000 + F.col("seq"))
    return exemplars.select_exemplars(pairs, ["part"], "pos").select("part", "pos", "phase", "rank")
