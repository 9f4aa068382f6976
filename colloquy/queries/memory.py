"""Memory tables and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, chat, events, sql_trim, table
from colloquy.operators import checks
from colloquy.operators import memory as mem
from colloquy.plans import lineage
from colloquy.registry import query
from colloquy.streaming import tables

NOW = "2024-02-01 00:00:00"
PREFIXES = [("好的", "preference", "likes"), ("the ", "profile", "location"), ("la", "profile", "name")]


def _memories(spark, sf):
    """Events as memories of their user; the kind of event is the key."""
    e = events(spark, sf)
    kind = F.col("sender")
    layer = F.when(kind == "view", "L1").when(kind.isin("click", "error"), "L2").when(kind == "purchase", "L3").otherwise("L0")
    return e.select(
        F.col("seq").alias("id"), F.col("user_id").alias("persona_id"), layer.alias("layer"), F.lit("event").alias("category"), kind.alias("key"),
        F.concat(kind, F.lit(" "), "content").alias("value"), (F.col("value") % 1).alias("importance_score"), F.col("ts").alias("valid_from"),
        (F.col("seq") % 10 / 10).alias("confidence"), F.col("ts").alias("created_at"),
    )


_MEM = """mem AS (SELECT event_id AS id, user_id AS persona_id, CASE WHEN event_type = 'view' THEN 'L1' WHEN event_type IN ('click', 'error') THEN 'L2' WHEN event_type = 'purchase' THEN 'L3' ELSE 'L0' END AS layer,
  'event' AS category, event_type AS key, event_type || ' ' || props AS value, value % 1 AS importance_score, ts AS valid_from, event_id % 10 / 10 AS confidence, ts AS created_at FROM events),
ver AS (SELECT *, lead(valid_from) OVER (PARTITION BY persona_id, key ORDER BY valid_from, id) AS valid_to FROM mem)"""


def _versions(spark, sf):
    return mem.supersede(_memories(spark, sf), ["persona_id", "key"])


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'pre_fix' ELSE lower(event_type) || ':' || CASE WHEN event_id % 3 = 1 THEN 'my_key' ELSE 'k' END END AS key FROM events"""
    .replace("'pre_fix'", "lower(event_type) || '_x'")
)
def memory_keys(spark, sf):
    k = F.col("seq") % 3
    raw = F.when(k == 0, F.concat(F.upper("sender"), F.lit(" X "))).when(k == 1, F.lit(" My Key")).otherwise("K")
    return events(spark, sf).select(F.col("seq").alias("event_id"), mem.memory_key(F.upper("sender"), raw).alias("key"))


def _rule(prefix: str) -> str:
    rest = sql_trim(f"substr(content, instr(content, '{prefix}') + {len(prefix)})")
    value = sql_trim(f"regexp_extract({rest}, '^[^，,。！!~\\n]*')")
    return f"CASE WHEN instr(content, '{prefix}') > 0 AND strlen({value}) BETWEEN 2 AND 50 THEN '{prefix} ' || {value} END"


@query(
    f"""WITH {CHAT}, v AS (SELECT chat_id, seq, {', '.join(f'{_rule(p)} AS v{i}' for i, (p, _, _) in enumerate(PREFIXES))} FROM chat)
SELECT chat_id, seq, CASE WHEN v0 IS NOT NULL THEN 'preference:likes' WHEN v1 IS NOT NULL THEN 'profile:location' ELSE 'profile:name' END AS key, coalesce(v0, v1, v2) AS value FROM v
WHERE coalesce(v0, v1, v2) IS NOT NULL"""
)
def fact_candidates(spark, sf):
    return mem.fact_candidates(chat(spark, sf).withColumnRenamed("content", "text"), prefixes=PREFIXES).select("chat_id", "seq", "key", "value")


@query(
    """SELECT event_id, 'note:' || event_type AS key, 'seen ' || event_type AS value, CAST(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.7 END AS DOUBLE) AS importance_score,
  CAST(0.85 AS DOUBLE) AS confidence FROM events WHERE event_type <> 'error'"""
)
def parse_memory_json(spark, sf):
    e = events(spark, sf)
    value = F.when(F.col("sender") == "error", "a Recall of it").otherwise(F.concat(F.lit("seen "), "sender"))
    body = F.to_json(
        F.struct(F.array(F.struct(F.lit("note").alias("category"), F.col("sender").alias("key"), value.alias("value"),
                                  F.when(F.col("seq") % 2 == 0, 0.5).alias("importance_score")), F.struct(
            F.lit("note").alias("category"), F.lit("").alias("key"), F.lit("dropped").alias("value"), F.lit(0.5).alias("importance_score"))).alias("memories"))
    )
    raw = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nbye"))
    return mem.parse_memory_json(e.select(F.col("seq").alias("event_id"), raw.alias("raw"))).select(
        "event_id", "key", "value", "importance_score", "confidence"
    )


@query(f"WITH {_MEM} SELECT id, epoch_us(valid_to) AS valid_to_us FROM ver")
def memory_versions(spark, sf):
    return _versions(spark, sf).select("id", F.unix_micros("valid_to").alias("valid_to_us"))


@query(f"WITH {_MEM} SELECT id, epoch_us(valid_to) AS valid_to_us FROM ver WHERE valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20 00:00:00'")
def supersede_active(spark, sf):
    """Versions known by the 20th stay active until later arrivals close them."""
    m = _memories(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    known = mem.supersede(m.filter(F.col("valid_from") <= cut), ["persona_id", "key"]).filter("valid_to is null").drop("valid_to")
    out = mem.supersede_active(known.withColumn("valid_to", F.lit(None).cast("timestamp")), m.filter(F.col("valid_from") > cut), ["persona_id", "key"])
    return out.select("id", F.unix_micros("valid_to").alias("valid_to_us"))


@query(
    """SELECT user_id AS id, arg_min(event_type, event_id) AS category, arg_max(value, event_id) AS importance_score FROM events GROUP BY 1"""
)
def upsert_memories(spark, sf):
    e = events(spark, sf).select(
        F.col("user_id").alias("id"), F.col("sender").alias("category"), F.col("content").alias("value"), F.col("value").alias("importance_score"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("seq").alias("version"),
    )
    firsts = e.groupBy("id").agg(F.min("version").alias("version"))
    stored = e.join(firsts, ["id", "version"], "left_semi").drop("version")
    return mem.upsert_memories(stored, e).select("id", "category", "importance_score")


@query(f"WITH {_MEM} SELECT persona_id, count(*) AS active FROM ver WHERE valid_to IS NULL AND layer = 'L2' GROUP BY 1")
def active_facts(spark, sf):
    rows = mem.active_facts(mem.query_memories(_versions(spark, sf), layer="L2"))
    return rows.groupBy("persona_id").agg(F.count(F.lit(1)).alias("active"))


_WORDS = "list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')"
_SCORED = f"""{_MEM}, q AS (SELECT DISTINCT user_id AS query_id, user_id AS persona_id, 'click view "k": ' || (user_id % 100) || '}}' AS query FROM events),
sc AS (SELECT query_id, layer, id, least(1, len(list_filter({_WORDS}, lambda w: strlen(w) > 1 AND contains(lower(value), w))) / len({_WORDS})) * 0.4 :: DOUBLE + importance_score * 0.25 :: DOUBLE
  + greatest(0.05 :: DOUBLE, exp((epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400000000.0 :: DOUBLE * (-0.6931471805599453 :: DOUBLE / 30))) * 0.15 :: DOUBLE + confidence * 0.2 :: DOUBLE AS score
  FROM q JOIN ver USING (persona_id) WHERE layer = 'L1' OR (layer = 'L2' AND valid_to IS NULL))"""


@query(
    f"""WITH {_SCORED} SELECT query_id, layer, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, id) AS rank FROM sc
QUALIFY rank <= CASE layer WHEN 'L1' THEN 5 ELSE 10 END"""
)
def memory_retrieve(spark, sf):
    q = events(spark, sf).select(F.col("user_id").alias("query_id"), F.col("user_id").alias("persona_id")).distinct()
    q = q.withColumn("query", F.concat(F.lit('click view "k": '), (F.col("persona_id") % 100).cast("string"), F.lit("}")))
    out = mem.retrieve_topk(q, _versions(spark, sf), F.lit(NOW).cast("timestamp"))
    return out.select("query_id", "layer", "id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_MEM} SELECT id FROM mem WHERE NOT (layer = 'L0' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AND NOT (importance_score < 0.35 AND layer <> 'L3')"""
)
def memory_compact(spark, sf):
    return mem.compact_memories(_memories(spark, sf), F.lit(NOW).cast("timestamp")).select("id")


@query(f"WITH {_MEM} SELECT layer, count(*) AS entries FROM mem GROUP BY 1")
def layer_counts(spark, sf):
    return mem.layer_counts(_memories(spark, sf))


@query("SELECT (SELECT count(*) FROM events) AS memories, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS messages")
def store_stats(spark, sf):
    return mem.store_stats(_memories(spark, sf), table(spark, sf, "conversations"), ["conv_id"])


@query(
    """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations QUALIFY k <= 4)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM r"""
)
def recent_messages(spark, sf):
    return mem.recent_messages(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 4)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def recent_logs(spark, sf):
    return mem.recent_logs(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 50)


_FACTORS = {10: 0.30, 7: 0.15, 9: 0.15, 8: 0.15, 6: 0.15, 5: 0.10}


@query(f"SELECT event_id, floor(({' + '.join(f'(event_id % {k}) * {w} :: DOUBLE' for k, w in _FACTORS.items())}) * 1000 + 0.5) / 1000 AS importance FROM events")
def importance6(spark, sf):
    score = mem.importance6([F.col("event_id") % k for k in _FACTORS])
    return table(spark, sf, "events").select("event_id", (F.floor(score * 1000 + 0.5) / 1000).alias("importance"))


_RULES = [("required", "quality", "quality IS NOT NULL"), ("range", "quality", "quality BETWEEN 1 AND 5"), ("enum", "toxic", "toxic IN (0)"),
          ("pattern", "doc_id", "regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]*[02468]$')")]


@query(
    " UNION ALL ".join(f"""SELECT doc_id, '{c}' AS "column", '{r}' AS rule, CAST({c} AS VARCHAR) AS value FROM labels WHERE NOT coalesce({ok}, TRUE)""" for r, c, ok in _RULES)
)
def table_checks(spark, sf):
    rules = [
        checks.required("quality"), checks.in_range("quality", 1, 5), checks.one_of("toxic", [0]), checks.matches("doc_id", "^[0-9]*[02468]\\z"),
        checks.castable("quality", "int"),
    ]
    return checks.check_table(table(spark, sf, "labels"), "doc_id", rules)


@query("SELECT c AS component FROM (SELECT unnest(['view', 'click', 'error', 'style', 'rhythm']) AS c) WHERE c NOT IN (SELECT event_type FROM events)")
def missing_components(spark, sf):
    present = table(spark, sf, "events").select(F.col("event_type").alias("component")).distinct()
    return checks.missing_components(present, ["view", "click", "error", "style", "rhythm"])


@query(f"WITH {_MEM} SELECT id, persona_id, key, value, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us FROM ver")
def stream_facts(spark, sf):
    """Three micro-batches, the second one twice, the third one late throughout: as if all versions had come at once."""
    folder = lineage.scratch(spark)
    write = tables.write_batch(folder, facts=lambda batch: batch.drop("nth"))
    rows = _memories(spark, sf).withColumn("nth", F.when(F.col("id") % 10 == 3, 2).otherwise(F.col("id") % 2))
    for nth in (0, 1, 1, 2):
        write(rows.filter(F.col("nth") == nth), nth)
    return tables.current_facts(spark, folder).select(
        "id", "persona_id", "key", "value", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us")
    )


@query(f"WITH {_MEM} SELECT id, persona_id, key FROM ver WHERE valid_to IS NULL")
def stream_active(spark, sf):
    """The active table after two batches, the older versions last."""
    folder = lineage.scratch(spark)
    write = tables.write_batch(folder, facts=lambda batch: batch)
    rows = _memories(spark, sf)
    write(rows.filter("id % 3 > 0"), 0)
    write(rows.filter("id % 3 = 0"), 1)
    return tables.active_table(spark, folder).select("id", "persona_id", "key")
