"""Live messages, session state and cleaned replies, on finite tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, chat, conversations, events, table
from colloquy.functions import replies
from colloquy.registry import query
from colloquy.streaming import live, state

GAP, CAP = 1800, 5400
INTENTS = {
    "apology": ["la "], "crisis": ["ungen"], "demand": ["eaux"], "confession": ["ntion"], "complaint": ["que"], "provocation": ["ver"], "affection": ["喜欢"],
    "question": ["\\?", "怎么"], "tease": ["哈哈"], "sincere": ["好的"], "attachment": ["des"],
}


def _stream(spark, sf):
    """Events of shared chats; sign-ups are commands."""
    e = events(spark, sf, 7)
    text = F.when(F.col("sender") == "signup", "/start now").when(F.col("sender") == "error", "  ").otherwise(F.concat(F.lit(" "), "content"))
    return e.select(
        "chat_id", F.col("seq").alias("message_id"), "user_id", "ts", text.alias("text"),
        F.when(F.col("seq") % 4 == 0, F.col("seq") - 1).alias("reply_to_id"),
    )


# Gap and command rules split a chat into runs; the cap is a recursion over the messages of a chat.
_BURSTS = f"""RECURSIVE m AS (SELECT user_id % 7 AS chat_id, event_id AS id, ts, event_type = 'signup' AS cmd, CASE WHEN event_type = 'error' THEN '' ELSE props END AS body,
  CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS reply_to_id,
  row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT chat_id, k, id, ts, cmd, body, reply_to_id, id AS first, ts AS t0, cmd AS closed FROM m WHERE k = 1
  UNION ALL SELECT n.chat_id, n.k, n.id, n.ts, n.cmd, n.body, n.reply_to_id, CASE WHEN fresh THEN n.id ELSE first END, CASE WHEN fresh THEN n.ts ELSE t0 END,
    n.cmd OR (NOT fresh AND n.ts - t0 >= INTERVAL {CAP} SECOND)
  FROM (SELECT m.*, b.first, b.t0, b.closed OR m.cmd OR m.ts - b.ts >= INTERVAL {GAP} SECOND AS fresh FROM b JOIN m ON m.chat_id = b.chat_id AND m.k = b.k + 1) n),
placed AS (SELECT * FROM b WHERE NOT cmd)"""


@query(f"WITH {_BURSTS} SELECT id AS message_id, first AS burst_id FROM placed")
def burst_starts(spark, sf):
    placed = live.burst_starts(_stream(spark, sf), command=live.is_command("text"), window=GAP, cap=CAP)
    return placed.select("message_id", "burst_id")


@query(
    f"""WITH {_BURSTS} SELECT chat_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, string_agg(body, chr(10) ORDER BY ts, id) FILTER (body <> '') AS text,
  count(*) FILTER (body <> '') AS message_count, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id FROM placed GROUP BY chat_id, first HAVING count(*) FILTER (body <> '') > 0"""
)
def bursts(spark, sf):
    out = live.bursts(_stream(spark, sf), GAP, CAP)
    return out.select(
        "chat_id", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("burst_end").alias("end_us"), "text", "message_count", "first_id", "last_id"
    )


@query("SELECT event_type = 'signup' AS is_command, count(*) AS messages FROM events GROUP BY 1")
def split_commands(spark, sf):
    commands, rest = live.split_commands(_stream(spark, sf))
    both = commands.withColumn("is_command", F.lit(True)).unionByName(rest.withColumn("is_command", F.lit(False)))
    return both.groupBy("is_command").agg(F.count(F.lit(1)).alias("messages"))


@query("SELECT user_id AS chat_id, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 10")
def working_memory(spark, sf):
    m = events(spark, sf).withColumnRenamed("seq", "message_id")
    return state.working_memory(m, ["chat_id"], ["ts", "message_id"]).select("chat_id", "message_id", "rank")


@query("SELECT user_id AS chat_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS message_count FROM events GROUP BY 1")
def session_counters(spark, sf):
    m = events(spark, sf).withColumnRenamed("seq", "message_id")
    out = state.session_counters(m.unionByName(m), ["chat_id"])
    return out.select("chat_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "message_count")


def _on(name: str) -> str:
    return f"regexp_matches(t, '(?i)({'|'.join(INTENTS[name])})')"


_PERCEIVED = f"""{CHAT}, l AS (SELECT chat_id, seq, lower(content) AS t FROM chat), o AS (SELECT *, {', '.join(f'{_on(n)} AS o_{n}' for n in INTENTS)} FROM l),
per AS (SELECT *, CASE WHEN o_crisis THEN 'emotional_crisis' WHEN o_demand THEN 'demand' WHEN o_confession THEN 'confession' WHEN o_affection THEN 'affection' WHEN o_provocation THEN 'provocation'
  WHEN o_complaint THEN 'complaint' WHEN o_apology THEN 'apology' WHEN o_question THEN 'question' WHEN o_tease THEN 'tease' WHEN length(t) <= 3 THEN 'short_ack' ELSE 'chat' END AS intent FROM o)"""


@query(
    f"""WITH {_PERCEIVED} SELECT chat_id, seq, intent,
  CAST(CASE WHEN o_crisis THEN -0.6 WHEN o_demand THEN -0.2 WHEN o_confession THEN 0.7 WHEN o_affection THEN 0.8 WHEN o_provocation THEN -0.85 WHEN o_complaint THEN -0.45 WHEN o_apology THEN 0.2 ELSE 0.1 END AS DOUBLE) AS sentiment,
  CAST(CASE WHEN o_crisis THEN 0.9 WHEN o_demand THEN 0.6 WHEN o_confession THEN 0.7 WHEN o_provocation THEN 0.8 WHEN o_complaint THEN 0.55 ELSE 0.1 END AS DOUBLE) AS pressure,
  CAST(CASE WHEN o_crisis OR o_demand THEN 0 WHEN o_confession OR o_affection THEN 0.85 WHEN o_complaint AND o_attachment THEN 0.35 ELSE 0 END AS DOUBLE) AS affection,
  CAST(CASE WHEN NOT (o_crisis OR o_demand OR o_confession) AND o_tease THEN 0.7 ELSE 0 END AS DOUBLE) AS humor,
  CAST(CASE WHEN o_crisis THEN 0.95 WHEN o_demand THEN 0.6 WHEN o_confession THEN 0.8 WHEN o_provocation THEN 0.85 WHEN intent = 'question' THEN 0.5 WHEN intent = 'short_ack' THEN 0.2 ELSE 0.3 END AS DOUBLE) AS importance,
  CAST(CASE WHEN o_apology THEN CASE WHEN o_sincere THEN 0.92 ELSE 0.75 END ELSE 0 END AS DOUBLE) AS apology_strength FROM per"""
)
def perceived(spark, sf):
    return chat(spark, sf).select("chat_id", "seq", state.perceive("content", INTENTS).alias("p")).select("chat_id", "seq", "p.*")


_STARTS = "('what', 'why', 'where', 'when', 'who', 'which', 'how', 'is', 'are', 'can', 'could', 'would', 'will', 'do', 'does', 'did')"
_ASKS = "[?？]|吗|嘛|呢|啥|什么|怎么|如何|哪里|几点|谁"
_QUESTION = f"(content <> '' AND (regexp_matches(content, '{_ASKS}') OR trim(string_split_regex(lower(content), '\\s+')[1], '!.,;:') IN {_STARTS}))"


@query(f"WITH {CHAT} SELECT chat_id, seq FROM chat WHERE {_QUESTION}")
def questions(spark, sf):
    return chat(spark, sf).filter(live.is_question("content")).select("chat_id", "seq")


_PUNCT = "translate({x}, '?？!！。，,.~… ' || chr(9) || chr(10) || chr(13) || '/\\-+=', repeat(' ', 19))"
_STOPS = "('吗', '嘛', '呢', '吧', '呀', '啊', '啥', '什么', '怎么', '你', '我', '的', '了', 'what', 'why', 'where', 'when', 'who', 'which', 'how', 'is', 'are', 'the', 'a', 'an', 'to', 'do', 'does', 'did', 'can', 'could', 'would')"
_SCORE = f"""(3 * len(list_filter(string_split_regex(q, '\\s+'), lambda w: strlen(w) >= 3 AND w NOT IN {_STOPS} AND contains(r, w)))
  + 3 * len(list_filter(list_transform(range(1, length(tight)), lambda i: substr(tight, i, 2)), lambda w: w NOT IN {_STOPS} AND contains(r, w)))
  + len(list_filter(list_transform(range(1, length(tight) + 1), lambda i: substr(tight, i, 1)), lambda w: w NOT IN {_STOPS} AND contains(r, w))))"""
# The questions of a turn and the whole next turn as the reply.
_LINK = f"""{CHAT}, qs AS (SELECT chat_id, seq // 1000 AS turn, seq AS id, content FROM chat WHERE {_QUESTION}),
rp AS (SELECT chat_id, seq // 1000 - 1 AS turn, string_agg(content, ' ' ORDER BY seq) AS reply FROM chat GROUP BY ALL),
qr AS (SELECT chat_id, turn, id, lower({_PUNCT.format(x='content')}) AS q, lower({_PUNCT.format(x='reply')}) AS r FROM qs JOIN rp USING (chat_id, turn)),
qz AS (SELECT *, replace(q, ' ', '') AS tight FROM qr), sc AS (SELECT *, {_SCORE} AS score FROM qz),
lk AS (SELECT chat_id, turn, arg_max(id, (score, -id)) AS answered_id, count(*) AS n, max(score) AS top FROM sc GROUP BY ALL),
linked AS (SELECT chat_id, turn, answered_id FROM lk WHERE n >= 2 AND top >= 3 AND (SELECT count(*) FROM sc WHERE sc.chat_id = lk.chat_id AND sc.turn = lk.turn AND score = top) = 1)"""


def _asked(spark, sf):
    c = chat(spark, sf).select("chat_id", F.floor(F.col("seq") / 1000).alias("turn"), F.col("seq").alias("message_id"), F.col("content").alias("text"))
    said = F.array_sort(F.collect_list(F.struct("message_id", "text")))  # the sentences of one message
    reply = c.groupBy("chat_id", (F.col("turn") - 1).alias("turn")).agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("reply"))
    return c, reply


@query(f"WITH {_LINK} SELECT * FROM linked")
def link_answer(spark, sf):
    c, reply = _asked(spark, sf)
    return live.link_answer(c.filter(live.is_question("text")), reply, ["chat_id", "turn"])


@query(
    f"""WITH {_LINK}, b AS (SELECT chat_id, seq // 1000 AS turn, min(seq) FILTER (seq % 37 = 0) AS quoted FROM chat GROUP BY ALL)
SELECT b.chat_id, b.turn, coalesce(CASE WHEN b.turn % 5 = 1 AND rp.reply IS NOT NULL THEN CAST(7 AS BIGINT) END, quoted, answered_id, 0) AS quote_id FROM b LEFT JOIN linked USING (chat_id, turn) LEFT JOIN rp USING (chat_id, turn)"""
)
def quote_target(spark, sf):
    c, reply = _asked(spark, sf)
    c = c.withColumns({"reply_to_id": F.when(F.col("message_id") % 37 == 0, 1), "ts": F.col("message_id")})
    reply = reply.withColumn("explicit_id", F.when(F.col("turn") % 5 == 1, F.lit(7).cast("long")))
    return live.quote_target(c, reply, ["chat_id", "turn"])


@query("SELECT event_id AS message_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def allow_list(spark, sf):
    users = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return live.allow_list(_stream(spark, sf), users).select("message_id")


_XOR = {"inner": bytes(b ^ 0x36 for b in b"pepper".ljust(64, b"\0")).hex(), "outer": bytes(b ^ 0x5C for b in b"pepper".ljust(64, b"\0")).hex()}


@query(
    f"""SELECT DISTINCT user_id, 'user_' || substr(sha256(unhex('{_XOR['outer']}') || unhex(sha256(unhex('{_XOR['inner']}') || encode(CAST(user_id AS VARCHAR))))), 1, 12) AS pseudonym FROM events"""
)
def pseudonyms(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", live.pseudonymise("user_id", "pepper").alias("pseudonym"))


def _raw_replies(spark, sf):
    """Turns wrapped the way models answer."""
    c = conversations(spark, sf)
    one = F.regexp_replace(F.col("content"), "\n", " ")
    k = F.col("chat_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>so <think>x</think> and</think>"), one))
        .when(k == 1, F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.lit("").alias("candidate_a"), one.alias("reply"))), F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("# Title\nuser: hi\n"), one, F.lit("\n[image]\nlast..")))
        .when(k == 3, F.concat(F.lit('Assistant: “"'), one, F.lit('"”')))
        .when(k == 4, F.concat(one, F.lit("\nAs an AI I cannot.")))
        .otherwise(F.concat(F.lit("plan</think>[Bot] 答：「"), one, F.lit("」")))
    )
    return c.select("chat_id", "seq", raw.alias("raw"))


_ONE = "trim(replace(content, chr(10), ' '))"
_CUT = f"regexp_replace({_ONE}, '[.]+$', '')"


@query(
    f"""WITH m AS (SELECT conv_id AS chat_id, turn AS seq, text AS content FROM conversations)
SELECT chat_id, seq, CASE chat_id % 6 WHEN 2 THEN {_ONE} || ' last' WHEN 4 THEN '' ELSE {_CUT} END AS reply FROM m"""
)
def clean_replies(spark, sf):
    rows = _raw_replies(spark, sf)
    out = rows.select("chat_id", "seq", replies.clean_reply("raw").alias("reply"))
    # The disclaimer has no full stop of its own before it, so the whole line goes.
    return out


@query("SELECT conv_id AS chat_id, turn AS seq, conv_id % 6 = 4 AS marked FROM conversations")
def ai_markers(spark, sf):
    return _raw_replies(spark, sf).select("chat_id", "seq", replies.ai_marker("raw").alias("marked"))


@query("""SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events""")
def lenient_json(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 4
    raw = (
        F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("well "), "props", F.lit(" ok"))).otherwise(F.concat(F.lit("<think>{</think>["), "props", F.lit("] x")))
    )
    v = replies.parse_json_lenient(raw)
    return e.select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "long"), F.try_variant_get(v, "$[0].k", "long")).alias("k"))
