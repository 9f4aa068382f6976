"""Message tables made from the given tables, with the same tables in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import SPACES, trim

# Makes marks, CJK and emojis occur in the invented prose: applied in this order on both sides.
LIVELY = [
    ("le ", "哈哈 "), ("the ", "好的 "), ("und ", "喜欢 "), (" la ", " 😂 "), ("ing", "👍🏽"), ("tion", "~"), (", ", "? "),
    ("ich", "晚安"), (" de ", " 怎么 "), ("ent", "ttt"), (" der ", "\n"), (" of", "..."), ("est", "1!"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lively(c: Column) -> Column:
    for old, new in LIVELY:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """One message per turn; replies of the assistant are the target."""
    t = table(spark, sf, "conversations")
    return t.select(
        F.col("conv_id").alias("chat_id"), F.lit(1).cast("long").alias("session_no"), F.col("turn").alias("seq"),
        F.col("role").alias("sender"), F.col("text").alias("content"), (F.col("role") == "assistant").alias("is_target"),
    )


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """One message per sentence, four turns to a session, enlivened."""
    t = table(spark, sf, "conversations")
    parts = t.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "s"))
    return parts.filter(trim("s") != "").select(
        F.col("conv_id").alias("chat_id"),
        (F.floor(F.col("turn") / 4) + 1).alias("session_no"),
        (F.col("turn") * 1000 + F.col("pos")).alias("seq"),
        F.col("role").alias("sender"),
        trim(lively(trim("s"))).alias("content"),
        (F.col("role") == "assistant").alias("is_target"),
    )


def events(spark: SparkSession, sf: str, chats: int | None = None) -> DataFrame:
    """Events as messages of their user, or of ``chats`` shared chats."""
    e = table(spark, sf, "events")
    who = F.col("user_id") if chats is None else F.col("user_id") % chats
    return e.select(
        who.alias("chat_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("sender"), F.col("props").alias("content"), F.col("event_type").isin("click", "view").alias("is_target"),
        "value", "user_id",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """A target message with its context and the next target message of the chat as candidate."""
    from colloquy.operators.turns import build_turns
    from colloquy.plans.ordered import scan

    turns = build_turns(chat(spark, sf), ts=None, numbered=False).select("chat_id", "seq", "context", "target_message")
    paired = scan(turns, ["chat_id"], ["seq"], lead={"candidate": F.col("target_message")})
    return paired.filter(F.col("candidate").isNotNull()).select(
        (F.col("chat_id") * 1_000_000 + F.col("seq")).alias("sample_id"), F.col("chat_id").cast("string").alias("speaker"),
        "context", F.col("target_message").alias("target"), "candidate",
    )


def sql_trim(x: str) -> str:
    return f"trim({x}, " + "||".join(f"chr({ord(c)})" for c in SPACES) + ")"


def sql_lively(x: str) -> str:
    for old, new in LIVELY:
        old, new = old.replace("\n", "' || chr(10) || '"), new.replace("\n", "' || chr(10) || '")
        x = f"replace({x}, '{old}', '{new}')"
    return x


CONVERSATIONS = """msg AS (SELECT conv_id AS chat_id, CAST(1 AS BIGINT) AS session_no, turn AS seq, role AS sender,
  text AS content, role = 'assistant' AS is_target FROM conversations)"""
CHAT = f"""piece AS (SELECT conv_id, turn, role, unnest(p) AS s, unnest(range(len(p))) AS pos
  FROM (SELECT *, string_split_regex(text, '[.\\n]+') AS p FROM conversations)),
chat AS (SELECT conv_id AS chat_id, turn // 4 + 1 AS session_no, turn * 1000 + pos AS seq, role AS sender,
  {sql_trim(sql_lively(sql_trim('s')))} AS content, role = 'assistant' AS is_target FROM piece WHERE {sql_trim('s')} <> '')"""
TEXTS = CHAT + """,
texts AS (SELECT * REPLACE (regexp_replace(content, '([一-龥])\\s+([一-龥])', '\\1\\2', 'g') AS content), content AS raw
  FROM chat WHERE is_target AND content <> '')"""


def sql_events(chats: int | None = None) -> str:
    who = "user_id" if chats is None else f"user_id % {chats}"
    return f"""msg AS (SELECT {who} AS chat_id, event_id AS seq, ts, event_type AS sender, props AS content,
  event_type IN ('click', 'view') AS is_target, value, user_id FROM events)"""


def sql_turns(source: str, size: int = 5) -> str:
    """Turns of a message CTE: context as a list of structs, numbered per session."""
    return f"""ctx AS (SELECT *, list({{'sender': sender, 'content': content}}) OVER (PARTITION BY chat_id, session_no ORDER BY seq
  ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS context FROM {source}),
turns AS (SELECT *, row_number() OVER (PARTITION BY chat_id, session_no ORDER BY seq) AS turn_no
  FROM ctx WHERE is_target AND len(context) > 0 AND {sql_trim('content')} <> '')"""


SAMPLES = f"""{CHAT}, {sql_turns('chat')},
lead_rows AS (SELECT *, lead(content) OVER (PARTITION BY chat_id ORDER BY seq) AS candidate FROM turns),
samples AS (SELECT chat_id * 1000000 + seq AS sample_id, CAST(chat_id AS VARCHAR) AS speaker, context, content AS target, candidate,
  array_to_string(list_transform(context, lambda c: c.content), ' ') AS ctx FROM lead_rows WHERE candidate IS NOT NULL)"""


# The split of ``turns``: whole sessions from three on, else the turns in order.
SQL_SPLIT = """sess AS (SELECT chat_id, session_no, count(*) AS n FROM turns GROUP BY ALL),
sess_at AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY session_no) AS place, count(*) OVER (PARTITION BY chat_id) AS ns,
  sum(n) OVER (PARTITION BY chat_id) AS nt, sum(n) OVER (PARTITION BY chat_id ORDER BY session_no) - n AS before FROM sess),
sess_v AS (SELECT *, greatest(1, floor(ns * 0.15 :: DOUBLE)) AS v0, greatest(1, floor(ns * (1 - 0.7 :: DOUBLE - 0.15 :: DOUBLE))) AS t0 FROM sess_at),
sess_w AS (SELECT *, CASE WHEN v0 + t0 >= ns THEN 1 ELSE v0 END AS nv, CASE WHEN v0 + t0 >= ns THEN 1 ELSE t0 END AS nx FROM sess_v),
split AS (SELECT t.*, CASE WHEN ns >= 3 THEN CASE WHEN place <= greatest(1, ns - nv - nx) THEN 'train'
    WHEN place <= greatest(1, ns - nv - nx) + nv THEN 'validation' ELSE 'test' END
  ELSE CASE WHEN before + turn_no <= greatest(1, floor(nt * 0.7 :: DOUBLE)) THEN 'train'
    WHEN before + turn_no <= greatest(1, floor(nt * 0.7 :: DOUBLE)) + floor(nt * 0.15 :: DOUBLE) THEN 'validation' ELSE 'test' END END AS split
  FROM turns t JOIN sess_w USING (chat_id, session_no))"""
