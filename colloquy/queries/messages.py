"""Cleaning, sources, speakers, sessions, turns, splits, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.frames import CHAT, CONVERSATIONS, SQL_SPLIT, chat, conversations, events, sql_events, sql_trim, sql_turns, table
from colloquy.functions import clean
from colloquy.operators import leakage, normalize, turns
from colloquy.plans import lineage, ordered
from colloquy.registry import query
from colloquy.sources import sinks, transcripts

DAY = 86_400
MEDIA = r"(?i)\[(?:image|photo|sticker|voice|audio|video|file|location|contact)\]"
# Texts with the marks the cleaners look for.
MARKED = [("was ", "[image] "), ("was", "[image]"), (" and ", "\n### 2026-05-27 head\n"), (" is ", "\n# Title x\n"), ("ou ", "x​y "),
          ("ver ", "   [sticker] "), (" es", "  \n  ")]


def _marked(c):
    for old, new in MARKED:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _sql_marked(x):
    for old, new in MARKED:
        for ch in ("\n", "​"):
            new = new.replace(ch, f"' || chr({ord(ch)}) || '")
        x = f"replace({x}, '{old}', '{new}')"
    return x


_START = sql_trim(f"regexp_replace({_sql_marked('text')}, '[​-‍﻿]', '', 'g')")
_NO_HEADERS = (
    "regexp_replace(regexp_replace(regexp_replace(x0, '(?:^|\\n)#{1,6}\\s*\\[?\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}[^\\n]*', '', 'g'),"
    " '(?:^|\\n)#{1,6}\\s+[^\\n]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
)
_MEDIA_GONE = f"regexp_replace(x1, '{MEDIA}', ' ', 'g')"
for _p, _r in (("[ \\t]{2,}", "' '"), ("\\n[ \\t]+", "chr(10)"), ("[ \\t]+\\n", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
    _MEDIA_GONE = f"regexp_replace({_MEDIA_GONE}, '{_p}', {_r}, 'g')"
_BAD_LINE = "(?i)^#{1,6}\\s+|^#{1,6}\\s*\\[?\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}\\s*$|joined the group|left the group|pinned a message"
CLEANED = f"""c0 AS (SELECT doc_id, {_sql_marked('text')} AS raw, {_START} AS x0 FROM documents),
c1 AS (SELECT *, {sql_trim(_NO_HEADERS)} AS x1 FROM c0),
c2 AS (SELECT *, {sql_trim(_MEDIA_GONE)} AS x2 FROM c1),
c3 AS (SELECT *, array_to_string(list_filter(list_transform(string_split(x2, chr(10)), lambda s: {sql_trim('s')}),
  lambda s: s <> '' AND NOT regexp_matches(s, '{_BAD_LINE}')), chr(10)) AS cleaned,
  {sql_trim(f"regexp_replace(x1, '{MEDIA}', '', 'g')")} = '' AND x1 <> '' AS is_only FROM c2)"""


@query(f"WITH {CLEANED} SELECT doc_id, cleaned, md5(x1) AS no_headers, x2 AS no_media FROM c3")
def clean_messages(spark, sf):
    raw = _marked(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    body = clean.strip_md_headers(clean.strip_invisible("raw"))
    return d.select(
        "doc_id", clean.clean_message("raw").alias("cleaned"), F.md5(body).alias("no_headers"),
        clean.strip_media_text(body).alias("no_media"),
    )


_KIND = f"CASE WHEN regexp_matches(x1, '(?i)\\[(image|photo)\\]') THEN 'image' WHEN regexp_matches(x1, '(?i)\\[sticker\\]') THEN 'sticker' END"


@query(
    f"""WITH {CLEANED} SELECT doc_id, CASE WHEN is_only THEN coalesce({_KIND}, 'image') ELSE coalesce({_KIND}, 'text') END AS media_type,
  is_only AS is_media_only, FALSE AS is_system, CASE WHEN is_only THEN '' ELSE cleaned END AS content,
  x0 = '' OR regexp_matches(x0, '(?i)(?:^|\\n)#{{1,6}}\\s+|###\\s*\\[?\\d{{4}}|{MEDIA[4:]}') AS polluted,
  CASE WHEN raw = '' THEN 'text' WHEN contains(lower(raw), '[sticker]') THEN 'sticker'
    WHEN regexp_matches(raw, '(?i)\\[(image|photo)\\]') THEN 'image' ELSE 'text' END AS detected
  FROM c3"""
)
def sanitized_messages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _marked(F.col("text")).alias("raw"))
    rows = d.select(
        "doc_id", clean.sanitize_message("raw").alias("m"), clean.is_polluted("raw").alias("polluted"),
        clean.detect_media_type("raw").alias("detected"),
    )
    return rows.select("doc_id", "m.*", "polluted", "detected")


_SENDER = """CASE conv_id % 4 WHEN 0 THEN '[2026-05-14 10:22:15] ' || role WHEN 1 THEN '10:22 ' || role WHEN 2 THEN 'System' ELSE '' END"""


@query(
    f"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 2 THEN 'System' WHEN 3 THEN 'Unknown' ELSE role END AS sender,
  (CASE conv_id % 4 WHEN 2 THEN TRUE ELSE conv_id % 4 < 2 AND lower(role) = 'system' END) AS is_system,
  conv_id % 2 = 0 AS is_header, CASE WHEN conv_id % 2 = 0 THEN '2026-05-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') END AS header_date,
  conv_id % 3 = 0 AS is_notice, conv_id % 3 = 1 AS is_announcement FROM conversations"""
)
def senders_and_headers(spark, sf):
    m = F.col("conv_id")
    role = F.col("role")
    raw = F.when(m % 4 == 0, F.concat(F.lit("[2026-05-14 10:22:15] "), role)).when(
        m % 4 == 1, F.concat(F.lit("10:22 "), role)
    ).when(m % 4 == 2, "System").otherwise("")
    line = F.concat(
        F.when(m % 2 == 0, "## [").otherwise("see ["), F.lit("2026-05-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit("] Monday")
    )
    text = F.when(m % 3 == 0, F.concat(role, F.lit(" joined the group"))).when(
        m % 3 == 1, F.concat(F.lit("群公告：" ), role)
    ).otherwise(role)
    t = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"), line.alias("line"), text.alias("t"))
    name = clean.clean_sender("raw")
    return t.select(
        "conv_id", "turn", name.alias("sender"), clean.is_system_sender(name).alias("is_system"),
        clean.is_date_header("line").alias("is_header"), clean.date_from_header("line").alias("header_date"),
        clean.is_system_notice("t").alias("is_notice"), clean.is_group_announcement("t").alias("is_announcement"),
    )


def _transcript(spark, sf, heads):
    """Lines of a transcript per conversation: a head line per turn, further lines of its text after it."""
    t = table(spark, sf, "conversations")
    parts = t.select(
        F.col("conv_id").cast("string").alias("chat_id"), (F.floor(F.col("turn") / 3) * 1000).alias("block"), "turn", "role",
        F.posexplode(F.split("text", "\n")).alias("pos", "s"),
    )
    head = F.concat(heads, F.col("s"))
    return parts.select(
        "chat_id", "block", (F.col("turn") * 1000 + F.col("pos")).alias("place"),
        F.when(F.col("pos") == 0, head).otherwise(F.col("s")).alias("line"),
    )


_LINES = """SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn, role,
  array_to_string(list_filter(string_split(text, chr(10)), lambda s: s <> ''), chr(10)) AS content FROM conversations"""


@query(
    f"""SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS line_no, role AS sender, content,
  CASE WHEN turn % 2 = 0 THEN 1715682120 + 60 * turn END AS epoch FROM ({_LINES})"""
)
def transcript_text(spark, sf):
    minute = F.lpad((F.col("turn") + 22).cast("string"), 2, "0")
    heads = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2024-05-14 10:"), minute, F.lit(":00 "), "role", F.lit(": "))).otherwise(
        F.concat("role", F.lit("："))
    )
    rows = transcripts.text_messages(_transcript(spark, sf, heads))
    return rows.select("chat_id", "line_no", "sender", "content", F.unix_timestamp("ts").alias("epoch"))


@query(
    f"""WITH t AS (SELECT *, 1715682120 + 3600 * turn AS given FROM ({_LINES}))
SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS line_no, 'sp_' || role AS sender, content,
  CASE WHEN turn % 3 = 0 THEN given ELSE 1715682120 + 3600 * (turn - turn % 3) + 60 * (turn % 3) END AS epoch FROM t"""
)
def transcript_markdown(spark, sf):
    role = F.concat(F.lit("sp_"), "role")
    hour = F.lpad((F.col("turn") + 10).cast("string"), 2, "0")
    heads = F.when(
        F.col("turn") % 3 == 0, F.concat(F.lit("**"), role, F.lit("** (2024-05-14 "), hour, F.lit(":22:00): "))
    ).when(F.col("turn") % 3 == 1, F.concat(F.lit("- "), role, F.lit(": "))).otherwise(F.concat(F.lit("> "), role, F.lit(": ")))
    rows = transcripts.markdown_messages(_transcript(spark, sf, heads).filter("line <> ''"))
    return rows.select("chat_id", "line_no", "sender", "content", F.unix_timestamp("ts").alias("epoch"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'tg_' || turn AS id, role AS sender, text AS content,
  CASE WHEN turn > 0 THEN 'tg_' || (turn - 1) END AS reply_to_id FROM conversations WHERE turn % 5 <> 4"""
)
def chat_export_json(spark, sf):
    t = table(spark, sf, "conversations")
    text = F.when(
        F.col("turn") % 2 == 0, F.to_variant_object(F.array(F.struct(F.col("text").alias("text"))))
    ).otherwise(F.col("text").cast("variant"))
    item = F.struct(
        F.col("turn").alias("id"), F.when(F.col("turn") % 5 == 4, "service").otherwise("message").alias("type"),
        F.lit("2024-05-14T10:22:00").alias("date"), F.col("role").alias("from"), text.alias("text"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("reply_to_message_id"),
    )
    # One export object per conversation.
    docs = t.groupBy(F.col("conv_id").cast("string").alias("chat_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(item).alias("j")))).alias("a"))
    body = F.concat(F.lit('{"messages":['), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]}"))
    return transcripts.export_messages(docs.select("chat_id", F.try_parse_json(body).alias("v"))).select(
        "chat_id", "id", "sender", "content", "reply_to_id"
    )


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS line_no, role AS sender, text AS content,
  1715682135 + turn AS epoch FROM conversations"""
)
def chat_json_rows(spark, sf):
    t = table(spark, sf, "conversations")
    odd = F.to_json(F.struct(F.col("role").alias("author"), F.col("text").alias("body"), (F.col("turn") + 1715682135).alias("date")))
    even = F.to_json(
        F.struct(
            F.struct(F.col("role").alias("name")).alias("user"), F.col("text").alias("message"),
            F.date_format(F.timestamp_seconds(F.col("turn") + 1715682135), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        )
    )
    lines = t.select(
        F.col("conv_id").cast("string").alias("chat_id"), F.floor(F.col("turn") / 2).alias("block"), F.col("turn").alias("place"),
        F.when(F.col("turn") % 2 == 0, even).otherwise(odd).alias("line"),
    )
    return transcripts.row_messages(transcripts.json_lines(lines)).select(
        "chat_id", "line_no", "sender", "content", F.unix_timestamp("ts").alias("epoch")
    )


@query(
    """SELECT CAST(page_id AS VARCHAR) AS chat_id, k AS line_no, CASE WHEN k < 3 THEN 'lang ' || substr(html, 33, 2) ELSE 'Bob' END AS sender,
  CASE k WHEN 1 THEN url WHEN 2 THEN 'again ' || url ELSE 'last' END AS content FROM pages, (SELECT unnest([1, 2, 3]) AS k)"""
)
def html_messages(spark, sf):
    p = table(spark, sf, "pages")
    block = F.concat(
        F.lit('<div class="message"><div class="from_name">lang '), F.substring("html", 33, 2), F.lit('</div><div class="text">'),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('</div></div><div class="message joined"><div class="text">again '),
        F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit('</div></div><div class="message"><div class="from_name">Bob</div><div class="text">last</div></div>'),
    )
    pages = p.select("page_id", F.concat("html", block).alias("html"))
    return transcripts.extract_messages_html(pages).select("chat_id", "line_no", "sender", "content")


@query(
    """SELECT event_id, epoch(date_trunc('second', ts)) :: BIGINT AS epoch FROM events"""
)
def parse_timestamps(spark, sf):
    e = events(spark, sf)
    k = F.col("seq") % 5
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy/M/d H:m:s"))
        .when(k == 1, F.date_format("ts", "d.M.yyyy HH:mm:ss"))
        .when(k == 2, F.unix_timestamp("ts").cast("string"))
        .when(k == 3, F.unix_millis(F.date_trunc("second", "ts")).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return e.select(F.col("seq").alias("event_id"), F.unix_timestamp(normalize.parse_timestamp(text)).alias("epoch"))


@query(
    f"""SELECT * FROM (SELECT conv_id AS chat_id, turn AS line_no,
  'msg_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 6, '0') AS id,
  role AS sender, 'text' AS media_type, length({sql_trim('text')}) AS size FROM conversations) WHERE sender <> 'system' AND size > 0"""
)
def normalized_messages(spark, sf):
    t = table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    raw = t.select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("line_no"), none.alias("id"), none.alias("ts_raw"),
        F.col("role").alias("sender"), F.concat(F.lit(" "), "text", F.lit("　")).alias("content"), none.alias("reply_to_id"), none.alias("media_type"),
    )
    return normalize.normalize_messages(raw).select("chat_id", "line_no", "id", "sender", "media_type", F.length("content").alias("size"))


@query(f"WITH {sql_events(3)} SELECT seq AS event_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts, seq) AS position FROM msg")
def ordered_messages(spark, sf):
    m = normalize.order_messages(events(spark, sf, 3).withColumnRenamed("seq", "line_no"))
    return m.select(F.col("line_no").alias("event_id"), F.col("seq").alias("position"))


@query("SELECT conv_id AS chat_id, role AS sender, count(*) AS message_count FROM conversations GROUP BY ALL")
def speaker_counts(spark, sf):
    return normalize.speaker_counts(conversations(spark, sf))


_PICK = f"""WITH {CONVERSATIONS}, c AS (SELECT chat_id, sender, count(*) AS n, min(seq) AS f FROM msg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, f) AS k FROM c)
SELECT a.chat_id, a.sender AS target, b.sender AS counterpart FROM r a LEFT JOIN r b ON a.chat_id = b.chat_id AND b.k = 2 WHERE a.k = 1"""


@query(_PICK)
def picked_speakers(spark, sf):
    return normalize.pick_speakers(conversations(spark, sf))


@query(
    f"""SELECT m.chat_id, count(*) AS total_messages, count(*) FILTER (m.sender = p.target) AS target_messages,
  count(DISTINCT m.sender) AS speaker_count FROM (SELECT conv_id AS chat_id, role AS sender FROM conversations) m
  JOIN ({_PICK}) p USING (chat_id) GROUP BY 1"""
)
def chat_summary(spark, sf):
    m = conversations(spark, sf)
    return normalize.chat_summary(normalize.mark_target(m.drop("is_target"), normalize.pick_speakers(m)))


# Every seventh event has lost its time: such rows come first in their chat and open no session of their own.
_SESSIONS = f"""{sql_events()}, part AS (SELECT * REPLACE (CASE WHEN seq % 7 <> 0 THEN ts END AS ts) FROM msg),
gaps AS (SELECT *, ts - lag(ts) OVER w AS gap, row_number() OVER w AS nr FROM part WINDOW w AS (PARTITION BY chat_id ORDER BY ts NULLS FIRST, seq)),
sess AS (SELECT *, CAST(sum(CASE WHEN nr = 1 OR gap > INTERVAL 12 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY chat_id ORDER BY ts NULLS FIRST, seq) AS BIGINT) AS session_no FROM gaps)"""


def _sessions(spark, sf):
    some = events(spark, sf).withColumn("ts", F.when(F.col("seq") % 7 != 0, F.col("ts")))
    return normalize.sessionize(some, gap_seconds=12 * 3600, width=10 * DAY)


@query(f"WITH {_SESSIONS} SELECT seq AS event_id, session_no FROM sess")
def sessionize_events(spark, sf):
    return _sessions(spark, sf).select(F.col("seq").alias("event_id"), "session_no")


@query(
    f"""WITH {_SESSIONS} SELECT chat_id, 'session_' || lpad(CAST(session_no AS VARCHAR), 4, '0') AS session_id,
  epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS message_count FROM sess GROUP BY chat_id, session_no"""
)
def session_rollup(spark, sf):
    return normalize.session_rollup(_sessions(spark, sf)).select(
        "chat_id", "session_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "message_count"
    )


_TURN_OUT = """chat_id, seq, 'sample_' || session_no || '_' || lpad(CAST(turn_no AS VARCHAR), 4, '0') AS turn_id"""


@query(
    f"""WITH {CHAT}, {sql_turns('chat')} SELECT {_TURN_OUT},
  array_to_string(list_transform(context, lambda c: c.sender || ':' || c.content), '|') AS context, content AS target_message FROM turns"""
)
def turns_context(spark, sf):
    t = turns.build_turns(chat(spark, sf), ts=None)
    joined = F.array_join(F.transform("context", lambda c: F.concat(c["sender"], F.lit(":"), c["content"])), "|")
    return t.select("chat_id", "seq", "turn_id", joined.alias("context"), "target_message")


def _grouped(spark, sf):
    """Ten conversations to a chat, each a session."""
    m = conversations(spark, sf)
    return m.withColumns(
        {"session_no": F.col("chat_id"), "seq": F.col("chat_id") * 1000 + F.col("seq"), "chat_id": F.floor(F.col("chat_id") / 10)}
    )


_GROUPED = """msg AS (SELECT conv_id // 10 AS chat_id, conv_id AS session_no, conv_id * 1000 + turn AS seq, role AS sender,
  text AS content, role = 'assistant' AS is_target FROM conversations)"""


def _sql_split(source: str) -> str:
    return f"{source}, {sql_turns('msg')}, {SQL_SPLIT}"


@query(f"WITH {_sql_split(_GROUPED)} SELECT {_TURN_OUT}, split FROM split")
def split_sessions(spark, sf):
    t = turns.split_turns(turns.build_turns(_grouped(spark, sf), ts=None))
    return t.select("chat_id", "seq", "turn_id", "split")


@query(f"WITH {_sql_split(CONVERSATIONS)} SELECT {_TURN_OUT}, split FROM split")
def split_sequential(spark, sf):
    t = turns.split_turns(turns.build_turns(conversations(spark, sf), ts=None))
    return t.select("chat_id", "seq", "turn_id", "split")


def _documents(spark, sf):
    """Seven of ten documents train, then validation and test."""
    k = F.col("doc_id") % 10
    split = F.when(k < 7, "train").when(k < 8, "validation").otherwise("test")
    return table(spark, sf, "documents").select("doc_id", "text", split.alias("split"))


_GRAMS = f"""t AS (SELECT doc_id, lower({sql_trim('text')}) AS x, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8
  THEN 'validation' ELSE 'test' END AS split FROM documents),
g AS (SELECT DISTINCT doc_id, split, substr(x, i, 3) AS gr FROM (SELECT doc_id, split, x, unnest(range(1, length(x) - 1)) AS i FROM t)),
n AS (SELECT doc_id, split, count(*) AS n FROM g GROUP BY ALL),
close AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, a.split || '_' || b.split AS pass FROM n a JOIN n b
  ON a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n AND (a.split, b.split) IN (('train', 'validation'), ('train', 'test'), ('validation', 'test'))),
both_ AS (SELECT a, b, pass, na, nb, count(*) AS c FROM close JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b AND ga.gr = gb.gr GROUP BY ALL),
near AS (SELECT a, b, pass, c / (na + nb - c) AS j FROM both_ WHERE c / (na + nb - c) > 0.9),
hits AS (SELECT near.*, ta.x = tb.x AS same FROM near JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b),
first_hit AS (SELECT pass, b AS b_id, min(a) AS a_id FROM hits GROUP BY ALL),
p1 AS (SELECT * FROM first_hit WHERE pass IN ('train_validation', 'train_test')),
p2 AS (SELECT pass, b AS b_id, min(a) AS a_id FROM hits WHERE pass = 'validation_test' AND b NOT IN (SELECT b_id FROM p1) AND a NOT IN (SELECT b_id FROM p1) GROUP BY ALL),
pairs AS (SELECT p.*, CASE WHEN h.same THEN 'exact' ELSE 'near' END AS kind, round(h.j, 6) AS similarity
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p JOIN hits h ON h.a = p.a_id AND h.b = p.b_id AND h.pass = p.pass),
kept AS (SELECT doc_id, split FROM t WHERE doc_id NOT IN (SELECT b_id FROM pairs))"""


@query(f"WITH {_GRAMS} SELECT b_id, a_id, kind, similarity FROM pairs WHERE pass = 'train_test'")
def leakage_pairs(spark, sf):
    d = _documents(spark, sf)
    pairs = leakage.contamination_pairs(
        d.filter("split = 'train'"), d.filter("split = 'test'"), text="text", id="doc_id", order="doc_id"
    )
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_GRAMS} SELECT * FROM kept")
def decontaminated(spark, sf):
    return leakage.decontaminate(_documents(spark, sf), text="text", id="doc_id", order="doc_id").select("doc_id", "split")


@query(
    f"""WITH {_GRAMS}, k AS (SELECT count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count,
  count(*) FILTER (split = 'test') AS test_count, count(*) AS total FROM kept),
d AS (SELECT count(*) FILTER (pass = 'train_validation') AS train_validation_duplicates, count(*) FILTER (pass = 'train_test') AS train_test_duplicates,
  count(*) FILTER (pass = 'validation_test') AS validation_test_duplicates, count(*) FILTER (kind = 'near') AS near_duplicates,
  count(*) AS cross_split_duplicates FROM pairs)
SELECT *, round(train_count / total * 100, 1) AS train_percentage, round(validation_count / total * 100, 1) AS validation_percentage,
  round(test_count / total * 100, 1) AS test_percentage, cross_split_duplicates = 0 AS passed FROM k, d"""
)
def isolation_report(spark, sf):
    clean_rows, pairs = leakage.audit(_documents(spark, sf), text="text", id="doc_id", order="doc_id")
    return leakage.isolation_report(clean_rows, pairs)


_HALF = "CAST('0x' || substr(h, {}, 12) AS HUGEINT)"
_PRINT = f"""substr(sha256(count(*) || ':' || CAST(coalesce(sum({_HALF.format(1)}), 0) AS VARCHAR) || ':' || CAST(coalesce(sum({_HALF.format(13)}), 0) AS VARCHAR)), 1, 16)"""


def _sql_print(name: str, columns: list[str]) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in sorted(columns))
    return f"""SELECT '{name}' AS "table", count(*) AS "rows", {_PRINT} AS fingerprint FROM (SELECT sha256(CAST(to_json({{{fields}}}) AS VARCHAR)) AS h FROM {name})"""


_PRINTED = {"conversations": ["conv_id", "turn", "role", "text"], "events": ["event_id", "user_id", "event_type"], "labels": ["doc_id", "quality", "toxic"]}


@query(" UNION ALL ".join(_sql_print(n, c) for n, c in _PRINTED.items()))
def table_fingerprints(spark, sf):
    parts = [sinks.table_fingerprint(table(spark, sf, n).select(*c)).withColumn("table", F.lit(n)) for n, c in _PRINTED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT role AS sender, replace(text, chr(10), ' ') AS content, CASE WHEN turn % 2 = 0 THEN 1715682135 + turn END AS epoch FROM conversations""")
def transcripts_folder(spark, sf):
    """Text lines and JSON rows in one folder, read by the kind of each file."""
    folder = lineage.scratch(spark)
    t = table(spark, sf, "conversations").withColumn("line", F.replace("text", F.lit("\n"), F.lit(" ")))
    at = F.date_format(F.timestamp_seconds(F.col("turn") + 1715682135), "yyyy-MM-dd HH:mm:ss")
    t.filter("turn % 2 = 0").select(F.concat(at, F.lit(" "), "role", F.lit(": "), "line")).write.text(folder)
    t.filter("turn % 2 = 1").select(F.col("role").alias("author"), F.col("line").alias("body")).write.mode("append").json(folder)
    return transcripts.read_transcripts(spark, folder).select("sender", "content", F.unix_timestamp("ts").alias("epoch"))


@query("SELECT conv_id, turn, role, text, CASE conv_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM conversations")
def split_jsonl(spark, sf):
    part = F.when(F.col("conv_id") % 5 == 0, "test").when(F.col("conv_id") % 5 == 1, "valid").otherwise("train")
    rows = table(spark, sf, "conversations").withColumn("split", part)
    folder = lineage.scratch(spark)
    sinks.write_split_jsonl(rows, folder)
    return sinks.read_split_jsonl(spark, folder, rows.schema)


@query(
    """SELECT 'conversations' AS component, count(*) AS "rows", TRUE AS unordered FROM conversations
UNION ALL SELECT 'labels', count(*), TRUE FROM labels"""
)
def profile_manifest(spark, sf):
    """The fingerprint of a written table is that of its rows in any order."""
    tables = {n: table(spark, sf, n) for n in ("conversations", "labels")}
    manifest = sinks.write_profile_tables(tables, lineage.scratch(spark))
    other = [sinks.table_fingerprint(df.repartition(7, *df.columns[:1])).select(F.lit(n).alias("component"), F.col("fingerprint").alias("again")) for n, df in tables.items()]
    return manifest.join(other[0].unionByName(other[1]), "component").select("component", "rows", (F.col("fingerprint") == F.col("again")).alias("unordered"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS persona_id, text AS value FROM documents")
def exported_memories(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("persona_id"), F.col("text").alias("value"))
    folder = lineage.scratch(spark)
    sinks.export_memories(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query(
    """SELECT 'tg_' || conv_id || '_' || turn AS id, role AS sender, text AS content, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no
FROM conversations WHERE text <> '' QUALIFY turn % 5 <> 4"""
)
def large_json_export(spark, sf):
    """All conversations as one export object in one file, read in pieces as if it were too large to be parsed whole."""
    t = table(spark, sf, "conversations").filter("text <> ''")
    item = F.struct(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("2024-05-14T10:22:00").alias("date"),
        F.when(F.col("turn") % 5 == 4, "service").otherwise("message").alias("type"), F.col("role").alias("from"), F.col("text").alias("text"),
        F.struct(F.array(F.lit('} "{')).alias("]")).alias("other"),
    )
    numbered = ordered.scan(t.select("conv_id", "turn", F.to_json(item).alias("value")).withColumn("all", F.lit(1)), ["all"], ["conv_id", "turn"], number="n", width=1000)
    line = F.concat(F.when(F.col("n") == 1, F.lit('{"name": "{all", "made": {"by": [{"a": "]"}]}, "messages": [')).otherwise(F.lit(",")), "value")
    ends = spark.createDataFrame([(2**62, '], "after": [{"type": "message"}]}')], "n long, value string")
    folder = lineage.scratch(spark)
    numbered.select("n", line.alias("value")).unionByName(ends).orderBy("n").select("value").coalesce(1).write.text(folder)
    out = transcripts.read_chat_export_json(spark, folder, whole_bytes=0)
    return out.select("id", "sender", "content", "line_no")
