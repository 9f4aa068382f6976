import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators.facts import parse_notes
from colloquy.operators.normalize import normalize_messages, order_messages
from colloquy.sources import json_pieces, sinks, transcripts as tr

TEXT = """--- 2026-05-14 ---
2026-05-14 10:22:15 Ann: hello
second line
---
2026-05-14 10:23:00 Bob： [图片]
[14/05/2026, 10:24:01] Ann: dmy
14/05/2026, 10:25 - Bob: dash
Zoe: only speaker
https://x.y: not a speaker
李四 joined the group
orphan line
### 2026-05-15
2026-05-15 1:02 Ann: next day
"""

MARKDOWN = """# Chat
orphan
### 2026-05-27 10:00
**Ann**: one
- Bob: two
more

of it
> Ann: three
**Bob** (2026-05-27 11:00:00): timed
Ann: after
### 2026-05-27 12:00:00 Ann: head
2026-05-27 12:01:00 Bob: plain
### Bob (2026-05-27 12:30:00): late
群公告: nothing
lost
[2026-05-27 12:31:00] system: gone
"""


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("chat_id", "line_no").select(*cols).collect()]


def test_text(spark, tmp_path):
    df = tr.read_transcript_text(spark, write(tmp_path, "a.txt", TEXT))
    assert got(df, "sender", "content", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) == [
        ("Ann", "hello\nsecond line", "2026-05-14 10:22:15"),
        ("Bob", "[图片]", "2026-05-14 10:23:00"),
        ("Ann", "dmy", "2026-05-14 10:24:01"),
        ("Bob", "dash", "2026-05-14 10:25:00"),
        ("Zoe", "only speaker\nhttps://x.y: not a speaker", None),
        ("Ann", "next day", "2026-05-15 01:02:00"),
    ]


def test_text_in_small_blocks(spark, tmp_path):
    lines = [f"2026-05-14 10:{i // 60:02d}:{i % 60:02d} Ann: m{i}\nmore {i}" for i in range(500)]
    path = write(tmp_path, "big.txt", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = tr.read_lines(spark, path)
        assert raw.select("block").distinct().count() > 3
        assert got(tr.text_messages(raw), "content") == [(f"m{i}\nmore {i}",) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_markdown(spark, tmp_path):
    df = tr.read_transcript_markdown(spark, write(tmp_path, "a.md", MARKDOWN))
    assert got(df, "sender", "content", F.date_format("ts", "HH:mm:ss")) == [
        ("Ann", "one", "10:01:00"),
        ("Bob", "two\nmore\n\nof it", "10:02:00"),
        ("Ann", "three", "10:03:00"),
        ("Bob", "timed", "11:00:00"),
        ("Ann", "after", "11:01:00"),
        ("Ann", "head", "12:00:00"),
        ("Bob", "plain", "12:01:00"),
        ("Bob", "late", "12:30:00"),
    ]


EXPORT = {
    "name": "x", "type": "personal_chat", "id": 1,
    "messages": [
        {"id": 1, "type": "service", "date": "2026-05-14T10:00:00", "actor": "Ann"},
        {"id": 2, "type": "message", "date": "2026-05-14T10:00:01", "from": "Ann", "text": "hi 👩🏽‍💻"},
        {"id": 3, "type": "message", "date": "2026-05-14T10:00:02", "from_id": "u7", "reply_to_message_id": 2,
         "text": ["see ", {"type": "bold", "text": "this"}]},
        {"id": 4, "type": "message", "date": "2026-05-14T10:00:03", "from": "Ann", "text": "", "media_type": "sticker"},
        {"id": 5, "type": "message", "date": "2026-05-14T10:00:04", "from": "Ann", "text": "Bob joined the group"},
    ],
}


def test_export_json(spark, tmp_path):
    df = tr.read_chat_export_json(spark, write(tmp_path, "a.json", json.dumps(EXPORT)))
    assert got(df, "id", "sender", "content", "reply_to_id", "media_type") == [
        ("tg_2", "Ann", "hi 👩🏽‍💻", None, None),
        ("tg_3", "User_u7", "see this", "tg_2", None),
        ("tg_4", "Ann", "[sticker]", None, "sticker"),
    ]


def test_json_rows(spark, tmp_path):
    rows = [
        {"sender": "Ann", "content": "a", "timestamp": "2026-05-14 10:00:00"},
        {"author": "Bob", "text": "b", "date": 1715682135},
        {"user": {"name": "Cid"}, "body": "c", "created_at": "2026-05-14T10:00:02Z", "reply_to": "m1"},
    ]
    want = [("Ann", "a"), ("Bob", "b"), ("Cid", "c")]
    for name, text in (
        ("array.json", json.dumps(rows)),
        ("data.json", json.dumps({"data": rows})),
        ("history.json", json.dumps({"history": rows})),
    ):
        df = tr.read_chat_json_rows(spark, write(tmp_path, name, text))
        assert got(df, "sender", "content") == want
        assert df.filter("ts is null").count() == 0
    lines = "\n".join([json.dumps(rows[0]), "{broken", json.dumps(rows[1]), "", json.dumps(rows[2])])
    df = tr.read_chat_json_rows(spark, write(tmp_path, "rows.jsonl", lines), lines=True)
    assert got(df, "sender", "content") == want


HTML = """<div class="message service">x</div>
<div class="message default" id="m1"><div class="from_name">Ann</div>
<div class="date details" title="14.05.2026 10:22:15 UTC+08:00">10:22</div><div class="text">one<br>two</div></div>
<div class="message default joined" id="m2"><div class="text">three &amp; four</div></div>"""
BUBBLES = """<div class="bubble" data-sender="Ann"><span class="content">yo</span><span class="time">2026-05-14 10:00</span></div>
<div class="bubble"><span class="author">Bob</span><p class="text">hey</p></div><div class="bubble">bare</div>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, HTML), (2, BUBBLES), (3, "<p>nothing</p>")], "page_id long, html string")
    df = tr.extract_messages_html(pages)
    assert got(df, "chat_id", "sender", "content", F.date_format("ts", "HH:mm:ss")) == [
        ("1", "Ann", "onetwo", "02:22:15"),
        ("1", "Ann", "three & four", None),
        ("2", "Ann", "yo", "10:00:00"),
        ("2", "Bob", "hey", None),
        ("2", "Speaker", "bare", None),
    ]


def test_read_transcripts(spark, tmp_path):
    write(tmp_path, "a.txt", TEXT)
    write(tmp_path, "b.md", MARKDOWN)
    write(tmp_path, "c.md", "2026/05/14, nothing here\n14/05/2026, 10:25 - Bob: dash")
    write(tmp_path, "d.json", json.dumps(EXPORT))
    write(tmp_path, "e.jsonl", json.dumps({"sender": "Ann", "content": "a"}))
    write(tmp_path, "f.html", HTML)
    write(tmp_path, "g.chat", json.dumps({"sender": "Ann", "content": "unknown"}))
    write(tmp_path, "h.chat", "**Ann**: bold")
    df = tr.read_transcripts(spark, str(tmp_path))
    counts = {r[0].rsplit("/", 1)[-1]: r[1] for r in df.groupBy("chat_id").count().collect()}
    assert counts == {"a.txt": 6, "b.md": 8, "c.md": 1, "d.json": 3, "e.jsonl": 1, "f.html": 2, "g.chat": 1, "h.chat": 1}


def test_normalize(spark, tmp_path):
    raw = tr.read_transcript_text(spark, write(tmp_path, "a.txt", TEXT + "2026-05-15 1:03 系统消息: x\n2026-05-15 1:04 Bob: ​\n"))
    messages = order_messages(normalize_messages(raw))
    rows = [tuple(r) for r in messages.orderBy("seq").select("seq", "id", "sender", "content", "media_type").collect()]
    assert rows == [
        (1, "msg_000005", "Zoe", "only speaker\nhttps://x.y: not a speaker", "text"),
        (2, "msg_000001", "Ann", "hello\nsecond line", "text"),
        (3, "msg_000002", "Bob", "", "image"),
        (4, "msg_000003", "Ann", "dmy", "text"),
        (5, "msg_000004", "Bob", "dash", "text"),
        (6, "msg_000006", "Ann", "next day", "text"),
    ]


def test_notes(spark, tmp_path):
    path = write(tmp_path, "n.md", "a: b\n# 学校\n校区：金水\n\n## Other\n- free text")
    notes = parse_notes(tr.read_lines(spark, path), "chat_id", "place", chunk=F.col("block"))
    assert [tuple(r) for r in notes.orderBy("place").select("section", "key", "value").collect()] == [
        ("General", "a", "b"), ("学校", "校区", "金水"), ("Other", "note", "- free text"),
    ]


def test_sinks(spark, tmp_path):
    turns = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (3, "c", "train")], "id int, t string, split string")
    sinks.write_split_jsonl(turns, str(tmp_path / "s"))
    back = sinks.read_split_jsonl(spark, str(tmp_path / "s"), "id int, t string, split string")
    assert sorted(map(tuple, back.select("id", "t", "split").collect())) == sorted(map(tuple, turns.collect()))
    one = sinks.table_fingerprint(turns).collect()
    assert one == sinks.table_fingerprint(turns.orderBy(F.col("id").desc()).repartition(5)).collect()
    assert one != sinks.table_fingerprint(turns.union(turns.limit(1))).collect()
    manifest = sinks.write_profile_tables({"turns": turns, "more": turns.limit(1)}, str(tmp_path / "p"), version="1")
    assert {r["component"]: r["rows"] for r in manifest.collect()} == {"turns": 3, "more": 1}
    sinks.export_memories(turns, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3


def test_documents_in_pieces(spark, tmp_path):
    """Read in pieces, small blocks included, a document gives what it gives as a whole."""
    rnd = random.Random(6)
    odd = ["}", "{", "]", "[", '"', "\\", "a", "é", "😀", "\n", ":", ",", '\\"}', '{"sender": "x"}']
    say = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randrange(12)))
    rows = [{"sender": say() or "s", "content": "c " + say(), "deep": [{"x": {say(): [say(), {}]}}, 1, None]} for _ in range(60)]
    export = {"name": say(), "about": {"messages": [{"type": "message", "id": 1, "text": "no"}]}, "messages": [{"type": "message", "id": k, "from": r["sender"], "text": r["content"], "more": r["deep"]} for k, r in enumerate(rows)], "last": [say(), {"a": []}]}
    files = {"array": rows, "data": {"history": rows[:3], "data": rows}, "history": {"x": {"data": rows[:2]}, "history": rows}, "none": {"data": []}, "empty": []}
    folder = tmp_path / "rows"
    folder.mkdir()
    for name, value in files.items():
        (folder / f"{name}.json").write_text(json.dumps(value, ensure_ascii=False))
    write(tmp_path, "export.json", json.dumps(export, indent=1) + "\n")
    path = str(tmp_path / "export.json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        whole = got(tr.read_chat_json_rows(spark, str(folder)), "chat_id", "line_no", "id", "sender", "content")
        pieces = tr.read_chat_json_rows(spark, str(folder), whole_bytes=0)
        assert got(pieces, "chat_id", "line_no", "id", "sender", "content") == whole and len(whole) == 3 * len(rows)
        assert json_pieces.read_pieces(spark, path).rdd.getNumPartitions() > 4
        assert got(tr.read_chat_export_json(spark, path, whole_bytes=0), "id", "sender", "content") == got(tr.read_chat_export_json(spark, path), "id", "sender", "content")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_package_that_breaks_off_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "package")
    with pytest.raises(ValueError, match="no package"):
        sinks.read_profile_tables(spark, path)
    one = {"a": spark.range(3), "b": spark.range(5)}
    sinks.write_profile_tables(one, path, kind="first")
    broken = {"a": spark.range(7), "b": spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        sinks.write_profile_tables(broken, path, kind="second")
    assert {n: t.count() for n, t in sinks.read_profile_tables(spark, path).items()} == {"a": 3, "b": 5}
    manifest = sinks.write_profile_tables({"a": spark.range(0)}, path, note="third")
    assert [(r.component, r.rows, r.note, r.package) for r in manifest.collect()] == [("a", 0, "third", 2)]
    assert {n: t.count() for n, t in sinks.read_profile_tables(spark, path).items()} == {"a": 0}
