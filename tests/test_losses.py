"""Inputs of which nothing may be lost."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import replies
from colloquy.operators import normalize
from colloquy.sources import transcripts


def test_labels_and_quotes_of_any_depth(spark):
    texts = ["Bot: “" * n + "hi" + "”" * n for n in (0, 1, 6, 40)] + ["a: b: c", "「『x』」", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(replies.strip_speaker_quotes("t", "Bot")).collect()]
    assert got == ["hi", "hi", "hi", "hi", "a: b: c", "x", "", None]


def test_rows_without_time_open_no_session(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, None), (1, 4, 0), (1, 5, 60), (1, 6, 60 + 26 * 60), (2, 1, 0), (2, 2, 1500), (3, 1, None)]
    df = spark.createDataFrame(rows, "chat_id long, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.chat_id, r.seq): r.session_no for r in normalize.sessionize(df).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): 2, (2, 1): 1, (2, 2): 1, (3, 1): 1}


def test_every_file_of_a_folder_is_read_by_its_kind(spark, tmp_path):
    export = {"messages": [{"id": 1, "type": "message", "date": "2026-05-14T10:00:00", "from": "Ann", "text": "from export"}]}
    array = [{"sender": "Bo", "content": "from array", "timestamp": "2026-05-14T10:00:00"}]
    html = '<div class="message"><div class="from_name">Cy</div><div class="text">from page</div></div>'
    (tmp_path / "a.json").write_text(json.dumps(array))
    (tmp_path / "B.JSON").write_text(json.dumps(export))
    (tmp_path / "c.data").write_text(json.dumps(export, indent=1))
    (tmp_path / "d.unknown").write_text("\n" + json.dumps(array))
    (tmp_path / "E.HTML").write_text(html)
    (tmp_path / "f.rows").write_text("\n".join(json.dumps(x) for x in array * 2))
    (tmp_path / "G.TXT").write_text("no head\nnor this\n2026-05-14 10:22:15 Dan: from text\nmore")
    got = {}
    for r in transcripts.read_transcripts(spark, str(tmp_path)).collect():
        got.setdefault(r.chat_id.rsplit("/", 1)[1], []).append((r.sender, r.content))
    assert got == {
        "a.json": [("Bo", "from array")], "B.JSON": [("Ann", "from export")], "c.data": [("Ann", "from export")], "d.unknown": [("Bo", "from array")],
        "E.HTML": [("Cy", "from page")], "f.rows": [("Bo", "from array")] * 2, "G.TXT": [("Dan", "from text\nmore")],
    }


def test_a_document_too_large_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transcripts, "MAX_JSON_BYTES", 100)
    (tmp_path / "a.json").write_text("[" + "1, " * 100)
    with pytest.raises(Exception, match="too large"):
        transcripts.read_chat_json_rows(spark, str(tmp_path / "a.json")).collect()
    monkeypatch.setattr(transcripts, "MAX_JSON_BYTES", 10**9)
    assert transcripts.read_chat_json_rows(spark, str(tmp_path / "a.json")).count() == 0
