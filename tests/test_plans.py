"""Plans read their source once, however many ordered scans are chained."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import memory, normalize, turns
from colloquy.plans import ordered
from colloquy.sources import transcripts


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan", plan))


def messages(spark, path):
    rows = spark.range(400).select(
        (F.col("id") % 5).alias("chat_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 100).alias("ts"),
        F.when(F.col("id") % 3 == 0, "Ann").otherwise("Bo").alias("sender"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"),
        (F.col("id") % 3 == 0).alias("is_target"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_chained_scans_read_once(spark, tmp_path):
    m = messages(spark, str(tmp_path / "m"))
    sessions = normalize.sessionize(m)
    assert scans(sessions) == 1
    built = turns.build_turns(sessions)
    assert scans(built) == 1
    assert scans(turns.split_turns(built)) == 1


def test_lines_are_read_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"2026-05-14 10:22:{i % 60:02d} Ann: line {i}" for i in range(100)))
    out = transcripts.read_transcript_text(spark, str(tmp_path / "a.txt"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan", plan)) <= 2


def test_busy_chunks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 50)
    monkeypatch.setattr(ordered, "QUANTILES", 64)
    rnd = random.Random(2)
    day = 86_400
    rows = [(1, k, float(rnd.randrange(3 * day)) if k % 9 == 0 else day + rnd.random() * 600) for k in range(1200)]  # one busy day
    rows += [(2, k, None) for k in range(700)]  # no times at all
    rows += [(3, k, float(7 if k % 3 else rnd.randrange(20))) for k in range(900)]  # one busy instant
    rows += [(None, k, float(k)) for k in range(10)]
    df = spark.createDataFrame(rows, "chat_id long, line_no long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    cut = ordered.cut_chunks(df, ["chat_id"], ["ts", "line_no"])
    sizes = [r["count"] for r in cut.groupBy("chat_id", ordered.CUT).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == len(rows)  # quantiles are approximate
    place = Window.partitionBy("chat_id").orderBy("ts", "line_no")
    want = {(r.chat_id, r.line_no): r.n for r in df.filter("chat_id is not null").select("*", F.row_number().over(place).alias("n")).collect()}
    got = {(r.chat_id, r.line_no): r.seq for r in normalize.order_messages(df).filter("chat_id is not null").collect()}
    assert got == want
    lead = F.lead("ts").over(place)
    want = {(r.chat_id, r.line_no): r.n for r in df.filter("chat_id is not null").select("*", lead.alias("n")).collect()}
    closed = memory.supersede(df.withColumnRenamed("line_no", "id"), ["chat_id"], "ts").filter("chat_id is not null")
    assert {(r.chat_id, r.id): r.valid_to for r in closed.collect()} == want


def test_a_folder_of_all_kinds_has_a_small_plan(spark, tmp_path):
    """Readers stand side by side: a kind that is there costs its own reader, one that is not costs nothing."""
    files = {
        "a.txt": "2026-05-14 10:22:15 Ann: hi", "b.md": "**Ann**: hi", "c.md": "14/05/2026, 10:25 - Bob: dash", "d.json": '{"messages": []}',
        "e.json": '{"sender": "Ann", "content": "a"}', "f.jsonl": '{"sender": "Ann", "content": "a"}', "g.html": "<p></p>", "h.chat": '[{"content": "b"}]', "i.chat": "Ann: x",
    }
    for name, text in files.items():
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / name).write_text(text)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.txt").write_text(files["a.txt"])
    (tmp_path / "none").mkdir()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = transcripts.read_transcripts(spark, str(tmp_path / "all"))
    assert plan(whole).count("Exchange") < 100
    assert {r.chat_id.rsplit("/", 1)[1] for r in whole.collect()} == set(files) - {"d.json", "g.html"}
    assert plan(transcripts.read_transcripts(spark, str(tmp_path / "one"))).count("FileScan") <= 2
    assert transcripts.read_transcripts(spark, str(tmp_path / "none")).count() == 0
