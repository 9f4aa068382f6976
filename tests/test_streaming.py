import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators.memory import supersede
from colloquy.streaming import live, state, tables

SCHEMA = "chat_id long, message_id long, user_id long, ts timestamp, text string, reply_to_id long"


def messages(spark, n=400, chats=3, seed=1):
    rnd, at, rows = random.Random(seed), {c: 1_700_000_000.0 for c in range(chats)}, []
    for i in range(n):
        c = rnd.randrange(chats)
        at[c] += rnd.choice([0.5, 1.0, 2.0, 3.0, 3.5, 6.0])
        text = rnd.choice(["hello", " 喜欢 tea, yes ", "", "why?", "/start", "对不起", "你滚", "哈哈", "宝", "喜欢 rice"])
        rows.append((c, i, c, at[c], text, None))
    df = spark.createDataFrame(rows, "chat_id long, message_id long, user_id long, t double, text string, reply_to_id long")
    return df.select("chat_id", "message_id", "user_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "text", "reply_to_id")


def stream_of(spark, df, folder, files=4):
    """Write the rows in time order as several files and read them one file per batch."""
    pdf = df.orderBy("ts", "message_id")
    rows = pdf.collect()
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, mode, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_bursts_fixture(spark):
    rows = [(1, 1, 1.0, "one"), (1, 2, 2.5, "two"), (2, 3, 2.0, "other"), (1, 4, 10.0, " "), (1, 5, 11.0, "three"), (1, 6, 12.0, "")]
    rows += [(3, 10 + i, 2.0 * i, f"t{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "chat_id long, message_id long, t double, text string").select(
        "chat_id", "message_id", F.col("chat_id").alias("user_id"), F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "text",
        F.lit(None).cast("long").alias("reply_to_id"),
    )
    got = {tuple(r) for r in live.bursts(df).select("chat_id", "text", "message_count", "first_id", "last_id").collect()}
    assert got == {
        (1, "one\ntwo", 2, 1, 2), (2, "other", 1, 3, 3), (1, "three", 1, 4, 6),
        (3, "t0\nt1\nt2\nt3\nt4\nt5", 6, 10, 15), (3, "t6\nt7", 2, 16, 17),
    }


def test_bursts_stream_equals_batch(spark, tmp_path):
    df = messages(spark)
    want = live.bursts(df)
    assert as_set(live.bursts(df, width=7)) == as_set(want)
    # Late enough to push the watermark past every burst.
    end = df.agg(F.max("ts").alias("m")).collect()[0]["m"]
    from datetime import timedelta

    flush = spark.createDataFrame([(99, 10**6, 99, end + timedelta(hours=1), "x", None)], SCHEMA)
    (tmp_path / "in").mkdir()
    source = stream_of(spark, df.unionByName(flush), tmp_path / "in", files=3)
    got = run(spark, live.bursts(source, watermark="5 seconds"), "bursts_out", "append", tmp_path / "c")
    assert as_set(got.filter("chat_id <> 99").select(*want.columns)) == as_set(want)


def test_working_memory_and_counters(spark, tmp_path):
    df = messages(spark, 120)
    source = stream_of(spark, df, tmp_path / "in")
    got = run(spark, state.working_memory_stream(source, "chat_id"), "memory_out", "update", tmp_path / "c1")
    last = {r["chat_id"]: r["ids"] for r in got.collect()}
    want = state.working_memory(df, ["chat_id"], ["ts", "message_id"]).groupBy("chat_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "message_id"))), lambda x: x["message_id"]).alias("ids")
    )
    assert last == {r["chat_id"]: r["ids"] for r in want.collect()}
    counted = run(spark, state.session_counters(source, ["chat_id"]), "counters_out", "complete", tmp_path / "c2")
    assert as_set(counted) == as_set(state.session_counters(df, ["chat_id"]))


def test_stream_supersede(spark, tmp_path):
    df = messages(spark, 120)
    source = stream_of(spark, df, tmp_path / "in")
    out = str(tmp_path / "out")
    write = tables.write_batch(out)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    query = source.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    facts = tables.current_facts(spark, out)
    want = supersede(tables.batch_facts(df), tables.KEYS)
    assert as_set(facts.select(want.columns)) == as_set(want) and facts.count() == df.filter("text like '%喜欢%'").count()
    assert as_set(tables.active_table(spark, out).select(want.columns)) == as_set(want.filter("valid_to is null"))
    assert tables.committed_messages(spark, out).count() == 120


def test_late_versions_and_failed_tries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_FOLDERS", 2)
    rnd = random.Random(4)
    rows = [(f"i{k:03d}", f"p{rnd.randrange(4)}", rnd.choice("abc"), rnd.randrange(40), k % 7) for k in range(140)]
    df = spark.createDataFrame(rows, "id string, persona_id string, key string, t long, batch int").withColumn("valid_from", F.timestamp_seconds("t"))
    out = str(tmp_path / "late")
    write = tables.write_batch(out, facts=lambda batch: batch.select("id", "persona_id", "key", "valid_from"), buckets=5)
    real = tables._commit
    for b in range(7):
        part = df.filter(F.col("batch") == b)
        if b == 3:
            # Everything is written, then the driver is lost before the commit.
            monkeypatch.setattr(tables, "_commit", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                write(part, b)
            monkeypatch.setattr(tables, "_commit", real)
            assert tables.committed_messages(spark, out).count() == 60 and tables.current_facts(spark, out).count() == 60
        write(part, b)
        write(part, b)
        want = supersede(df.filter(F.col("batch") <= b).select("id", "persona_id", "key", "valid_from"), tables.KEYS)
        assert as_set(tables.current_facts(spark, out).select(want.columns)) == as_set(want)
    write(df.filter(F.lit(False)), 7)
    assert tables.current_facts(spark, out).count() == 140
    assert max(map(len, tables.last_commit(spark, out)["closed"].values())) <= 3


def test_only_touched_buckets_are_read(spark, tmp_path):
    out = str(tmp_path / "touched")
    write = tables.write_batch(out, facts=lambda batch: batch.select("id", "persona_id", "key", "valid_from"), buckets=8)
    row = lambda i, p, t: spark.createDataFrame([(i, p, "k", t)], "id string, persona_id string, key string, t long").withColumn("valid_from", F.timestamp_seconds("t"))
    everyone = spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), "id").alias("persona_id"), F.lit("k").alias("key"), F.timestamp_seconds(F.lit(0)).alias("valid_from"))
    write(everyone, 0)
    before = tables.last_commit(spark, out)
    write(row("x", "p1", 9), 1)
    after = tables.last_commit(spark, out)
    changed = [b for b in before["active"] if before["active"][b] != after["active"][b]]
    assert len(changed) == 1 and len(before["active"]) == 8 and tables.active_table(spark, out).count() == 50


def test_a_run_without_a_pause_is_folded_in_parts(spark):
    rnd = random.Random(7)
    rows, at, k = [], 0.0, 0
    for chat in (1, 2, 3):
        at = 0.0
        for _ in range(900):
            at += rnd.choice([0.0, 0.0, 0.25, 1.0, 3.0, 3.4]) if chat < 3 else rnd.choice([0.5, 3.0, 3.5, 9.0])
            rows.append((chat, k, at, "x"))
            k += 1
    df = spark.createDataFrame(rows, "chat_id long, message_id long, t double, text string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    want = {}
    for chat in (1, 2, 3):
        own = [r for r in rows if r[0] == chat]
        micros = np.array([int(r[2] * 1e6) for r in own])
        starts = live.cut_bursts(micros, np.zeros(len(own), bool), live.WINDOW_SECONDS, live.CAP_SECONDS)
        want |= {r[1]: own[s][1] for r, s in zip(own, starts)}
    for part in (None, 18.0, 40.0):
        got = {r.message_id: r.burst_id for r in live.burst_starts(df, part=part).collect()}
        assert got == want
    assert live.burst_starts(df.filter(F.lit(False))).count() == 0


def test_pseudonym_is_hmac(spark):
    import hashlib
    import hmac

    for salt in ("s", "x" * 80):
        got = spark.range(3).select(live.pseudonymise("id", salt).alias("p")).collect()
        assert [r["p"] for r in got] == [
            "user_" + hmac.new(salt.encode(), str(i).encode(), hashlib.sha256).hexdigest()[:12] for i in range(3)
        ]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """Counters equal the batch's, replayed messages count once, and the state shrinks when sessions fall silent."""
    df = messages(spark, 200, 4)
    folder, late = tmp_path / "in", 30 * 86_400
    source = stream_of(spark, df.unionByName(df.filter("message_id % 3 = 0")), folder, 3)
    query = (
        state.session_counters_stream(source, ["chat_id"], watermark="1 hour", idle_hours=24.0)
        .writeStream.format("memory").queryName("idle_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    )
    try:
        query.processAllAvailable()
        latest = spark.table("idle_out").groupBy("chat_id").agg(F.max_by(F.struct("first_ts", "last_ts", "message_count"), "message_count").alias("x")).select("chat_id", "x.*")
        assert as_set(latest) == as_set(state.session_counters(df, ["chat_id"]))
        sessions = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert sessions() == 4
        for i in range(2):
            rows = [(9, 10_000 + i, 9, 1_700_000_000.0 + late + i, "later")]
            new = spark.createDataFrame(rows, "chat_id long, message_id long, user_id long, t double, text string")
            new = new.select("chat_id", "message_id", "user_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "text", F.lit(None).cast("long").alias("reply_to_id"))
            new.coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
        assert sessions() == 1
    finally:
        query.stop()
