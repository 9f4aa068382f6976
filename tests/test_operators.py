import hashlib
import math
import os
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import clean, replies
from colloquy.operators import assets, language, leakage, memory, normalize, report, rhythm, scoring, style, turns
from colloquy.plans.lineage import shared_folder
from colloquy.plans.ordered import preceding, scan
from colloquy.plans.similarity import ngram_jaccard

MESSAGE = "chat_id string, seq long, sender string, content string, t double"


def chat(spark, rows, target="Ann"):
    rows = [(*r[:4], float(r[4])) for r in rows]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")
    return df.withColumn("is_target", F.col("sender") == target)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scan_equals_plain_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), i, rnd.randrange(200), rnd.choice([None, rnd.randrange(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, id long, at long, v long")
    w = Window.partitionBy("k").orderBy("at", "id")
    plain = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("q"),
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.last("v", True).over(w).alias("l"),
        F.collect_list("id").over(w.rowsBetween(-4, -1)).alias("c"),
    )
    for width in (1, 7, 10_000):
        got = scan(
            df, ["k"], ["at", "id"], width=width, number="n", lag={"p": F.col("v")}, lead={"q": F.col("v")},
            running={"s": F.col("v")}, last_seen={"l": F.col("v")},
        )
        got = preceding(got, ["k"], ["at", "id"], size=4, item=F.col("id"), name="c", width=width)
        assert got.exceptAll(plain.select(*got.columns)).count() == 0


def test_session_border(spark):
    m = chat(spark, [("c", i, "Ann", "x", t) for i, t in enumerate([0, 120, 120 + 1500, 120 + 3000 + 1])])
    assert rows_of(normalize.sessionize(m), "seq", "session_no") == [(0, 1), (1, 1), (2, 1), (3, 2)]
    rolled = normalize.session_rollup(normalize.sessionize(m, width=60))
    assert rows_of(rolled, "session_id", "message_count") == [("session_0001", 3), ("session_0002", 1)]


def test_speakers(spark):
    m = chat(spark, [("c", i, s, "x", i) for i, s in enumerate(["bob", "Ann", "ANN", "Ann", "bob", "Cid"])])
    assert rows_of(normalize.pick_speakers(m), "target", "counterpart") == [("bob", "Ann")]
    given = normalize.pick_speakers(m, target="ann", counterpart="Ann")
    assert rows_of(given, "target", "counterpart") == [("ann", "bob")]
    assert normalize.mark_target(m.drop("is_target"), given).filter("is_target").count() == 3


def sessions(spark, n, per=2):
    rows = []
    for s in range(n):
        for i in range(per):
            rows += [("c", s * 100 + 2 * i, "Bob", f"q {s} {i}", s * 1e5 + 20 * i), ("c", s * 100 + 2 * i + 1, "Ann", f"answer number {s} {i}", s * 1e5 + 20 * i + 5)]
    return normalize.sessionize(chat(spark, rows))


def test_splits_keep_sessions_apart(spark):
    t = turns.split_turns(turns.build_turns(sessions(spark, 10)))
    assert t.groupBy("session_no").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert rows_of(t.groupBy("split").agg(F.count_distinct("session_no").alias("n")), "split", "n") == [("test", 1), ("train", 8), ("validation", 1)]


def test_sequential_split_and_no_target(spark):
    t = turns.split_turns(turns.build_turns(sessions(spark, 1, 4)))
    assert [r["split"] for r in t.orderBy("seq").collect()] == ["train", "train", "test", "test"]
    assert turns.build_turns(sessions(spark, 1).withColumn("is_target", F.lit(False))).count() == 0


def brute(a, b, threshold=0.9):
    def grams(t):
        return {t[i : i + 3] for i in range(len(t) - 2)}

    out = {}
    for bi, bt in b:
        for ai, at in sorted(a):
            ga, gb = grams(at), grams(bt)
            if at == bt or (len(at) >= 3 and len(bt) >= 3 and len(ga & gb) / len(ga | gb) > threshold):
                out[bi] = ai
                break
    return out


def test_leakage_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(20, 60))) for _ in range(6)] + ["ab", "xy"]

    def near(t):
        return t + "!" if rnd.random() < 0.5 else t[:-1] if rnd.random() < 0.5 else t[: len(t) // 2] + "#" + t[len(t) // 2 :]

    # One text makes up a third of everything, as copies and near copies.
    texts = [rnd.choice(base) for _ in range(60)] + [near(base[0]) for _ in range(60)] + [near(rnd.choice(base)) for _ in range(60)]
    rnd.shuffle(texts)
    a = [(i, t) for i, t in enumerate(texts[:120])]
    b = [(1000 + i, t) for i, t in enumerate(texts[120:])]
    want = brute([(i, t.strip().lower()) for i, t in a], [(i, t.strip().lower()) for i, t in b])
    da, db = (spark.createDataFrame(x, "id long, body string") for x in (a, b))
    for first_round in (1, 8, 1000):
        pairs = leakage.contamination_pairs(da, db, text="body", id="id", order="id", first_round=first_round)
        assert {r["b_id"]: r["a_id"] for r in pairs.collect()} == want


def test_leakage_audit(spark):
    rows = [(1, "the same reply here", "train"), (2, "The same reply here ", "test"), (3, "the same reply here!", "validation"), (4, "unrelated words", "test")]
    df = spark.createDataFrame(rows, "id long, body string, split string")
    kept, pairs = leakage.audit(df, text="body", id="id", order="id")
    assert rows_of(kept, "id") == [(1,), (4,)]
    out = leakage.isolation_report(kept, pairs).collect()[0]
    assert (out["train_test_duplicates"], out["near_duplicates"], out["passed"]) == (1, 1, False)
    assert kept.join(leakage.contamination_pairs(kept.filter("split='train'"), kept.filter("split='test'"), text="body", id="id", order="id"), F.col("id") == F.col("b_id")).count() == 0


def test_jaccard(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("ab", "abc"), ("abcd", "abce")], "a string, b string")
    assert [r[0] for r in df.select(ngram_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


def test_cleaning(spark):
    rows = [("hi [图片] there",), ("群公告：今天",), ("### 2026-05-27 星期三",), ("[表情包]",), ("ok\n李四 拍了拍 你",), ("a​b",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(clean.clean_message("s"), clean.is_polluted("s"), clean.sanitize_message("s")["media_type"]).collect()]
    assert got == [("hi there", True, "image"), ("", True, "system"), ("", True, "text"), ("", True, "sticker"), ("", True, "system"), ("ab", False, "text")]


def test_rhythm(spark):
    rows, at = [], 0.0
    for size, delay in ((10, 2.2), (40, 3.8), (100, 6.2)) * 3:
        rows += [("c", len(rows), "Bob", "q", at), ("c", len(rows) + 1, "Ann", "x" * size, at + delay)]
        at += 100.3
    table = rhythm.rhythm_table(chat(spark, rows)).collect()[0]
    assert (table["short_median_ms"], table["medium_median_ms"], table["long_median_ms"]) == (2200, 3800, 6200)
    assert not table["is_minute_quantised"] and not table["is_default"]
    whole = [(c, i, s, x, 60.0 * i) for i, (c, _, s, x, _) in enumerate(rows)]
    table = rhythm.rhythm_table(chat(spark, whole)).collect()[0]
    assert table["is_minute_quantised"] and (table["median_ms"], table["p90_ms"]) == (2800, 7500)


def test_emoji_alignment(spark):
    texts = spark.createDataFrame([("c", i, "哈哈 😂" if i else "晚安 😴") for i in range(100)], "chat_id string, seq long, text string")
    turn = spark.createDataFrame([("c", [("Bob", "难过")], "抱抱 😂")], "chat_id string, context array<struct<sender string, content string>>, target_message string")
    table = {r["asset"]: r for r in assets.emoji_table(texts, turn, ["chat_id"]).collect()}
    assert set(table["😂"]["contexts"]) == {"joking", "affection", "sadness"} and table["😂"]["raw_count"] == 99
    assert set(table["😴"]["contexts"]) == {"tired_night", "tired_sleep"}
    assert abs(sum(table["😂"]["context_distribution"].values()) - 1) < 0.001


def test_conditional_style(spark):
    df = spark.createDataFrame([("c", [("Bob", "哈哈")], "😂"), ("c", [("Bob", "哈哈")], "no")], "chat_id string, context array<struct<sender string, content string>>, target_message string")
    out = {r["condition"]: r for r in style.conditional_style(style.features(df), ["chat_id"]).collect()}
    assert (out["joking"]["sample_size"], out["joking"]["raw_count"], out["joking"]["probability"]) == (2, 1, 0.5)
    assert (out["serious"]["probability"], out["serious"]["confidence"]) == (0.5, 0.0)


def test_fingerprint_of_nothing(spark):
    m = chat(spark, [("c", 1, "Ann", "[图片]", 0.0)])
    out = language.fingerprint(m, ["chat_id"], ["chat_id"]).collect()[0]
    assert out["sample_size"] == 0 and out["ellipsis_rate"] == 0.0 and out["top_vocabulary"] is None


SAMPLE = "sample_id long, speaker string, context array<struct<sender string, content string>>, target string, candidate string"


def test_baselines(spark):
    said = ["好呀好呀~ 😂", "今天去图书馆吗?", "晚安啦", "哈哈哈 笑死我了"]
    other = ["As a large model I would like to provide a detailed explanation of everything.", "非常抱歉，很高兴为您服务。", "x", "您好。"]
    rows = [(i, "s", [("Bob", "在吗?")], t, t) for i, t in enumerate(said)] + [(10 + i, "s", [("Bob", "在吗?")], t, c) for i, (t, c) in enumerate(zip(said, other))]
    out = {r["sample_id"]: r for r in scoring.score_samples(spark.createDataFrame(rows, SAMPLE)).collect()}
    for i in range(4):
        assert all(out[i][d] == 1.0 for d in ("lexical", "style", "behavior", "context_score"))
        assert out[10 + i]["lexical"] < 0.75


def test_report(spark):
    columns = "speaker string, sample_id long, lexical double, style double, behavior double, context_score double, judge_score double, issues array<string>"
    rows = [("a", 1, 0.85, 0.90, 0.80, 0.95, 0.85, []), ("b", 2, 0.8, 0.8, 0.8, None, 0.8, ["too long"])]
    df = spark.createDataFrame(rows, columns)
    groups = spark.createDataFrame([("a",), ("b",), ("z",)], "speaker string")
    out = {r["speaker"]: r for r in report.evaluation_report(df, ["speaker"], groups).collect()}
    assert (out["a"]["dsi"], out["a"]["status"]) == (0.863, "PASS")
    assert out["b"]["dsi"] == 0.8 and out["b"]["context_score"] is None and out["b"]["context_pass"]
    assert out["z"]["status"] == "INSUFFICIENT_DATA" and out["z"]["lexical"] is None
    assert rows_of(report.failure_cases(df, ["speaker"]), "sample_id") == [(2,)]


def test_memory_versions_and_retrieval(spark):
    rows = [("1", "p", "L2", "profile", "profile:city", "lives in Rome", 0.6, 1, 0.8), ("2", "p", "L2", "profile", "profile:city", "lives in Oslo", 0.6, 2, 0.8),
            ("3", "p", "L1", "episode", "e", "first trip to Oslo", 0.6, 1, 0.8)]
    df = spark.createDataFrame(rows, "id string, persona_id string, layer string, category string, key string, value string, importance_score double, d long, confidence double")
    df = df.withColumn("valid_from", F.timestamp_seconds(F.col("d") * 86400)).drop("d")
    versions = memory.supersede(df, ["persona_id", "key"])
    assert rows_of(versions.filter("valid_to is not null"), "id") == [("1",)]
    asked = spark.createDataFrame([(1, "p", "where is Oslo")], "query_id long, persona_id string, query string")
    got = memory.retrieve_topk(asked, versions, F.timestamp_seconds(F.lit(3 * 86400)))
    assert rows_of(got, "id") == [("2",), ("3",)]


def test_replies(spark):
    rows = [("<think>a</think>\n\"User: 你好。\"",), ('```json\n{"reply": "hey."}\n```',), ("作为AI，我不能。好呀",), ("Ann：「嗯」",), ("a\nb\nc",), ("我是aix",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(replies.clean_reply("s", "Ann")).collect()]
    assert got == ["你好", "hey", "好呀", "嗯", "a b", "我是aix"]


def test_items_are_found_whatever_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLES_A_BLOCK", 7)
    monkeypatch.setattr(scoring, "ITEMS_A_BLOCK", 5)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abé喜") for _ in range(rnd.randint(1, 3)))
    samples = [(k, f"s{k % 3}", " ".join(word() for _ in range(4)), " ".join(word() for _ in range(3))) for k in range(90)]
    items = [(f"s{rnd.randrange(4)}", k, word()) for k in range(60)]
    texts = spark.createDataFrame(samples, "sample_id long, speaker string, around string, said string")
    known = spark.createDataFrame(items, "speaker string, __key long, value string")
    got = {tuple(r) for r in scoring.found_items(texts, known, "sample_id", "speaker").collect()}
    assert got == {(i, k, v in said) for i, s, around, said in samples for t, k, v in items if s == t and (v in said or v in around)}
    assert scoring.found_items(texts, known.filter("false"), "sample_id", "speaker").count() == 0


def test_leakage_leaves_little_on_disk(spark):
    """What the join keeps between its steps is less than the texts, and texts of one vocabulary do not all meet."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(100, 400))) for _ in range(300)]
    texts[250:260] = [t.replace(t[40:46], "xyxyxy", 1) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    before = size()
    pairs = leakage.contamination_pairs(df.filter("id < 200"), df.filter("id >= 200"), text="body", id="id", order="id")
    assert size() - before < sum(map(len, texts))
    assert {r["b_id"]: r["a_id"] for r in pairs.collect()} == brute(list(enumerate(texts[:200])), list(enumerate(texts))[200:])


def _shuffled(spark, job):
    """Bytes of the shuffle files that ``job`` writes."""
    folders = [f.toString() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f: os.path.getsize(os.path.join(at, f)) for x in folders for at, _, names in os.walk(x) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    job()
    return sum(size for f, size in files().items() if f not in before)


def _one_vocabulary(seed, count):
    """Texts that share most of their n-grams and yet are not similar, but for a few."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(100, 200))) for _ in range(count)]
    texts[-10:] = [t.replace(t[40:46], "xyxyxy", 1) for t in texts[:10]]
    return texts


def test_leakage_shuffles_in_proportion_to_the_texts(spark):
    """Texts that merely share parts of their n-grams make no rows."""
    texts = _one_vocabulary(12, 600)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    pairs = []
    shuffled = _shuffled(spark, lambda: pairs.extend(
        leakage.contamination_pairs(df.filter("id < 400"), df.filter("id >= 400"), text="body", id="id", order="id").collect()
    ))
    assert {r["b_id"]: r["a_id"] for r in pairs} == brute(list(enumerate(texts[:400])), list(enumerate(texts))[400:])
    assert shuffled < 0.4 * sum(map(len, texts))


def test_leakage_ties_scopes_and_texts_without_ngrams(spark):
    body = "the same long reply here with many words in it"
    a = [(1, 7, "s", body + "!"), (2, 7, "s", body + "?"), (3, 1, "t", body), (4, 2, "s", "ab"), (5, 2, "s", None), (6, 3, None, body), (7, 0, "s", "")]
    b = [(11, 0, "s", body), (12, 0, "u", body), (13, 0, "s", "AB "), (14, 0, "s", None), (15, 0, None, body + "."), (16, 0, "s", "abc"), (17, 0, "s", " ")]
    da, db = (spark.createDataFrame(x, "id long, at long, chat string, body string") for x in (a, b))
    pairs = leakage.contamination_pairs(da, db, text="body", id="id", order="at", within=["chat"])
    first = min((1, 2), key=lambda i: hashlib.sha256(("s\x1f" + a[i - 1][3]).encode()).hexdigest())
    assert sorted((r["b_id"], r["a_id"], r["kind"]) for r in pairs.collect()) == [
        (11, first, "near"), (13, 4, "exact"), (14, 5, "exact"), (15, 6, "near"), (17, 7, "exact"),
    ]


def test_audit_keeps_apart_ids_that_both_splits_have(spark):
    rows = [(1, "the same reply here", "train"), (2, "The same reply here ", "test"), (2, "something else", "validation"), (None, "the same reply here!", "test")]
    df = spark.createDataFrame(rows, "id long, body string, split string")
    kept, pairs = leakage.audit(df, text="body", id="id", order="id")
    assert sorted((r["id"] or 0, r["split"]) for r in kept.collect()) == [(0, "test"), (1, "train"), (2, "validation")]
    assert sorted((r["b_id"] or 0, r["pass"]) for r in pairs.collect()) == [(0, "train_test"), (2, "train_test")]


def test_ngrams_are_no_rows(spark):
    rows = [(1, "Aab", "aB"), (1, "b😂b", "ab"), (None, "abc", "abd"), (None, "x", ""), (2, "", ""), (3, None, "a"), (4, "a", "z")]
    out = scoring.char_ngram_cosine(spark.createDataFrame(rows, "sample_id long, target string, candidate string"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()

    def cosine(pairs):
        total = 0.0
        for n, w in scoring.NGRAM_WEIGHTS.items():
            x, y = (Counter(g for p in pairs for g in (p[s].lower()[i : i + n] for i in range(len(p[s]) - n + 1))) for s in (0, 1))
            norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            total += w * sum(v * y[g] for g, v in x.items()) / norm if norm else 0.0
        return round(total, 9)

    want = {k: cosine([r[1:] for r in rows if r[0] == k]) for k in (1, None, 4)}
    assert {r["sample_id"]: round(r["ngram_score"], 9) for r in out.collect()} == want


def test_turns_without_numbers(spark):
    rows = [(1, 1, k, "ab"[k % 2], f"text {k}", k % 2 == 1) for k in range(9)]
    m = spark.createDataFrame(rows, "chat_id long, session_no long, seq long, sender string, content string, is_target boolean")
    plain, numbered = turns.build_turns(m, ts=None, numbered=False), turns.build_turns(m, ts=None)
    assert sorted(plain.collect()) == sorted(numbered.drop("turn_no", "turn_id").collect())
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") < numbered._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_cosine_and_scores_read_one_exchange(spark, tmp_path):
    rows = [(k % 40, "s", [("Bob", "x")], f"text {k % 40}", f"Text {k % 39}") for k in range(40)] + [(None, "s", [], "a", "b"), (7, "s", [], None, "b"), (99, "s", [], "", "")]
    spark.createDataFrame(rows, SAMPLE).write.parquet(str(tmp_path / "samples"))
    df = spark.read.parquet(str(tmp_path / "samples"))
    out = scoring.lexical_score(df).select("sample_id", "target", "ngram_score", "lexical")
    got = out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    want = {r["sample_id"]: r["ngram_score"] for r in scoring.char_ngram_cosine(df).collect()}
    assert len(got) == len(rows) and 99 not in want
    assert all(r["ngram_score"] == (0.0 if r["sample_id"] is None else want.get(r["sample_id"], 0.0)) for r in got)
    # Columns that need no cosine do not run it.
    assert "MapInArrow" not in scoring.lexical_score(df).select("sample_id", "target")._jdf.queryExecution().executedPlan().toString()


def test_grounding_adds_up_hits_where_they_are_found(spark, monkeypatch):
    """Ids that several samples, or several speakers, have; items that come twice; nulls; blocks of a few rows."""
    monkeypatch.setattr(scoring, "SAMPLES_A_BLOCK", 7)
    monkeypatch.setattr(scoring, "ITEMS_A_BLOCK", 5)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abAé喜") for _ in range(rnd.randint(1, 3)))
    text = lambda n: rnd.choice([None, *[" ".join(word() for _ in range(n)) for _ in range(9)]])
    samples = [(rnd.choice([None, *range(50)]), rnd.choice([None, "p", "q", "r"]), [("Bob", word())], text(3), text(4)) for _ in range(90)]
    items = [(rnd.choice([None, "p", "q", "z"]), rnd.choice([None, "entity", "fact"]), rnd.choice([None, word()]), rnd.choice([None, "", word()]),
              rnd.choice([None, [], [word(), None, word()]]), rnd.choice([None, True, False])) for _ in range(60)]
    items += items[:20]
    known = spark.createDataFrame(items, "speaker string, kind string, label string, value string, contradictions array<string>, negated boolean")
    found = scoring.grounding(spark.createDataFrame(samples, SAMPLE), known)
    # A hit is no row, so neither items nor texts are joined to hits.
    assert "in_said" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for id, who, context, target, said in samples:
        alike = [(s[4] or "").lower() for s in samples if s[0] == id]
        around = "\x1f".join([context[0][1], *([target] if target is not None else [])]).lower()
        for scope, kind, label, value, wrong, negated in items:
            if id is None or who is None or scope != who or not value:
                continue
            now = value.lower() in (said or "").lower()
            if not now and value.lower() not in around:
                continue
            grounded, issues = want.setdefault(id, [0, []])
            want[id][0] = grounded + now * len(alike)
            for other in alike if now else []:
                if kind == "entity":
                    issues += [label and f'entity contradiction: "{label}" with "{c}"' for c in wrong or [] if c is not None and c.lower() in other]
                elif negated:
                    issues.append(label and f'fact contradiction: "{label}" asserted when negated')
    got = {r["sample_id"]: r for r in found.collect()}
    assert got.keys() == want.keys() and any(v[1] for v in want.values())
    for id, (grounded, issues) in want.items():
        assert (got[id]["grounded"], got[id]["contradicted"]) == (grounded, len(issues))
        assert sorted(got[id]["grounding_issues"], key=str) == sorted(issues, key=str)


def test_scored_samples_are_kept_without_their_profile(spark, tmp_path):
    from colloquy.queries import scores

    rows = [(c, t, "assistant" if t % 2 else "user", f"the words of turn {t}. and la {c} more.") for c in range(3) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = scores._scored(spark, str(tmp_path)).select("sample_id", "issues", "context_score", "lexical")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "policies" not in plan
    # The texts of the grounding do not run the cosine once more.
    assert plan.count("MapInArrow") == 1
