import hashlib
import random

from pyspark.sql import functions as F

from colloquy.llm import fill_in_middle as fim


def brute(i, text):
    t = text or ""
    digits = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(t), "plain", None, None, t
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(t), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_equal_to_slices_and_restored(spark):
    rng = random.Random(3)
    alphabet = "ab \n\r\t \u0085é中😀\U0010ffff\x00$\\1<>PSM"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 255, 256, 257, 700])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "x<S>"), (1004, "<M>"), (1005, "<P"), (None, "no id"), (None, None)]
    rows += [(7, "twice"), (7, "twice"), (7, "thrice"), (1006, "long 😀\n" * 200_000), (1007, "$1\\2" * 300), (-5, "minus")]
    docs = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    done = fim.transform(docs)
    back = done.select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_percentages_and_empty_table(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    forms = {r.form for r in fim.transform(docs, seed="s", plain_percent=0, spm_percent=100).collect()}
    assert forms == {"spm"}
    assert fim.transform(docs.filter(F.lit(False))).count() == 0


def test_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fim.transform(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
