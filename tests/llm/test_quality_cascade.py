import random
import re

from pyspark.sql import functions as F

from colloquy.llm import quality_cascade as qc


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 3)}
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    dups = sum(l in lines[:i] for i, l in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(hit)


def test_cascade(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "x\nx\n \n x\nx", "#$% <> |", "é" * 9000, "w " * 3000]
    texts += [" ".join(rng.choice(["aa", "b|", "cc\n", "dé"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(20)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "x y", "k", 1), (3, "one", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, h int")
    got = qc.cascade(docs, sample_rows=20).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (r.failed_rule is None) and not (r.kept and r.base_failed)
    assert sum(r.kept for r in got) >= 20
    assert qc.cascade(docs.filter(F.lit(False))).count() == 0


def test_order_is_by_rejections_per_cost():
    rules = [qc.Rule(n, None) for n in "abcd"]
    found = {"a": (10, 10.0), "b": (5, 1.0), "c": (0, 1.0), "d": (0, 0.5)}
    assert [r.name for r in qc.order(rules, found)] == ["b", "a", "d", "c"]
