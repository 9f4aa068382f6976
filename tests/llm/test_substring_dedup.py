import random
import re

from pyspark.sql import functions as F

from colloquy.llm import line_dedup
from colloquy.llm import substring_dedup as sd


def units(t):
    out, at = [], 0
    for u in re.sub(r"([.!?])[\x20\x09\x0B-\x0D]", "\\1\n", t or "").split("\n"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u))
        if w:
            out.append((at, at + len(u), tuple(w)))
        at += len(u) + 1
    return out


def brute(rows, min_words, solid):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        run = []
        for u in [*units(t), None]:
            if u and u[2] in first:
                run.append(u)
                continue
            while run and len(run[0][2]) < solid:
                run.pop(0)
            while run and len(run[-1][2]) < solid:
                run.pop()
            n = sum(len(x[2]) for x in run if len(x[2]) >= solid)
            if n >= min_words:
                out.append((i, run[0][0], run[-1][1], len(run), n, first[run[0][2]]))
            run = []
            if u:
                first[u[2]] = i
    return sorted(out, key=str)


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 200)
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(["la", "Mé", "rex", "ti-ta", "oh"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 2, 5, 8]))) + rng.choice(". . ! ? , \n .\n \n\n".split(" "))
    pool = [" ".join(sentence() for _ in range(3)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 4))] + rng.sample(pool, rng.randint(0, 2)) + [sentence() for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "... ?"), (103, "日本 語 の 行。 " * 3 + "x y z w. x y z w. x y z w v"), (104, "a b c d e f. " * 3000), (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, no int, d1 string")
    got = sorted((tuple(r) for r in sd.passages(docs, 9, 4).collect()), key=str)
    assert got == brute(rows, 9, 4) and len(got) > 20
    spans = {}
    for i, a, b, *_ in got:
        spans.setdefault(i, []).append((a, b))
    texts = dict(rows)
    for r in sd.remove_passages(docs, 9, 4).collect():
        want = texts[r.doc_id]
        for a, b in sorted(spans.get(r.doc_id, []), reverse=True):
            want = want[:a] + want[b:]
        assert r.text == want and r.d1 == "n"


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e. " * 9), (1, "a b c d e. " * 9)], "doc_id long, text string")
    assert [r.doc_id for r in sd.passages(docs).collect()] == [1]
    assert sd.passages(docs.filter(F.lit(False))).count() == 0
