import re

from pyspark.sql import functions as F

from colloquy.llm import decontamination as dec


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        b = words(t)
        m = min(n, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


ITEMS = [(1, "One two three four five"), (2, "eins ZWEI drei"), (3, "x"), (4, ""), (5, None), (None, "naïve Über 東京 test case"), (1, "One two three four five")]
TEXTS = [
    None, "", "...", "one, two THREE four", "a one two three four five b", "one two three four five one two three four five",
    "zwei drei", "eins zwei drei", "x", "it is x and x", "naïve Über 東京 test case again", "naïve über 東京 test", "y" * 5000 + " one two three four " + "z " * 3000,
    "a one two three four five b",
]


def test_scan_and_removal(spark):
    docs = spark.createDataFrame([(i, t, "c", "g") for i, t in enumerate(TEXTS)] + [(None, "x", "c", "g"), (4, "other", "c", "g")], "doc_id long, text string, h string, gram string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    for limit in (1000, 0):  # with and without a broadcast
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items, r.contaminated) for r in dec.scan(docs, bench, 4, limit).collect())
        want = [(str(r.doc_id), *brute(r.text, ITEMS, 4)) for r in docs.collect()]
        assert got == sorted((*w, w[2] > 0) for w in want)
    clean = dec.remove_documents(docs, bench, 4)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect() if not brute(r.text, ITEMS, 4)[1])
    cut = {(r.doc_id, r.text) for r in dec.remove_spans(docs, bench, 4).collect()}
    assert {(4, "a      b"), (8, ""), (9, "it is  and "), (6, "zwei drei"), (4, "other"), (None, ""), (0, None)} <= cut


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dec.scan(docs.filter(F.lit(False)), bench).count() == 0
    assert [tuple(r) for r in dec.scan(docs, bench.filter(F.lit(False))).collect()] == [(1, 3, 0, 0, [], False)]
    assert dec.remove_documents(docs, bench).count() == 0
