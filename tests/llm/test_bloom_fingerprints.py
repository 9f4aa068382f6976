import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bloom_fingerprints as bf

ODD = 0x9E3779B97F4A7C15


def pieces(text):
    """The pieces of a text, one byte after the other, with their occurrence numbers."""
    data, out, piece, window = text.encode(), [], b"", 0
    for c in data:
        window = (window << 8 | c) & (1 << 64) - 1
        piece += bytes([c])
        # The window of the module holds the newest byte lowest.
        if c == 10 or (window * ODD & (1 << 64) - 1) >> (64 - bf.CUT_BITS) == 0:
            out, piece = [*out, piece], b""
    seen, labelled = Counter(), set()
    for p in [*out, piece] if piece else out:
        labelled.add((p, seen[p]))
        seen[p] += 1
    return labelled


def jaccard(a, b):
    x, y = pieces(a), pieces(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def words(rng, n):
    return "".join(rng.choice(["lorem ", "ipsum ", "dolor\n", "zażółć ", "日本語", "x", "\n", "amet. "]) for _ in range(n))


@pytest.fixture
def rows():
    rng = random.Random(8)
    rows = [(3 * i, words(rng, rng.choice([0, 1, 3, 30, 200, 900]))) for i in range(150)]
    rows += [(1, None), (2, ""), (4, "same\n" * 300), (5, "same\n" * 301), (11, rows[40][1]), (7, rows[40][1]), (8, words(rng, 20_000)), (-9, "😀" * 500), (10, "\0\n\0")]
    return rows + [(None, words(rng, 50)) for _ in range(40)] + [(13, words(rng, 5)) for _ in range(60)] + [(13, "twin")] * 3


def ordered(spark, rows):
    """Rows by id, those of one id by the hash of their text, as the operator states."""
    df = spark.createDataFrame([(i, t or "", k) for k, (i, t) in enumerate(rows)], "i long, t string, k int")
    h = {r.k: r.h for r in df.select("k", F.xxhash64("t").alias("h")).collect()}
    key = lambda k: (rows[k][0] is not None, rows[k][0] or 0, h[k] % (1 << 16), h[k])
    return [(rows[k][0], rows[k][1] or "") for k in sorted(range(len(rows)), key=key)]


def test_neighbours_equal_plain_sets(spark, rows, monkeypatch):
    monkeypatch.setattr(bf, "CHUNK", 20_000)
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, to string, ghost int, h int").repartition(5)
    got = bf.neighbours(docs).collect()
    line, want = ordered(spark, rows), []
    for (i, t), (_, after) in zip(line, line[1:] + line[:1]):
        new = bf.edited(t, after)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(t, new), 9), round(jaccard(t, after), 9)))
    shown = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(shown, key=repr) == sorted(want, key=repr) and len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[11] == prints[7] == prints[120] and prints[1] == prints[2] and prints[4] != prints[5]
    assert {(r.doc_id, r.fingerprint) for r in bf.fingerprints(docs).collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_differing_digests_are_recovered(spark, rows):
    rng = random.Random(1)
    texts = [t for _, t in rows if t]
    pairs = [(k, t, rng.choice([t, t[: len(t) // 2], t + "more", rng.choice(texts)])) for k, t in enumerate(texts)] + [(None, None, ""), (-1, "", "a"), (-1, "", "a")]
    df = spark.createDataFrame(pairs, "doc_id long, before string, after string")
    got = bf.differences(df).collect()
    assert len(got) == len(pairs)
    by_id = {r.doc_id: r for r in got}
    for k, a, b in pairs:
        x, y, r = pieces(a or ""), pieces(b or ""), by_id[k]
        assert (len(r.removed), len(r.added)) == (len(x - y), len(y - x)) and abs(r.near - jaccard(a or "", b or "")) < 1e-9
        own = {int(d) for d in bf.digests_of([(a or "").encode()])[1].view(np.int64)}
        assert set(r.removed) <= own and not set(r.added) & own
    assert len({r.cells for r in got}) > 2  # small and larger tries were needed


def test_a_lone_document_and_none(spark):
    docs = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = bf.neighbours(docs).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0) and r.near_edited == 0.0
    assert bf.neighbours(docs.filter(F.lit(False))).count() == 0 and bf.fingerprints(docs.filter(F.lit(False))).count() == 0
