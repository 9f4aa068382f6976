import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import suffix_tree_lm as lm


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\0end"]


def brute_score(train, text, d_max=lm.DEPTH):
    """The same model straight from its definition, over strings of symbols and whole words."""
    seq = lambda t: [lm.BEGIN] * d_max + [max(2, b) for b in " ".join(tokens(t)[:-1]).encode()] + [lm.END]
    pair, total = Counter(), 0
    for t in train:
        s = seq(t)
        for i in range(d_max, len(s)):
            total += 1
            for d in range(d_max + 1):
                pair[(tuple(s[i - d : i]), s[i])] += 1
    count = Counter()
    for (c, _), n in pair.items():
        count[c] += n
    stored = {}
    for (c, x), n in pair.items():
        if not c or n >= lm.P_PAIR * total:
            stored.setdefault(c, {})[x] = n
    p0 = {x: (stored[()].get(x, 0) + 0.5) / (total + 128) for x in range(256)}
    dist = {(): p0}
    suffix = lambda c: next(c[i:] for i in range(1, len(c) + 1) if c[i:] in dist)
    for d in range(1, d_max + 1):
        fresh = {}
        for c in [c for c in count if len(c) == d and count[c] >= lm.P_MIN * total]:
            par, own = dist[suffix(c)], stored.get(c, {})
            gain = sum(n * math.log2(n / count[c] / par[x]) for x, n in own.items()) / total
            if gain >= lm.DIVERGENCE:
                rest = count[c] - sum(own.values()) + len(own)
                fresh[c] = {x: (own.get(x, 0) + rest * par[x]) / (count[c] + len(own)) for x in range(256)}
        dist |= fresh
    assert all(abs(sum(v.values()) - sum(p0.values())) < 1e-6 for v in dist.values())
    s = seq(text)
    used = lambda i: next(tuple(s[i - d : i]) for d in range(d_max, -1, -1) if tuple(s[i - d : i]) in dist)
    out = sum(math.log10(dist[used(i)][s[i]]) for i in range(d_max, len(s)))
    said = Counter(w for t in train for w in tokens(t)[:-1])
    stop = lambda i: dist[used(i)][lm.BLANK] + dist[used(i)][lm.END]
    i = d_max
    for w in tokens(text)[:-1]:
        end = i + len(w.encode())
        of_tree = sum(math.log10(dist[used(j)][s[j]]) for j in range(i, end))
        known = said[w] / max(1, sum(said.values())) * (1 - stop(i)) / stop(end)
        # log10 of ((1 - weight) * tree + weight * known) / tree
        out += math.log10(1 - lm.WORD_WEIGHT + (lm.WORD_WEIGHT * 10 ** (math.log10(known) - of_tree) if known else 0))
        i = end + 1
    return out


def test_score_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm, "P_MIN", 2e-3)
    monkeypatch.setattr(lm, "P_PAIR", 5e-4)
    monkeypatch.setattr(lm, "DIVERGENCE", 1e-4)
    monkeypatch.setattr(lm, "WORD_SHARE", 2e-3)
    monkeypatch.setattr(lm, "CHUNK", 500)
    rng = random.Random(6)
    words = ["the", "Then", "other", "é", "x1", "中文", "a"]
    texts = [None, "", " \t\n", "the", "the the", "zzz\x00q", "w" * 3000] + [" ".join(rng.choice(words) + rng.choice(["", "", "s", "."]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "the a", 0), (12, "again the", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in lm.score(docs).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t, _ in rows if not held(i)]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(got)
    for i, t, _ in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[(i, len(w), round(base, 6))]
        assert r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == n and r.held_out == held(i)
        assert abs(r.score - brute_score(train, t)) < 1e-3 * max(1, len(w))


def test_known_words_count_however_rare(spark):
    """A word of the training part is likelier than one that is not, though both are made of the same bytes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(14))
    said, new = [word() for _ in range(300)], [word() for _ in range(300)]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rest = [i for i in range(200, 220) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, " ".join(said)) for i in rest] + [(held, " ".join(said)), (held, " ".join(new))]
    got = [r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()]
    assert len(got) == 2 and max(got) - min(got) > 300 * 3


def test_words_with_control_characters_stay_whole_at_chunk_ends(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5)
    import pyarrow as pa

    s, _, _ = lm.symbols(pa.array(["ab\x07cd\x1fef gh \x0eij", "", "kl"]))
    whole = lm.word_hashes(s, lm.DEPTH, len(s))
    parts = [lm.word_hashes(s, a, b) for a, b in lm.chunks(s)]
    for i in range(3):
        assert np.concatenate([p[i] for p in parts]).tolist() == whole[i].tolist()


def test_empty_tables_and_blocks(spark):
    docs = spark.createDataFrame([(i, "some words here " * (200 * i)) for i in range(3)], "doc_id long, text string")
    assert lm.score(docs.filter(F.lit(False))).count() == 0
    assert lm.score(docs.filter("doc_id = 0")).count() == 1
    scores = {r.doc_id: r for r in lm.score(docs).collect()}
    assert scores[2].score > scores[2].base_score and np.isfinite(scores[0].score)
