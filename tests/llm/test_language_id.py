import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import language_id as lid


def brute_phrases(text, reference):
    n = 0
    for b in range(0, len(text), lid.BLOCK):
        block, i = text[b : b + lid.BLOCK], 0
        while i < len(block):
            size = 1
            while i + size <= len(block) and any(block[i : i + size] in r for r in reference):
                size += 1
            i += max(1, size - 1)
            n += 1
    return n


def test_phrases_equal_a_plain_parse():
    rng = random.Random(2)
    class_of = np.full(256, 1, np.uint8)
    class_of[list(b"abc ")] = range(2, 6)
    reference = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (40, 1, 80)]
    table = lid.parser(reference, class_of, 6)
    texts = [b"", b"a", b"zzz", b"abzca"] + [bytes(rng.choice(b"abc z") for _ in range(rng.choice([3, 50, 2500]))) for _ in range(30)]
    offsets = np.cumsum([0, *map(len, texts)])
    got = lid.count_phrases(class_of[np.frombuffer(b"".join(texts), np.uint8)], offsets, [table], 6)[:, 0]
    assert got.tolist() == [brute_phrases(t, reference) for t in texts]


def test_identify(spark):
    rng = random.Random(4)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "ung", "öch"], "zz": ["ption", "ère"]}
    text = lambda l, n: " ".join("".join(rng.choice(parts[l]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(l, rng.randint(3, 60)), l, "s") for i, l in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "123 ... 😀", "yy", "s"), (None, text("zz", 20), None, "s"), (7, text("yy", 20000), None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits string")
    got = lid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    assert sum((i, l) in by for i, _, l, _ in rows[:180]) == 180
    assert all(by[(i, "und")].score == 0 for i in (1000, 1001, 1002)) and (None, "zz") in by and (7, "yy") in by
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lid.identify(bare).collect()} == {"und"}
    assert lid.identify(docs.filter(F.lit(False))).count() == 0
