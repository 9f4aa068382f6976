import itertools
import math
import random

from pyspark.sql import functions as F

from colloquy.functions import segment
from colloquy.operators import language


def cheapest(run, words, unknown):
    """All cuts of a run, tried one after the other."""
    total = sum(words.values())
    best = math.inf
    for ends in itertools.product([False, True], repeat=len(run) - 1):
        parts, start = [], 0
        for i, end in enumerate([*ends, True], 1):
            if end:
                parts.append(run[start:i])
                start = i
        if all(p in words or len(p) == 1 for p in parts):
            best = min(best, sum(min(-math.log(words[p] / total) if p in words else math.inf, unknown if len(p) == 1 else math.inf) for p in parts))
    return best


def test_the_path_is_the_cheapest():
    rnd = random.Random(1)
    for _ in range(200):
        words = {"".join(rnd.choice("天地人") for _ in range(rnd.randint(1, 4))): rnd.choice([1.0, 2.0, 9.0]) for _ in range(rnd.randint(1, 8))}
        trie, unknown = segment.trie_of(words), rnd.choice([0.5, 3.0, 20.0])
        run = "".join(rnd.choice("天地人和") for _ in range(rnd.randint(1, 9)))
        parts = segment.best_path(run, trie, unknown)
        assert "".join(parts) == run
        cost = sum(min(-math.log(words[p] / sum(words.values())) if p in words else math.inf, unknown if len(p) == 1 else math.inf) for p in parts)
        assert math.isclose(cost, cheapest(run, words, unknown))


def test_ambiguous_words_and_other_scripts(spark):
    # The greedy cut would be 研究生 + 命.
    cut = segment.segmenter({"研究": 5, "研究生": 1, "生命": 5, "起源": 3})
    rows = [(1, "研究生命起源 Hello it's 2024 😂😂"), (2, "研究 生命"), (3, ""), (4, None), (5, "山水研究生")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r.t for r in df.select("k", cut("text").alias("t")).collect()}
    assert got == {1: ["研究", "生命", "起源", "hello", "it's", "2024", "😂😂"], 2: ["研究", "生命"], 3: [], 4: None, 5: ["山", "水", "研究生"]}
    grams = language.ngrams(df.filter("k < 3"), ["k"], 2, cut)
    assert {(r.k, r.token) for r in grams.collect()} >= {(1, "研究生命"), (1, "起源 hello"), (2, "研究生命")}
    assert language.unigrams(df.filter(F.lit(False)), ["k"], cut).count() == 0
