import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives as hn


def brute(rows, every=10, n_positives=5, n_negatives=5):
    ok = [(i, l, np.array([math.floor(4 * x) for x in v])) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, l, np.pad(v, (0, dims - len(v)))) for i, l, v in ok]
    out = []
    for k, (i, l, v) in enumerate(ok):
        if i % every:
            continue
        scored = [(-int(v @ w), j, m) for n, (j, m, w) in enumerate(ok) if n != k]
        positives = sorted((s, j) for s, j, m in scored if m == l)[:n_positives]
        for s, j in positives:
            fit = sorted((t, n) for t, n, m in scored if m != l and 80 * -s <= 100 * -t <= 100 * -s)[:n_negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def of(spark, rows):
    return spark.createDataFrame([(i, l, v, 1, 2) for i, l, v in rows], "vec_id long, label int, embedding array<double>, row int, score int")


def test_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 16)
    monkeypatch.setattr(hn, "SLICE", 7)
    monkeypatch.setattr(hn, "TOGETHER", 3)
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(300):
        scale = rng.choice([0.0, 0.5, 2, 2, 30])
        rows.append((i, rng.randrange(4), [scale * (c + rng.gauss(0, 0.3)) for c in rng.choice(centres)]))
    hot = [1.5, -2.0, 3.0, 0.25, 0.0, -1.0]
    rows += [(300 + i, i % 2, hot) for i in range(100)]  # a very common vector, ties by id
    rows += [(500, 1, None), (510, None, hot), (None, 1, hot), (520, 1, [1.0, None, 2.0]), (530, 1, [float("nan")] * 6), (540, 1, [float("inf")] * 6)]
    rows += [(0, 2, hot), (0, 2, hot), (10, 3, [1.0, 2.0]), (550, 1, []), (560, 9, hot), (570, -3, [1e6, -2e6, 3e6, 0.0, 1.0, 2.0])]
    got = sorted(tuple(r) for r in hn.mine(of(spark, rows), anchors="id % 10 = 0", scale=4.0).collect())
    assert got == brute(rows) and len(got) > 500


def test_few_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 0, [1.0, 2.0])]
    got = sorted(tuple(r) for r in hn.mine(of(spark, rows), scale=4.0).collect())
    assert got == brute(rows, every=100) and len(got) == 1
    assert hn.mine(of(spark, rows[:1])).count() == 0
    assert hn.mine(of(spark, rows).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("cosine", [0.2, 0.7, 0.95, 1.0])
def test_ranges_lose_no_row_and_exclude_some(cosine):
    rng = np.random.default_rng(5)
    unit = hn._unit((rng.normal(size=(3000, 6)) * 100).astype(np.int64))
    order = np.argsort(unit, axis=0, kind="stable").T
    pruned = 0
    for k in range(60):
        found = hn.feasible(unit[k], cosine, unit, order)
        if found is not None:
            assert set(np.flatnonzero(unit @ unit[k] >= cosine - 1e-12)) <= set(found)
            pruned += 1
    assert pruned > 0 or cosine < 0.7


def test_large_values_stay_exact():
    a = np.array([[2**30, 1], [3, -5]], np.int64)
    assert hn.products(a, a).tolist() == [[2**60 + 1, 3 * 2**30 - 5], [3 * 2**30 - 5, 34]]
