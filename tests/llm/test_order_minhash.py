import random
import re

from pyspark.sql import functions as F

from colloquy.llm import order_minhash as om


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower()) or [("raw", t or "")]


def similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(rows):
    s = [words(t) for _, t in rows]
    label = list(range(len(rows)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if min(len(s[i]), len(s[j])) >= 0.8 * max(len(s[i]), len(s[j])) and similarity(s[i], s[j]) >= 0.8:
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(-1 if d is None else d)
    return sorted(((-1 if d is None else d), min(groups[find(i)]), len(groups[find(i)])) for i, (d, _) in enumerate(rows))


def test_classes_equal_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [a + b for a in ("ka", "lo", "mé", "tri") for b in ("s", "nt", "rr", "un")]
    rows = []
    for base in range(14):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 120]))]
        for _ in range(rng.randint(1, 6)):
            w = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["X", "y2", "zz"])
            rows.append((len(rows), rng.choice([" ", ", "]).join(w).capitalize()))
    rows += [(500, None), (501, ""), (502, "..."), (503, "..."), (504, "!"), (505, "it " * 900), (506, "it " * 901), (507, "one"), (508, "One."), (None, rows[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, keys string")
    got = om.classes(docs).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), (-1 if r.class_id is None else r.class_id), r.class_size) for r in got) == brute(rows)
    assert sum(r.stays for r in got) == len({r.class_id for r in got})
    kept = om.keep_first(docs).collect()
    assert len(kept) == len({r.class_id for r in got}) and {r.doc_id for r in kept} == {r.class_id for r in got} and kept[0].keys == "k"


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, k) for k in range(201, 280)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = om.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {n: l for n, l in label.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert om.classes(docs.filter(F.lit(False))).count() == 0
    assert [tuple(r) for r in om.classes(docs).collect()] == [(1, 1, 1, True)]


def test_alignment_equals_the_whole_table():
    rng = random.Random(5)
    for k in range(300):
        a = [rng.choice("abcdefgh" if k % 3 else "ab") for _ in range(rng.randint(1, 300))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 8))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["a", "b"]])
        b = b or ["a"]
        exact = similarity(a, b)
        assert om.aligned(om.places_of(a), len(a), b, 0.8) == (exact if exact >= 0.8 else 0.0)


def test_near_copies_by_edit_rate(spark):
    rng = random.Random(17)
    rows, least = [], {0.01: 40, 0.03: 39, 0.05: 36}
    for rate in least:
        for k in range(40):
            text = [f"w{rng.randrange(3000)}" for _ in range(300)]
            copy = [f"x{rng.randrange(3000)}" if rng.random() < rate else w for w in text]
            rows += [(f"{rate}", " ".join(text)), (f"{rate}", " ".join(copy))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in om.classes(docs).collect()}
    for at, rate in enumerate(least):
        assert sum(found[80 * at + 2 * k + 1] == 80 * at + 2 * k for k in range(40)) >= least[rate]
    assert all(found[2 * k] == 2 * k for k in range(120))
