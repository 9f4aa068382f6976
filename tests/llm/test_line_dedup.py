import random
import re

from pyspark.sql import functions as F

from colloquy.llm import line_dedup as ld


def lines_of(rows):
    out = []
    for i, t in rows:
        at = 0
        for no, line in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))
            if len(w) >= ld.MIN_WORDS:
                out.append((i, no, at, at + len(line), w))
            at += len(line) + 1
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    lines = sorted(lines_of(rows), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    out = []
    for k, (i, no, s, e, w) in enumerate(lines):
        for j, mo, _, _, v in lines[:k]:
            if w == v or (min(len(w), len(v)) >= ld.NEAR_WORDS and distance(w, v) <= 1):
                out.append((i, no, s, e, len(w), j, mo))
                break
    return sorted(out, key=str)


def test_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ld, "CHUNK", 300)
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([2, 4, 8, 9, 12, 30]))] for _ in range(25)]
    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(["é", "zz", "a", "a B"])] if rng.random() < 0.7 else []
            w = w or ["x"]
        return rng.choice([" ", "  "]).join(w).replace("c", rng.choice(["c", "C"]))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "日本 語 の 行 です ね は い\n" * 3), (104, "w " * 4000), (105, "w " * 3999), (None, "q r s t u v w x y"), (106, "q r s t u v w x z")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, keys int")
    got = sorted((tuple(r)[:7] for r in ld.duplicates(docs).collect()), key=str)
    assert got == brute(rows) and len(got) > 60
    kept = {r.doc_id: r for r in ld.remove_lines(docs).collect()}
    gone = {(r[0], r[1]) for r in got}
    for i, t in rows:
        left = None if t is None else "\n".join(l for no, l in enumerate(t.split("\n")) if (i, no) not in gone)
        if i in kept:
            assert kept[i].text == left and kept[i].keys == 2
        else:
            assert not left.strip()
    assert {100, 101, 102} <= set(kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h")], "doc_id long, text string")
    assert ld.duplicates(docs).count() == 0
    twins = spark.createDataFrame([(1, "a b c d"), (2, "x y z\na b c d"), (2, "a b c d\nx y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ld.remove_lines(twins).collect()) == [(1, "a b c d"), (2, "x y z")]
    assert ld.duplicates(docs.filter(F.lit(False))).count() == 0


def test_lines_that_share_id_and_number_are_told_apart(spark):
    base = [[f"{a}{k}" for a in "abcdefghi"] for k in range(24)]
    near = lambda k: " ".join([*base[k % 24][:4], "zz", *base[k % 24][5:]])
    plain = lambda k: " ".join(base[k % 24])
    rows = [(None, f"{plain(k)}\n{near(k + 5)}") for k in range(12)]
    rows += [(7, f"{near(k)}\n{plain(k + 1)}\nown{k} p q r s t u v w") for k in range(12, 24)]
    rows += [(9, f"x{k} y z\nown{k} p q r s t u v") for k in range(12, 24)] + [(9, near(k)) for k in range(24)]
    lines = sorted(lines_of(rows), key=lambda x: (x[0] or -1, x[1]))
    want = []
    for i, no, s, e, w in lines:
        same = [(j, mo) for j, mo, _, _, v in lines if (j or -1, mo) < (i or -1, no) and (w == v or (min(len(w), len(v)) >= ld.NEAR_WORDS and distance(w, v) <= 1))]
        want += [(i, no, s, e, len(w), *same[0])] if same else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r)[:7] for r in ld.duplicates(docs).collect()), key=str) == sorted(want, key=str) and len(want) == 60
