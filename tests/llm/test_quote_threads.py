import random
import re

from pyspark.sql import functions as F

from colloquy.llm import quote_threads as qt


def norm(t):
    return re.sub(r"[ \t\r\n>]+", " ", t.lower()).strip(" ")


def parse(t):
    if t is None or not re.search(r"(?m)^(?:[ \t]*>)+", t):
        return t, []
    lines, own, quoted = t.split("\n"), [], []
    for i, l in enumerate(lines):
        m = re.match(r"(?:[ \t]*>)+", l)
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if re.search(r"wrote:[ \t]*$", l) and re.match(r"[ \t]*>", nxt):
            continue
        if m:
            quoted.append((i, m[0].count(">"), norm(re.sub(r"^(?:[ \t]*>)+[ \t]?", "", l))))
        else:
            own.append(l)
    return "\n".join(own).strip(), quoted


def brute(rows):
    own, quoted, first = {}, {}, {}
    for c, t, _, x in rows:
        own[(c, t)], quoted[(c, t)] = parse(x)
        if c is not None and t is not None and own[(c, t)] is not None:
            for u in [*own[(c, t)].split("\n"), own[(c, t)]]:
                if norm(u):
                    first[(c, norm(u))] = min(t, first.get((c, norm(u)), t))
    parent, source = {}, {}
    for (c, t), q in quoted.items():
        units = set()
        for level in {l for _, l, _ in q}:
            run = []
            for i, l, u in [x for x in q if x[1] == level] + [(10**9, level, "")]:
                if run and i != run[-1][0] + 1:
                    units.add((level, norm(" ".join(x[2] for x in run))))
                    run = []
                run.append((i, l, u))
            units |= {(l, u) for _, l, u in q}
        units = {u for u in units if u[1]}
        score = {}
        for l, u in units:
            f = first.get((c, u))
            if c is not None and f is not None and t is not None and f < t:
                score[(l, f)] = score.get((l, f), 0) + len(u)
        if score:
            parent[(c, t)] = -max((-l, n, -f) for (l, f), n in score.items())[2]
            source[(c, t)] = (c, parent[(c, t)])
        elif t is not None and c is not None:
            away = [(l, -len(u), min(k for k in ((cc, f) for (cc, uu), f in first.items() if uu == u))) for l, u in units if any(uu == u for _, uu in first)]
            away = [x for x in away if x[2][0] != c]
            if away:
                source[(c, t)] = min(away)[2]
    out = []
    for c, t, r, x in rows:
        o, q = parse(x)
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[(c, root)], depth + 1
        s = source.get((c, t), (None, None))
        out.append((c, t, r, o, len(q), max((l for _, l, _ in q), default=0), parent.get((c, t)), *s, root, depth))
    return sorted(out, key=str)


def test_format_chat(spark):
    rng = random.Random(13)
    rows, say = [], lambda: "\n".join(" ".join(rng.choice(["so", "Ça", "no", "go", "up"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
    for c in range(12):
        past = []
        for t in range(rng.randint(1, 12)):
            text = say()
            if past and rng.random() < 0.6:
                old = rng.choice(past)
                part = old if rng.random() < 0.6 else rng.choice(old.split("\n"))
                text = rng.choice(["", "On Monday Ann wrote:\n"]) + "\n".join(rng.choice(["> ", ">", " >"]) + l for l in part.split("\n")) + rng.choice(["\n", "\n\n"]) + text
            rows.append((c, t, "user", text))
            past.append(text)
    rows += [(50, 0, "user", None), (50, 1, None, ""), (50, 2, "user", "> nowhere said"), (51, 0, "user", "A far message"), (52, 0, "user", "> a  FAR message\nyes"), (None, 1, "user", "> so"), (53, None, "user", "> so"), (54, 0, "user", "x\n" * 4000), (54, 1, "user", "> x\n" * 4000 + "end")]
    messages = spark.createDataFrame([(*r, 1, "o") for r in rows], "conv_id long, turn long, role string, text string, level int, own string")
    got = sorted((tuple(r) for r in qt.format_chat(messages).collect()), key=str)
    assert got == brute(rows) and max(r[-1] for r in got) > 2 and any(r[7] not in (None, r[0]) for r in got)
    assert qt.format_chat(messages.filter(F.lit(False))).count() == 0
    twice = qt.format_chat(messages.filter("conv_id = 3").union(messages.filter("conv_id = 3")))
    assert twice.count() == 2 * messages.filter("conv_id = 3").count()
