import random
import zlib

import corpus_pipeline
import public_tokenizers
from colloquy.llm import packing


def test_stages(spark, tmp_path):
    rng = random.Random(14)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    sentence = lambda parts, n: " ".join(word(parts) for _ in range(n))
    xx, yy = ["ka", "lo", "mi", "tu", "re"], ["str", "ung", "öch", "pfa", "gel"]
    prose = lambda parts: "\n".join(sentence(parts, 14) for _ in range(6))
    item = sentence(xx, 12)
    rows = [(i, prose(xx if i % 2 else yy), "xx" if i % 2 else "yy") for i in range(60)]
    # 100: no language; 101: copy of 1; 102: a near copy of 3, all lines with two words changed; 103: benchmark; 104: a shared line
    words = [l.split(" ") for l in rows[3][1].split("\n")]
    for l in words[::3]:
        l[4], l[9] = "zu", "zo"
    rows += [
        (100, "123 ... 456", "xx"), (101, rows[1][1], "xx"), (102, "\n".join(map(" ".join, words)), None), (103, "start " + item + " end " + sentence(xx, 40), "xx"),
        (104, rows[5][1].split("\n")[2].upper() + "\n" + prose(yy), "yy"), (105, None, "xx"),
    ]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    at, ids = docs, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        ids.append({r.doc_id for r in at.collect()})
    everyone = {i for i, *_ in rows}
    assert everyone - ids[0] == {100, 105}
    assert ids[0] - ids[1] == {101}
    assert ids[2] <= ids[1] and ids[2] - ids[3] == {103}
    texts = {r.doc_id: r for r in at.collect()}
    assert texts[104].text == rows[64][1].split("\n", 1)[1] and texts[104].n_chars == len(texts[104].text)
    assert all(texts[i].text == t for i, t, _ in rows[:60])

    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == ids[3]
    for i, pieces in got.items():
        tokens = packing.token_ids(texts[i].text, public_tokenizers.path("byte_bpe_50k.json"))
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(tokens[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces) == len(tokens) == pieces[0].doc_tokens


def test_files_of_a_finished_stage_are_deleted(spark, tmp_path):
    from colloquy.llm.common import staged_paths

    rows = [(i, f"some words of document {i} that nobody else has at all", "en", "s", 10) for i in range(20)] + [(20, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before, at, left = staged_paths(), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, step in corpus_pipeline.STAGES:
        step(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        left.append(staged_paths() - before)
        at = spark.read.parquet(str(tmp_path / name))
    assert left[1] and not left[1] & left[2] and not left[2] & left[3] and at.count() > 0
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
