import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from colloquy.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def naive_best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(5)
    for window in (7, 16, 100):
        lengths = [rng.randint(1, window - 1) for _ in range(200)]
        number, offset, windows = packing.best_fit(lengths, window)
        used = {}
        for w, o, n in sorted(zip(number, offset, lengths)):
            assert o == used.get(w, 0)
            used[w] = o + n
        assert len(used) == windows
        assert sorted(window - n for n in used.values()) == naive_best_fit(lengths, window)


def test_both_encoders_give_the_same_ids():
    rng = random.Random(3)
    plain, general = packing.encoder(PATH)
    letters = "ab Éßñ \t\n\r.,'s0123456789<|endoftext|>¡¬®ÿ ɏ"
    for n in [0, 1, 5, 50, 500] * 20:
        text = "".join(rng.choice(letters) for _ in range(n))
        if packing.PLAIN.match(text):
            assert plain.encode_ordinary(text) == general.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "中文 and 😀", "x " * 5000, "y" * 9000, "same", "same", "<|endoftext|>"]
    texts += [" ".join(rng.choice(["alpha", "beta", "g"]) for _ in range(rng.randint(1, 90))) for _ in range(200)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id", "clash", 0), (3, "again", "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, offset int")
    packed = packing.pack(docs, PATH, window=64, block_docs=50, with_ids=True).collect()
    general = packing.encoder(PATH)[1]
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(general.encode(t or "", add_special_tokens=False).ids + [0])
    got, place = {}, {}
    for p in packed:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
        place.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, all_ids in want.items():
        for ids in all_ids:
            pieces = sorted(got[(i, len(ids))])
            assert sum((x for _, x in pieces), []) == ids
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_sequences_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, PATH, window=16, with_ids=True)).collect()
    assert sum(len(r.ids) for r in rows) == 6 and sorted(d for r in rows for d in r.doc_ids) == [1, 2]
    assert packing.pack(docs.filter(F.lit(False)), PATH).count() == 0


def test_stage_returns_the_ids_and_the_query_their_digest(spark, tmp_path):
    import corpus_pipeline
    from colloquy.llm.queries import QUERIES

    texts = {1: "one two three " * 900, 2: None, None: "no id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    query = QUERIES["op5_best_fit_packing"](spark, str(tmp_path))
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in query.collect()}
    for i, t in texts.items():
        ids = packing.token_ids(t or "", PATH)
        pieces = sorted((r.start, r.ids) for r in rows if r.doc_id == i)
        assert sum((x for _, x in pieces), []) == ids.tolist()
        assert all(crcs[i, a] == zlib.crc32(np.array(x, "<u4").tobytes()) for a, x in pieces)
    assert len(crcs) == len(rows) > 3
