import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import memory


def test_retrieval_equals_all_pairs_with_a_word_everybody_holds(spark):
    rnd = random.Random(3)
    vocabulary = ["tea", "rice", "walk", "cinema", "rain", "x", "ab", "喜欢", "teahouse"]
    rows = []
    for i in range(900):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(4))]
        rows.append((i, f"p{i % 2 if i < 880 else 9}", rnd.choice(["L1", "L2", "L0"]), " ".join(["common", *words]), rnd.choice([rnd.random(), 0.5]), rnd.random(), 1_700_000_000 + rnd.randrange(10**7), rnd.random() < 0.1))
    memories = spark.createDataFrame(rows, "id long, persona_id string, layer string, value string, importance_score double, confidence double, t long, closed boolean").select(
        "id", "persona_id", "layer", "value", "importance_score", "confidence", F.timestamp_seconds("t").alias("valid_from"), F.when(F.col("closed"), F.timestamp_seconds("t")).alias("valid_to")
    )
    texts = ["common", "common tea", "COMMON common rain tea", "teahouse x", "none here", "", "walk 喜欢 common cinema", "ab"]
    queries = spark.createDataFrame([(k, p, q) for k, (p, q) in enumerate((p, q) for p in ("p0", "p1", "p9", "p7") for q in texts)], "query_id long, persona_id string, query string")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    usable = memories.filter("layer = 'L1' or (layer = 'L2' and valid_to is null)")
    every = queries.join(usable, "persona_id").withColumn("score", memory.memory_score("query", now))
    rank = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy(F.desc("score"), "id"))
    want = every.withColumn("rank", rank).filter("rank <= case when layer = 'L1' then 5 else 10 end")
    key = lambda df: sorted((r.query_id, r.layer, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert key(memory.retrieve_topk(queries, memories, now)) == key(want)
    pairs, all_pairs = memory.candidate_pairs(queries, usable, now).count(), every.count()
    assert pairs < all_pairs / 4
    common = memory.candidate_pairs(queries.filter("query = 'common'"), usable, now).count()
    assert common <= 70  # three personas, no more than the best of each list and its ties in a bucket


def test_memories_of_a_persona_in_order(spark):
    rows = [(1, "p0", "L1", 3), (2, "p1", "L1", 4), (3, "p0", "L2", 2), (4, None, "L1", 0), (5, "p0", "L1", 1), (6, "p0", None, None)]
    memories = spark.createDataFrame(rows, "id long, persona_id string, layer string, created_at long").repartition(3)
    ids = lambda **by: [r.id for r in memory.query_memories(memories, **by).collect()]
    assert ids(persona="p0") == [6, 5, 3, 1] and ids(persona="p0", layer="L1") == [5, 1]
    assert ids(layer="L1") == [4, 5, 1, 2]
    assert ids(persona="nobody") == [] and len(ids()) == 6
