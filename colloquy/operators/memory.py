"""Versioned memory tables: keys, candidates, supersession, ranked retrieval, compaction.

Layers: L0 working, L1 episodes, L2 facts, L3 world.  A row is active while ``valid_to`` is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.text import char_ngrams, col, has, trim
from colloquy.plans.ordered import CUT, cut_chunks, scan, top_k

TOP = {"L1": 5, "L2": 10}
HALF_LIFE_DAYS = 30.0
#: Buckets of standing a posting list is read in.
BUCKETS = 64
MEMORY_JSON = "struct<memories:array<struct<category:string,key:string,value:string,importance_score:double,confidence:double>>>"


def memory_key(category, key) -> Column:
    k = F.replace(trim(F.lower(col(key))), F.lit(" "), F.lit("_"))
    c = trim(F.lower(F.coalesce(col(category), F.lit(""))))
    return F.when((c != "") & ~F.startswith(k, c), F.concat(c, F.lit(":"), k)).otherwise(k)


def fact_candidates(
    messages: DataFrame, text: str = "text", prefixes: list[tuple[str, str, str]] = lx.FACT_PREFIXES,
    separators: str = lx.FACT_SEPARATORS,
) -> DataFrame:
    """Messages that state a fact: the first prefix rule that yields a value of 2 to 50 bytes."""
    cut = "[" + separators.replace("\\", "\\\\") + "]"
    clean = trim(text)

    def rule(prefix: str, category: str, key: str) -> Column:
        at = F.instr(clean, prefix)
        rest = trim(F.substring(clean, at + len(prefix), F.length(clean)))
        value = trim(F.get(F.split(rest, cut, 2), F.lit(0)))
        ok = (at > 0) & F.octet_length(value).between(2, 50)
        return F.when(
            ok,
            F.struct(
                F.lit(category).alias("category"),
                F.lit(key).alias("key"),
                F.concat(F.lit(prefix + " "), value).alias("value"),
            ),
        )

    hit = F.coalesce(*[rule(*p) for p in prefixes])
    return (
        messages.withColumn("__hit", hit)
        .filter(F.col("__hit").isNotNull())
        .select(
            "*",
            F.col("__hit.category").alias("category"),
            memory_key("__hit.category", "__hit.key").alias("key"),
            F.col("__hit.value").alias("value"),
            F.lit(0.65).alias("importance_score"),
            F.lit(0.80).alias("confidence"),
        )
        .drop("__hit")
    )


def parse_memory_json(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Extraction replies to memory rows; rows about recalled messages are dropped."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    kept = [c for c in rows.columns if c != raw]
    flat = rows.select(*kept, F.explode(F.from_json(body, MEMORY_JSON)["memories"]).alias("m")).select(*kept, "m.*")
    recall = has(F.lower("value"), "|".join(lx.RECALL_WORDS["value"])) | has(
        F.lower("key"), "|".join(lx.RECALL_WORDS["key"])
    )
    filled = (F.coalesce("key", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "")
    return flat.filter(filled & ~recall).withColumns(
        {
            "key": memory_key("category", "key"),
            "importance_score": F.when(F.col("importance_score") > 0, F.col("importance_score")).otherwise(0.70),
            "confidence": F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.85),
        }
    )


def supersede(
    versions: DataFrame, keys: list[str], valid_from: str = "valid_from", id: str = "id", width: int | None = None
) -> DataFrame:
    """Set ``valid_to`` of every version to the start of the next one with the same keys."""
    cut = cut_chunks(versions.drop("valid_to"), keys, [valid_from, id], width)
    return scan(cut, keys, [valid_from, id], chunk=F.col(CUT), lead={"valid_to": F.col(valid_from)}).drop(CUT)


def supersede_active(active: DataFrame, arrivals: DataFrame, keys: list[str], valid_from: str = "valid_from", id: str = "id") -> DataFrame:
    """Apply new versions to the active rows: an equi-join on the keys closes what they replace."""
    first = arrivals.groupBy(*keys).agg(F.min(valid_from).alias("__next"))
    closed = active.join(first, keys, "left").withColumn("valid_to", F.col("__next")).drop("__next")
    return closed.unionByName(supersede(arrivals, keys, valid_from, id).select(*closed.columns))


def upsert_memories(stored: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """Insert by id; on a known id value, importance, confidence and valid_to are replaced.

    ``changes`` carries ``version``, the larger one wins.
    """
    replaced = ["value", "importance_score", "confidence", "valid_to"]
    fixed = [c for c in stored.columns if c not in (*replaced, id)]
    both = stored.withColumn("version", F.lit(-1).cast("long")).unionByName(
        changes.withColumn("version", F.col("version").cast("long"))
    )
    merged = both.groupBy(id).agg(
        F.min_by(F.struct(*fixed), "version").alias("first"), F.max_by(F.struct(*replaced), "version").alias("last")
    )
    return merged.select(id, "first.*", "last.*").select(*stored.columns)


def query_memories(memories: DataFrame, persona: str | None = None, layer: str | None = None) -> DataFrame:
    rows = memories
    if persona is not None:
        rows = rows.filter(F.col("persona_id") == persona)
    if layer is not None:
        rows = rows.filter(F.col("layer") == layer)
    return rows.orderBy("created_at")


def active_facts(memories: DataFrame) -> DataFrame:
    return memories.filter(F.col("valid_to").isNull())


def lexical_relevance(query, value) -> Column:
    """Share of the query's words of more than one byte that occur in the value."""
    words = F.filter(F.split(F.lower(col(query)), r"\s+"), lambda w: w != "")
    hits = F.filter(words, lambda w: (F.octet_length(w) > 1) & F.contains(F.lower(col(value)), w))
    share = F.least(F.lit(1.0), F.size(hits) / F.size(words))
    return F.when((F.size(words) > 0) & (F.coalesce(col(value), F.lit("")) != ""), share).otherwise(F.lit(0.0))


def recency(valid_from, now) -> Column:
    """Halves every 30 days, at least .05; .1 for an unreadable time."""
    stamp, at = [F.unix_micros(col(c).cast("timestamp")) for c in (valid_from, now)]
    days = (at - stamp) / 86_400_000_000.0
    return F.coalesce(F.greatest(F.lit(0.05), F.exp(days * (-0.6931471805599453 / HALF_LIFE_DAYS))), F.lit(0.1))


def _standing(now: Column) -> Column:
    """The part of the score that does not depend on the query."""
    return F.col("importance_score") * 0.25 + recency("valid_from", now) * 0.15 + F.col("confidence") * 0.20


def memory_score(query, now: Column) -> Column:
    return lexical_relevance(query, "value") * 0.40 + _standing(now)


def _bucket(standing: Column) -> Column:
    """Coarse standing; all below 0 and all above the highest share the end buckets."""
    return F.least(F.greatest(F.floor(standing * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def candidate_pairs(queries: DataFrame, usable: DataFrame, now: Column) -> DataFrame:
    """(query_id, persona_id, layer, id): pairs among which the best of every list are.

    The score is the share of a query's words that a memory holds, plus its standing.  The memories of best standing are
    scored first; the last place they give is the score to beat.  A query's words are put in order, common ones first.
    A memory whose last word in that order is the j-th holds at most j of them; so the j-th word's postings are needed
    only down to the standing at which j words still reach the score to beat.  Postings lie in buckets of standing, so
    those below are not read, however long the list of a common word is.
    """
    usable = usable.withColumn("standing", _standing(now))
    asked = queries.select("query_id", "persona_id", "query")
    best = top_k(usable, ["persona_id", "layer"], [F.col("standing").desc(), F.col("id")], max(TOP.values())).drop("rank")
    seen = asked.join(best, "persona_id").withColumn("score", lexical_relevance("query", "value") * 0.40 + F.col("standing"))
    limit = F.when(F.col("layer") == "L1", TOP["L1"]).otherwise(TOP["L2"])
    last = top_k(seen, ["query_id", "layer"], [F.col("score").desc(), F.col("id")], max(TOP.values())).filter(F.col("rank") == limit)
    # A persona with fewer memories has all of them among the best.
    beat = last.select("query_id", "layer", F.col("score").alias("beat"))

    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    probes = asked.select("query_id", "persona_id", F.size(words).alias("n"), F.explode(F.filter(words, lambda w: F.octet_length(w) > 1)).alias("word"))
    probes = probes.groupBy("query_id", "persona_id", "n", "word").agg(F.count(F.lit(1)).alias("times")).withColumn("head", F.substring("word", 1, 3))
    text = F.lower("value")
    heads = F.array_distinct(F.concat(*[char_ngrams(text, k) for k in (1, 2, 3)]))
    index = usable.select("persona_id", "layer", "id", "standing", _bucket(F.col("standing")).alias("bucket"), text.alias("text"), F.explode(heads).alias("head"))
    wanted = probes.select("persona_id", "head").distinct()
    index = index.join(wanted, ["persona_id", "head"], "left_semi")
    held = index.groupBy("persona_id", "head").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("query_id").orderBy(F.desc("held"), "word")
    most = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = probes.join(held, ["persona_id", "head"]).withColumn("most", most).join(beat, "query_id")
    least = F.col("beat") - F.col("most") / F.col("n") * 0.40 - 1e-9
    reach = placed.withColumn("least", least).select(
        "query_id", "persona_id", "layer", "head", "word", "least", F.explode(F.sequence(_bucket(F.col("least")), F.lit(BUCKETS - 1))).alias("bucket")
    )
    named = index.join(reach, ["persona_id", "layer", "head", "bucket"]).filter((F.col("standing") >= F.col("least")) & F.contains("text", F.col("word")))
    keys = ["query_id", "persona_id", "layer", "id"]
    return named.select(*keys).union(seen.select(*keys)).distinct()


def retrieve_topk(queries: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Best episodes and active facts for each query (query_id, persona_id, query) at one time."""
    usable = memories.filter((F.col("layer") == "L1") | ((F.col("layer") == "L2") & F.col("valid_to").isNull()))
    scored = (
        candidate_pairs(queries, usable, now).drop("layer")
        .join(queries.select("query_id", "query"), "query_id")
        .join(usable, ["persona_id", "id"])
        .withColumn("score", memory_score("query", now))
    )
    limit = F.when(F.col("layer") == "L1", TOP["L1"]).otherwise(TOP["L2"])
    ranked = top_k(scored, ["query_id", "layer"], [F.col("score").desc(), F.col("id")], max(TOP.values()))
    return ranked.filter(F.col("rank") <= limit)


def importance6(factors: list[Column]) -> Column:
    """Weighted importance of six factors in [0, 1]."""
    weights = [0.30, 0.15, 0.15, 0.15, 0.15, 0.10]
    return reduce(Column.__add__, [f * w for f, w in zip(factors, weights, strict=True)])


def compact_memories(memories: DataFrame, now: Column) -> DataFrame:
    """Without working rows older than seven days and weak rows outside the world layer."""
    old = (F.col("layer") == "L0") & (F.col("created_at") < now - F.expr("interval 7 days"))
    weak = (F.col("importance_score") < 0.35) & (F.col("layer") != "L3")
    return memories.filter(~F.coalesce(old, F.lit(False)) & ~F.coalesce(weak, F.lit(False)))


def layer_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("layer").agg(F.count(F.lit(1)).alias("entries"))


def store_stats(memories: DataFrame, messages: DataFrame, session: list[str]) -> DataFrame:
    """One row: totals of memories, sessions and messages."""
    parts = [
        memories.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("memories")),
        messages.select(*session).distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("sessions")),
        messages.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("messages")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy().agg(
        *[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("memories", "sessions", "messages")]
    )


def recent_messages(messages: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per group, numbered oldest first in ``position``."""
    newest = top_k(messages, keys, [F.col(order).desc()], n, rank="__back")
    kept = newest.groupBy(*keys).agg(F.max("__back").alias("__size"))
    return newest.join(kept, keys).withColumn("position", F.col("__size") - F.col("__back") + 1).drop("__back", "__size")


def recent_logs(logs: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` log rows, oldest first."""
    return logs.orderBy(F.col(order).desc()).limit(n).orderBy(order)
