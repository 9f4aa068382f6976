"""Facts, entities, relations and timeline of chats; supplied notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions.text import has, trim
from colloquy.plans.ordered import scan, top_k

SUPPLIED, HISTORY = "supplied_context", "historical_conversation"


def parse_notes(lines: DataFrame, file: str = "file", order: str = "line_no", chunk: Column | None = None) -> DataFrame:
    """Note lines (file, order, line) -> (file, order, section, key, value)."""
    text = trim("line")
    rows = lines.withColumn("__t", text).filter(F.col("__t") != "")
    heading = F.startswith("__t", F.lit("#"))
    seen = scan(
        rows, [file], [order], chunk=chunk,
        last_seen={"section": F.when(heading, F.regexp_replace("__t", r"^#+\s*", ""))},
    )
    ascii_at, wide_at = F.instr("__t", ":"), F.instr("__t", "：")
    at = F.when(ascii_at > 0, ascii_at).otherwise(wide_at)
    t = F.col("__t")
    return seen.filter(~heading).select(
        file,
        order,
        F.coalesce("section", F.lit("General")).alias("section"),
        F.when(at > 0, trim(F.substring(t, F.lit(1), at - 1))).otherwise(F.lit("note")).alias("key"),
        F.when(at > 0, trim(F.substring(t, at + 1, F.length(t)))).otherwise(t).alias("value"),
    )


def tag_facts(
    messages: DataFrame, content: str = "content", categories: dict[str, list[str]] = lx.FACT_CATEGORIES
) -> DataFrame:
    """Messages that match a category, tagged with the first one."""
    hit = F.coalesce(*[F.when(has(content, lx.any_of(w)), F.lit(name)) for name, w in categories.items()])
    return messages.withColumn("category", hit).filter(F.col("category").isNotNull())


def _slug(c: Column) -> Column:
    return F.concat(F.lit("entity_"), F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"))


def participant_entities(messages: DataFrame, chat: str = "chat_id", sender: str = "sender", seq: str = "seq") -> DataFrame:
    speakers = messages.groupBy(chat, sender).agg(F.min(seq).alias("order"))
    return speakers.select(
        chat,
        _slug(F.col(sender)).alias("entity_id"),
        F.col(sender).alias("name"),
        F.lit("person").alias("type"),
        F.lit("Conversation participant").alias("description"),
        F.lit(HISTORY).alias("source"),
        F.struct(F.lit(0).alias("part"), F.col("order").cast("long").alias("at")).alias("order"),
    )


def classify_notes(notes: DataFrame, chat: str = "chat_id", order: str = "line_no") -> DataFrame:
    """Notes as entities: places by key or section, everything else a concept."""
    place = has("key", "|".join(lx.NOTE_LOCATION)) | has("section", "|".join(lx.NOTE_LOCATION))
    value = F.nullif(F.col("value"), F.lit(""))
    return notes.select(
        chat,
        _slug(F.col("key")).alias("entity_id"),
        F.when(place, F.coalesce(value, F.col("key"))).otherwise(F.col("key")).alias("name"),
        F.when(place, "location").otherwise("concept").alias("type"),
        F.when(place, F.concat("section", F.lit(": "), "key", F.lit(" - "), "value"))
        .otherwise(F.col("value"))
        .alias("description"),
        F.lit(SUPPLIED).alias("source"),
        F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("at")).alias("order"),
    )


def first_speakers(messages: DataFrame, chat: str = "chat_id", sender: str = "sender", seq: str = "seq") -> DataFrame:
    """(chat, first, second): the first two speakers by first appearance."""
    seen = messages.groupBy(chat, sender).agg(F.min(seq).alias("at"))
    two = top_k(seen, [chat], [F.col("at"), F.col(sender)], 2)
    return two.groupBy(chat).agg(
        F.max(F.when(F.col("rank") == 1, F.col(sender))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col(sender))).alias("second"),
    )


def participant_relations(
    messages: DataFrame, notes: DataFrame | None = None, chat: str = "chat_id", sender: str = "sender",
    seq: str = "seq", order: str = "line_no",
) -> DataFrame:
    """The first two speakers interact; relation notes add edges between them."""
    pair = first_speakers(messages, chat, sender, seq)

    def edge(rows: DataFrame, source: Column, relation: Column, target: Column, state: str, origin: str, at: Column):
        return rows.select(
            chat,
            source.alias("source_entity"),
            relation.alias("relation"),
            target.alias("target_entity"),
            F.lit(state).alias("temporal_state"),
            F.lit(origin).alias("provenance"),
            at.alias("order"),
        )

    talk = edge(
        pair.filter(F.col("second").isNotNull()), F.col("first"), F.lit("interacts_with"), F.col("second"), "ongoing",
        HISTORY, F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at")),
    )
    if notes is None:
        return talk
    about = has("key", "|".join(lx.NOTE_RELATION_KEYS)) | has("section", "|".join(lx.NOTE_RELATION_SECTIONS))
    told = edge(
        notes.filter(about).join(pair, chat, "left"),
        F.coalesce("first", F.lit("User")),
        F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("key")),
        F.coalesce("second", F.lit("Target")),
        "defined_in_context",
        SUPPLIED,
        F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("at")),
    )
    return talk.unionByName(told)


def timeline_bounds(messages: DataFrame, chat: str = "chat_id", sender: str = "sender", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """First and last message of each chat as events."""
    ends = messages.groupBy(chat).agg(
        F.min_by(F.struct(F.col(ts).cast("string").alias("ts"), F.col(sender).alias("sender")), seq).alias("a"),
        F.max_by(F.struct(F.col(ts).cast("string").alias("ts"), F.col(sender).alias("sender")), seq).alias("z"),
    )

    def event(name: str, side: str, title: str, text: Column, impact: str, at: int) -> Column:
        return F.struct(
            F.lit(name).alias("event_id"),
            F.col(f"{side}.ts").alias("date_or_period"),
            F.lit(title).alias("title"),
            text.alias("description"),
            F.lit(impact).alias("impact"),
            F.lit(HISTORY).alias("provenance"),
            F.struct(F.lit(0).alias("part"), F.lit(at).cast("long").alias("at")).alias("order"),
        )

    events = F.array(
        event("evt_first_chat", "a", "First Recorded Conversation",
              F.concat(F.lit("First message initiated by "), F.col("a.sender")),
              "Establishes initial conversational rapport", 0),
        event("evt_latest_chat", "z", "Latest Conversation Milestone", F.lit("Latest interaction recorded"),
              "Current conversation checkpoint", 1),
    )
    return ends.select(chat, F.inline(events))


def timeline_notes(notes: DataFrame, chat: str = "chat_id", order: str = "line_no", words: list[str] = lx.NOTE_TIMELINE) -> DataFrame:
    """Notes whose key names a time or an event."""
    hits = scan(notes.filter(has("key", "|".join(words))), [chat], [order], number="__no")
    return hits.select(
        chat,
        F.concat(F.lit("evt_ctx_"), (F.col("__no") + 2).cast("string")).alias("event_id"),
        F.lit("Supplied Backstory").alias("date_or_period"),
        F.col("key").alias("title"),
        F.col("value").alias("description"),
        F.lit("Defines historical background").alias("impact"),
        F.lit(SUPPLIED).alias("provenance"),
        F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("at")).alias("order"),
    )


def merge_entities(entities: DataFrame, keys: list[str], order: str = "order") -> DataFrame:
    """One row per lower-case name: the first wins, the longest description stays, a supplied source shows."""
    rest = [c for c in entities.columns if c not in (*keys, "description", "source")]
    size = F.coalesce(F.length("description"), F.lit(0))
    rows = entities.filter(F.coalesce(trim("name"), F.lit("")) != "").withColumn("__name", F.lower(trim("name")))
    longest = rows.withColumn("__size", size)
    best_size = longest.groupBy(*keys, "__name").agg(
        F.max("__size").alias("__size"),
        F.min_by(F.struct(*rest, F.col("source").alias("source")), F.col(order)).alias("first"),
        F.max((F.col("source") == SUPPLIED).cast("int")).alias("__supplied"),
    )
    # The first of the longest descriptions.
    text = (
        longest.groupBy(*keys, "__name", "__size")
        .agg(F.min_by("description", order).alias("description"))
        .join(best_size, [*keys, "__name", "__size"])
    )
    return text.select(
        *keys,
        *[F.col(f"first.{c}").alias(c) for c in rest],
        "description",
        F.when(F.col("__supplied") == 1, SUPPLIED).otherwise(F.col("first.source")).alias("source"),
    )


def _first_of(rows: DataFrame, by: list[str], key: Column, order: str) -> DataFrame:
    kept = rows.withColumn("__key", key).groupBy(*by, "__key").agg(
        F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.col(order)).alias("first")
    )
    return kept.select(*by, "first.*")


def merge_relations(relations: DataFrame, keys: list[str], order: str = "order") -> DataFrame:
    rows = relations.filter(
        (F.coalesce("source_entity", F.lit("")) != "") & (F.coalesce("target_entity", F.lit("")) != "")
    )
    parts = [F.col("source_entity"), F.coalesce(F.nullif(F.col("relation"), F.lit("")), F.lit("rel")), F.col("target_entity")]
    return _first_of(rows, keys, F.concat_ws("__", *[F.lower(trim(p)) for p in parts]), order)


def merge_timeline(events: DataFrame, keys: list[str], order: str = "order") -> DataFrame:
    rows = events.filter(F.coalesce("title", F.lit("")) != "")
    key = F.concat_ws("__", trim(F.coalesce("date_or_period", F.lit(""))), trim("title"))
    return _first_of(rows, keys, key, order)


def provenance_counts(keys: list[str], **tables: DataFrame) -> DataFrame:
    """Rows per table and source; each table has a ``source`` or ``provenance`` column."""
    parts = [
        df.groupBy(*keys, F.col("source" if "source" in df.columns else "provenance").alias("source"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def positional_sample(
    turns: DataFrame, keys: list[str], order: str = "seq", chunk_size: int = 15, max_chunks: int = 6
) -> DataFrame:
    """Turns in chunks of 15; with more than six chunks the first, middle and last two are kept."""
    numbered = scan(turns, keys, [order], number="__no")
    totals = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    rows = numbered.join(totals, keys).withColumns(
        {
            "chunk_no": F.floor((F.col("__no") - 1) / chunk_size).cast("long"),
            "__chunks": F.ceil(F.col("__all") / chunk_size),
        }
    )
    c, n = F.col("chunk_no"), F.col("__chunks")
    middle = F.floor(n / 2)
    kept = (n <= max_chunks) | (c <= 1) | (c == middle - 1) | (c == middle) | (c >= n - 2)
    return rows.filter(kept).drop("__no", "__all", "__chunks")


def memory_seed(
    timeline: DataFrame, entities: DataFrame, first_seen: DataFrame, chat: str = "chat_id"
) -> DataFrame:
    """Timeline events as episodes and entities as facts, in one memory table.

    ``first_seen``: (chat, first_ts string).  Optional columns: importance_score, significance and
    sentiment of events; confidence, evidence_count and first_mentioned of entities.
    """

    def optional(df: DataFrame, name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    ev = timeline.join(first_seen, chat, "left")
    level = optional(timeline, "significance", "string")
    importance = F.coalesce(
        optional(timeline, "importance_score", "double"),
        F.when(level == "critical", 0.95).when(level == "high", 0.85).when(level == "medium", 0.70).otherwise(0.55),
    )
    given = F.nullif(F.col("date_or_period"), F.lit(""))
    inferred = F.when(F.col("first_ts").isNotNull(), "inferred_from_session").otherwise("unknown")
    episodes = ev.select(
        chat,
        F.col("event_id").alias("id"),
        F.lit("L1").alias("layer"),
        F.lit("episode").alias("category"),
        F.col("title").alias("key"),
        F.concat("title", F.lit(": "), "description").alias("value"),
        importance.alias("importance_score"),
        F.coalesce(given, F.col("first_ts")).alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
        F.lit(None).cast("double").alias("confidence"),
        F.when(given.isNotNull(), F.lit("exact_or_period")).otherwise(inferred).alias("temporal_precision"),
        F.coalesce(F.col("provenance"), F.lit(HISTORY)).alias("source"),
    )
    told = optional(entities, "first_mentioned", "string")
    confidence = F.coalesce(
        optional(entities, "confidence", "double"),
        F.when(optional(entities, "evidence_count", "long") > 2, 0.90).otherwise(0.75),
    )
    facts = entities.join(first_seen, chat, "left").select(
        chat,
        F.col("entity_id").alias("id"),
        F.lit("L2").alias("layer"),
        F.coalesce(F.col("type"), F.lit("entity")).alias("category"),
        F.concat(F.lit("entity_"), F.col("name")).alias("key"),
        F.col("description").alias("value"),
        F.lit(None).cast("double").alias("importance_score"),
        F.coalesce(told, F.col("first_ts")).alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to"),
        confidence.alias("confidence"),
        F.when(told.isNotNull(), F.lit("timestamped")).otherwise(inferred).alias("temporal_precision"),
        F.col("source"),
    )
    return episodes.unionByName(facts)
