"""Live messages: commands, bursts, questions, quotes, pseudonyms.

A message has chat_id, message_id, user_id, ts, text, reply_to_id.  Every operator runs on a
finite table and on a stream; ``bursts`` picks the plan by ``isStreaming``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy import lexicons as lx
from colloquy.functions.text import char_ngrams, col, has, trim
from colloquy.plans import lineage
from colloquy.plans.ordered import CUT, cut_chunks, scan

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_SECONDS, CAP_SECONDS = 3.5, 10.0
WATERMARK = "10 minutes"
BURST = "chat_id long, burst_start timestamp, burst_end timestamp, text string, message_count long, first_id long, last_id long"


def is_command(text) -> Column:
    return has(trim(F.lower(F.coalesce(col(text), F.lit("")))), lx.COMMANDS)


def split_commands(messages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(commands, other messages)."""
    return messages.filter(is_command(text)), messages.filter(~is_command(text))


def cut_bursts(micros: np.ndarray, fresh: np.ndarray, window: float, cap: float) -> np.ndarray:
    """Index of the first message of each message's burst, for one chat in time order.

    A pause of ``window`` starts a burst; a message ``cap`` or more after the first one joins and closes.
    """
    starts = np.empty(len(micros), dtype=np.int64)
    gap, limit = int(window * 1e6), int(cap * 1e6)
    first, closed = 0, True
    for i in range(len(micros)):
        if closed or fresh[i] or micros[i] - micros[i - 1] >= gap:
            first, closed = i, False
        starts[i] = first
        if i > first and micros[i] - micros[first] >= limit:
            closed = True
    return starts


def burst_starts(
    messages: DataFrame, chat: str = "chat_id", ts: str = "ts", id: str = "message_id", command: Column | None = None,
    window: float = WINDOW_SECONDS, cap: float = CAP_SECONDS, width: int | None = None, part: float | None = None,
) -> DataFrame:
    """Add ``burst_id``: id of the first message of the burst.  Commands close a burst and are dropped.

    Pauses split a chat into runs by a chunked scan; runs that the cap cuts are folded in parts of ``part`` seconds,
    so neither a busy chat nor a run without a pause is held by one task.
    """
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = messages.withColumns({"__micros": stamp, "__cmd": F.lit(False) if command is None else command})
    marked = cut_chunks(marked, [chat], [ts, id], width)
    seen = scan(
        marked, [chat], [ts, id], chunk=F.col(CUT),
        lag={"__prev": F.col("__micros"), "__prev_cmd": F.col("__cmd")},
    )
    pause = F.col("__micros") - F.col("__prev") >= F.lit(int(window * 1_000_000))
    opens = F.col("__prev").isNull() | pause | F.col("__prev_cmd") | F.col("__cmd")
    runs = scan(
        seen.withColumn("__open", opens.cast("int")), [chat], [ts, id], chunk=F.col(CUT), running={"__run": F.col("__open")}
    ).filter(~F.col("__cmd"))
    # Runs shorter than the cap are bursts as they are; only the others are folded.
    ends = runs.groupBy(chat, "__run").agg(
        F.min_by(id, F.struct(ts, id)).alias("__first"),
        F.min("__micros").alias("__from"),
        (F.max("__micros") - F.min("__micros")).alias("__span"),
    )
    placed = runs.join(ends, [chat, "__run"])
    limit = F.lit(int(cap * 1_000_000))
    out = [*messages.columns]
    whole = placed.filter(F.col("__span") < limit).select(*out, F.col("__first").alias("burst_id"))
    long = lineage.cut(placed.filter(F.col("__span") >= limit).select(*out, "__run", "__micros", "__from"))
    return whole.unionByName(_long_runs(long, chat, ts, id, window, cap, part).select(*out, "burst_id"))


def successors(micros: np.ndarray, cap: int) -> np.ndarray:
    """For each message of a run in time order, the one that opens the next burst if this one opens a burst; else the length."""
    closing = np.searchsorted(micros, micros + cap, side="left")
    return np.minimum(closing + 1, len(micros))


def _long_runs(long: DataFrame, chat: str, ts: str, id: str, window: float, cap: float, part: float | None) -> DataFrame:
    """Add ``burst_id`` to the messages of runs that the cap cuts, however long the runs are.

    A burst and the message after it end within ``reach`` of its start.  So a run is cut into parts of many times that,
    and a part sees the head of the next one: there it finds, for every message at which the chain of bursts may enter
    it, the message at which the chain leaves.  The entries that are met from the run's first message are found by
    pointer doubling over these few; then each part is folded from its own entry.
    """
    gap, limit = int(window * 1e6), int(cap * 1e6)
    reach = limit + 2 * gap
    size = max(int((part or 0) * 1e6), reach + 1) if part else 16 * reach
    since = F.col("__micros") - F.col("__from")
    rows = long.withColumn("__part", F.floor(since / F.lit(size)).cast("long")).withColumn("__head", since - F.col("__part") * size <= reach)
    last = rows.agg(F.max("__part")).first()[0]  # one number
    kind = dict(long.dtypes)
    key = [chat, "__run"]
    seen = rows.select(*key, "__micros", id, "__head", F.explode(
        F.when(F.col("__head") & (F.col("__part") > 0), F.array(F.struct(F.col("__part").alias("p"), F.lit(True).alias("own")), F.struct((F.col("__part") - 1).alias("p"), F.lit(False).alias("own"))))
        .otherwise(F.array(F.struct(F.col("__part").alias("p"), F.lit(True).alias("own"))))
    ).alias("__at")).select(*key, F.col("__at.p").alias("__part"), F.col("__at.own").alias("__own"), "__micros", id, "__head")

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__micros", "ascending"), (id, "ascending")])
        own, head = table["__own"].to_numpy(), table["__head"].to_numpy()
        to = np.append(successors(table["__micros"].to_numpy(), limit), len(own))
        inside = np.append(own, False)
        # Own messages come first in time; the chain is followed until it leaves them, in doubling steps.
        while (step := inside[to] & (to != to[to])).any():
            to = np.where(step, to[to], to)
        first = table["__part"][0].as_py() == 0 if len(own) else False
        entry = np.flatnonzero(own & head) if not first else np.arange(min(1, len(own)))
        ids, target = table[id].combine_chunks(), to[entry]
        exits = pa.array(np.where(target < len(own), target, -1)).to_pylist()
        part_of = table.take(pa.array(entry)).select([chat, "__run", "__part", id])
        return part_of.append_column("__next", pa.array([None if e < 0 else ids[e].as_py() for e in exits], ids.type))

    edge = f"`{chat}` {kind[chat]}, __run {kind['__run']}, __part long, `{id}` {kind[id]}, __next {kind[id]}"
    jump = lineage.cut(seen.groupBy(*key, "__part").applyInArrow(edges, edge))
    met = jump.filter("__part = 0").select(*key, id)
    jump = jump.select(*key, id, "__next")
    for done in range(int(last or 0).bit_length()):
        onward = met.join(jump, [*key, id]).filter("__next is not null").select(*key, F.col("__next").alias(id))
        met = met.unionByName(onward)
        further = jump.select(*key, F.col(id).alias("__next"), F.col("__next").alias("__after"))
        jump = jump.join(further, [*key, "__next"]).select(*key, id, F.col("__after").alias("__next"))
        if done % 4 == 3:
            met, jump = lineage.cut(met), lineage.cut(jump)
    entries = rows.join(met, [*key, id], "left_semi").select(
        *[F.col(c).alias(c) for c in (*key, "__part")], F.col("__micros").alias("__at"), F.col(id).alias("__entry")
    )

    columns = [*long.columns, "__part"]
    schema = ", ".join(f"`{c}` {kind.get(c, 'long')}" for c in columns) + f", burst_id {kind[id]}"

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(columns).sort_by([("__micros", "ascending"), (id, "ascending")])
        starts = np.full(left.num_rows, -1)
        ids = left[id].combine_chunks()
        for at, entry in zip(right["__at"].to_pylist(), right["__entry"].to_pylist()):
            micros = left["__micros"].to_numpy()
            i = int(np.searchsorted(micros, at))
            while ids[i].as_py() != entry:
                i += 1
            to = successors(micros, limit)
            while i < len(micros):
                starts[i], i = i, int(to[i])
        owner = np.maximum.accumulate(starts) if len(starts) else starts
        # Before the entry a message belongs to a burst of the part before.
        known = pa.array(np.where(owner < 0, 0, owner), mask=owner < 0)
        return left.append_column("burst_id", ids.take(known))

    folded = rows.select(*columns).groupBy(*key, "__part").cogroup(entries.groupBy(*key, "__part")).applyInArrow(fold, schema)
    return scan(
        folded.withColumnRenamed("burst_id", "__burst"), key, [ts, id], chunk=F.col("__part"), last_seen={"burst_id": F.col("__burst")}
    )


def coalesce_bursts(placed: DataFrame, chat: str = "chat_id", ts: str = "ts", id: str = "message_id", text: str = "text") -> DataFrame:
    """One row per burst: trimmed texts joined by a line break, count, first and last id.

    A burst spans little more than the cap, so its texts are few.
    """
    body = trim(F.coalesce(F.col(text), F.lit("")))
    filled = body != ""
    item = F.when(filled, F.struct(F.col(ts).alias("t"), F.col(id).alias("i"), body.alias("b")))
    rows = placed.groupBy(chat, "burst_id").agg(
        F.min(ts).alias("burst_start"),
        F.max(ts).alias("burst_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"]), "\n").alias("text"),
        F.count_if(filled).alias("message_count"),
        F.min_by(id, F.struct(ts, id)).alias("first_id"),
        F.max_by(id, F.struct(ts, id)).alias("last_id"),
    )
    return rows.filter(F.col("text") != "").drop("burst_id")


def bursts(
    messages: DataFrame, window: float = WINDOW_SECONDS, cap: float = CAP_SECONDS, watermark: str = WATERMARK,
    width: int | None = None, part: float | None = None,
) -> DataFrame:
    """Bursts of a table or a stream of messages; commands close a burst and are left out."""
    if not messages.isStreaming:
        placed = burst_starts(messages, command=is_command("text"), window=window, cap=cap, width=width, part=part)
        return coalesce_bursts(placed)
    rows = messages.withWatermark("ts", watermark).select(
        "chat_id", "message_id", "ts", F.coalesce("text", F.lit("")).alias("text"), is_command("text").alias("cmd")
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Hold messages until the watermark has passed their burst, then emit it."""
        held = pd.DataFrame(
            dict(zip(("message_id", "micros", "text", "cmd"), state.get if state.exists else ([], [], [], []), strict=True))
        )
        new = [
            pd.DataFrame(
                {"message_id": f["message_id"], "micros": f["ts"].astype("datetime64[us]").astype("int64"), "text": f["text"], "cmd": f["cmd"]}
            )
            for f in ([] if state.hasTimedOut else frames)
        ]
        rows = pd.concat([held, *new], ignore_index=True)
        rows = rows.astype({"message_id": "int64", "micros": "int64", "cmd": "int64"}).sort_values(["micros", "message_id"], ignore_index=True)
        micros, cmd = rows["micros"].to_numpy("int64"), rows["cmd"].to_numpy(bool)
        fresh = cmd | np.concatenate([[True], cmd[:-1]]) if len(cmd) else cmd
        starts = cut_bursts(micros, fresh, window, cap)
        now = state.getCurrentWatermarkMs() * 1000
        done, waiting, out = [], [], []
        for start, part in rows.groupby(starts, sort=True):
            last = int(part["micros"].iloc[-1])
            full = last - int(part["micros"].iloc[0]) >= cap * 1e6
            closes = last if full or bool(part["cmd"].iloc[0]) else last + int(window * 1e6)
            if waiting or closes >= now:
                waiting.append((closes, part))
                continue
            done.append(start)
            texts = [t.strip() for t in part["text"] if t.strip()]
            if texts and not part["cmd"].iloc[0]:
                ids = part["message_id"]
                out.append((key[0], part["micros"].iloc[0], last, "\n".join(texts), len(texts), ids.iloc[0], ids.iloc[-1]))
        if waiting:
            keep = pd.concat([part for _, part in waiting])
            state.update(tuple(keep[c].tolist() for c in ("message_id", "micros", "text", "cmd")))
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        names = [f.strip().split(" ")[0] for f in BURST.split(",")]
        frame = pd.DataFrame(out, columns=names)
        for c in ("burst_start", "burst_end"):
            frame[c] = pd.to_datetime(frame[c], unit="us")
        yield frame

    return rows.groupBy("chat_id").applyInPandasWithState(
        step, BURST, "ids array<long>, micros array<long>, texts array<string>, cmds array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def is_question(text) -> Column:
    """A question mark, an interrogative, or an English question word first."""
    t = trim(F.coalesce(col(text), F.lit("")))
    first = F.btrim(F.get(F.split(F.lower(t), r"\s+"), F.lit(0)), F.lit("!.,;:"))
    return (t != "") & (has(t, "[?？]|" + "|".join(lx.INTERROGATIVES)) | first.isin(lx.QUESTION_STARTS))


def answer_score(question, reply, stopwords: list[str] = lx.ANSWER_STOPWORDS) -> Column:
    """How much of a question shows up in a reply: words and bigrams count 3, characters 1."""
    blanks = " " * len(lx.ANSWER_PUNCTUATION)
    plain = [F.lower(F.translate(col(c), lx.ANSWER_PUNCTUATION, blanks)) for c in (question, reply)]

    def score(q: Column, r: Column) -> Column:
        tight = F.replace(q, F.lit(" "), F.lit(""))

        def hits(items: Column, extra=None) -> Column:
            def ok(w: Column) -> Column:
                base = (w != "") & ~w.isin(stopwords) & F.contains(r, w)
                return base if extra is None else base & extra(w)

            return F.size(F.filter(items, ok))

        return (
            hits(F.split(q, r"\s+"), lambda w: F.octet_length(w) >= 3) * 3
            + hits(char_ngrams(tight, 2)) * 3
            + hits(char_ngrams(tight, 1))
        ).cast("long")

    # Both texts are elements of an array, so they are made once a row and not for every word looked up.
    both = F.array(F.struct(plain[0].alias("q"), plain[1].alias("r")))
    return F.get(F.transform(both, lambda t: score(t["q"], t["r"])), F.lit(0))


def link_answer(questions: DataFrame, replies: DataFrame, keys: list[str], id: str = "message_id", text: str = "text") -> DataFrame:
    """(keys, answered_id) for bursts with two or more questions: the clear best match of the reply.

    ``replies`` has one row (keys, reply) per burst.
    """
    scored = questions.join(replies, keys).select(*keys, F.col(id).alias("__id"), answer_score(text, "reply").alias("__score"))
    of_score = scored.groupBy(*keys, "__score").agg(F.count(F.lit(1)).alias("__ties"), F.min("__id").alias("answered_id"))
    best = of_score.groupBy(*keys).agg(
        F.sum("__ties").alias("__n"), F.max("__score").alias("__top"), F.max_by(F.struct("__ties", "answered_id"), "__score").alias("__best")
    )
    clear = (F.col("__n") >= 2) & (F.col("__top") >= 3) & (F.col("__best.__ties") == 1)
    return best.filter(clear).select(*keys, "__best.answered_id")


def quote_target(
    placed: DataFrame, replies: DataFrame, keys: list[str], ts: str = "ts", id: str = "message_id", text: str = "text"
) -> DataFrame:
    """Message to quote per burst: the explicit one, the first message that is itself a reply, the answered
    question, else 0.  ``replies``: (keys, reply, explicit_id)."""
    quoted = placed.groupBy(*keys).agg(
        F.min_by(F.when(F.col("reply_to_id").isNotNull(), F.col(id)), F.when(F.col("reply_to_id").isNotNull(), F.struct(ts, id))).alias("__quoted")
    )
    linked = link_answer(placed.filter(is_question(text)), replies.select(*keys, "reply"), keys, id, text)
    rows = quoted.join(replies, keys, "left").join(linked, keys, "left")
    explicit = F.when(F.col("explicit_id") > 0, F.col("explicit_id"))
    return rows.select(*keys, F.coalesce(explicit, "__quoted", "answered_id", F.lit(0)).alias("quote_id"))


def allow_list(messages: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Messages of allowed users; works with a stream on the left."""
    return messages.join(users.select(user), user, "left_semi")


def pseudonymise(id, salt: str) -> Column:
    """'user_' and the first 12 hex digits of HMAC-SHA-256(salt, id)."""
    import hashlib

    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.encode(col(id).cast("string"), "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.concat(F.lit("user_"), F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 12))
