"""Chat transcripts in text, Markdown, JSON and HTML to raw messages.

Raw messages: chat_id, line_no, id, ts_raw, ts, sender, content, reply_to_id, media_type.

Text and Markdown files are read by line and split like any text file, so one huge file is many
tasks.  The block a line comes from is its chunk for the ordered scans.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import lexicons as lx
from colloquy.functions import clean
from colloquy.functions.text import has, trim
from colloquy.operators.normalize import parse_timestamp
from colloquy.plans import lineage
from colloquy.plans.ordered import scan
from colloquy.sources.json_pieces import elements, large_files, read_pieces

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW = ["chat_id", "line_no", "id", "ts_raw", "ts", "sender", "content", "reply_to_id", "media_type"]
_TIME = r"\d{1,2}:\d{1,2}(?::\d{1,2})?"
_YMD = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
_STAMP = rf"{_YMD}[,\sT]+{_TIME}"
_BODY = r"\s*[:：]\s*(.*)\z"
# Message line forms (fixed formats): pattern, groups of (time, sender, body).
TEXT_FORMS = [
    (rf"^({_YMD}\s+{_TIME})\s+([^:\n\r]+?){_BODY}", (1, 2, 3)),
    (rf"^\[(\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}[,\s]+{_TIME})\]\s*([^:\n\r]+?){_BODY}", (1, 2, 3)),
    (rf"^(\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}},\s*{_TIME})\s*-\s*([^:\n\r]+?){_BODY}", (1, 2, 3)),
    (rf"^(?!https?://)([a-zA-Z0-9_一-龥]{{2,15}}){_BODY}", (0, 1, 2)),
]
MARKDOWN_FORMS = {
    "header_time": (rf"^#{{1,4}}\s*\[?({_YMD}(?:[,\sT]+{_TIME})?)\]?\s+([^\n\r:]{{1,25}})(?:\s*[:：]\s*(.*))?\z", (1, 2, 3)),
    "bold": (rf"^\*{{2}}(.+?)\*{{2}}(?:\s*[(\[]({_STAMP})[)\]])?{_BODY}", (2, 1, 3)),
    "time": (rf"^\[?({_STAMP})\]?\s*[-:]?\s*([^:\n\r]+?){_BODY}", (1, 2, 3)),
    "quote": (rf"^>\s*(?:\[?({_STAMP})\]?)?\s*([^:\n\r]+?){_BODY}", (1, 2, 3)),
    "bullet": (rf"^[-*]\s+(?:\*{{2}})?([^:\n\r]+?)(?:\*{{2}})?{_BODY}", (0, 1, 2)),
    "header": (rf"^#{{1,4}}\s*([^:\n\r()\[\]]{{1,25}})\s*(?:[(\[]({_STAMP})[)\]]\s*[:：]?|[:：])\s*(.*)\z", (2, 1, 3)),
    "speaker": (rf"^(?!https?://|//)([a-zA-Z0-9_一-龥\s]{{1,20}}){_BODY}", (0, 1, 2)),
}
NOT_A_SPEAKER = "(?i)conversation|chat|section|notice"
RULER = rf"^[-=_]{{3,}}\s*\[?{_YMD}.*[-=_]{{3,}}\z"


# Kinds of transcript files by the end of their name, in either case.
KINDS = {"json": ["json"], "rows": ["jsonl"], "page": ["html", "htm"], "markdown": ["md"], "text": ["txt", "csv", "log"]}


def _ends(kind: str | None = None) -> str:
    """Pattern of the names of a kind, or of any known kind."""
    ends = KINDS[kind] if kind else [e for ends in KINDS.values() for e in ends]
    return rf"(?i)\.(?:{'|'.join(ends)})\z"


def _glob(kind: str) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in KINDS[kind]) + "}"


def read_lines(spark: SparkSession, path: str | list[str], kind: str | None = None, known: bool = True) -> DataFrame:
    """(chat_id, block, place, line) of text files; (block, place) orders the lines of a file.

    Only files of one kind are opened if it is given, and only those of no known kind if not ``known``.
    """
    lines = spark.read.options(**({"pathGlobFilter": _glob(kind)} if kind else {})).text(path)
    if not known:
        lines = lines.filter(~F.col("_metadata.file_path").rlike(_ends()))
    return lines.select(
        F.col("_metadata.file_path").alias("chat_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.rtrim(F.regexp_replace("value", r"[\s\x{3000}]+\z", "")).alias("line"),
    )


def _group(pattern: str, i: int) -> Column:
    return trim(F.regexp_extract("line", pattern, i)) if i else F.lit("")


def _fields(lines: DataFrame, forms: dict) -> DataFrame:
    """Add ts_raw, sender and body according to the form of each line."""

    def pick(place: int, otherwise: Column) -> Column:
        out = otherwise
        for name, (pattern, groups) in forms.items():
            out = F.when(F.col("form") == name, _group(pattern, groups[place])).otherwise(out)
        return out

    return lines.withColumns(
        {"ts_raw": pick(0, F.lit("")), "sender": pick(1, F.lit("")), "body": pick(2, trim("line"))}
    )


def _messages(lines: DataFrame) -> DataFrame:
    """Lines with (head, stop, ts_raw, ts, sender, body) to messages.

    Lines between a stop and the next head belong to nothing.
    """
    block = F.col("block")
    begins = (F.col("head") | F.col("stop")).cast("int")
    # Lines that follow no head are dropped before the lines of a message are put together.
    inside = F.when(F.col("head"), True).when(F.col("stop"), False)
    numbered = scan(
        lines, ["chat_id"], ["block", "place"], chunk=block, running={"line_no": begins}, last_seen={"inside": inside}
    ).filter("inside")
    grouped = numbered.groupBy("chat_id", "line_no").agg(
        F.max("head").alias("head"),
        F.max(F.when(F.col("head"), F.struct("ts_raw", "sender", "ts"))).alias("h"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "body"))), lambda x: x["body"]), "\n"
        ).alias("content"),
    )
    none = F.lit(None).cast("string")
    return grouped.filter("head").select(
        "chat_id", F.col("line_no").cast("long"), none.alias("id"), F.nullif(F.col("h.ts_raw"), F.lit("")).alias("ts_raw"),
        F.col("h.ts").alias("ts"), F.col("h.sender").alias("sender"), "content",
        none.alias("reply_to_id"), none.alias("media_type"),
    )


def text_messages(lines: DataFrame) -> DataFrame:
    """Messages of plain-text transcripts."""
    line = F.col("line")
    stop = clean.is_date_header(line) | has(line, RULER) | clean.is_system_notice(line) | clean.is_group_announcement(line)
    rows = lines.filter((line != "") & ~has(trim(line), r"^[-=_*]{3,}\z"))
    form = F.coalesce(*[F.when(has(line, p), F.lit(i)) for i, (p, _) in enumerate(TEXT_FORMS)])
    staged = _fields(
        rows.withColumns({"stop": stop, "form": form}), dict(enumerate(TEXT_FORMS))
    ).withColumn("head", F.col("form").isNotNull() & ~F.col("stop"))
    return _messages(staged.withColumn("ts", parse_timestamp(F.nullif(F.col("ts_raw"), F.lit("")))))


def markdown_messages(lines: DataFrame) -> DataFrame:
    """Messages of Markdown transcripts; untimed ones count minutes from the last known time."""
    line = F.col("line")
    rows = lines.filter(~has(trim(line), r"^[-*_]{3,}\z"))
    dated = clean.is_date_header(line)

    def fits(name: str, pattern: str, s: int) -> Column:
        sender = _group(pattern, s)
        hit = has(line, pattern)
        if name in ("quote", "bullet"):
            return hit & (sender != "") & ~F.startswith(sender, F.lit("http"))
        if name == "header":
            return hit & (sender != "") & ~has(sender, NOT_A_SPEAKER) & ~clean.is_system_sender(sender)
        if name == "speaker":
            return hit & ~clean.is_system_sender(sender)
        return hit & (sender != "")

    form = F.coalesce(*[F.when(fits(n, p, s), F.lit(n)) for n, (p, (_, s, _)) in MARKDOWN_FORMS.items()])
    staged = _fields(rows.withColumn("form", form), MARKDOWN_FORMS)
    staged = staged.withColumn("__date", F.when(dated, clean.date_from_header(line)))
    blank = line == ""
    heading = F.col("form").isNull() & has(line, r"^#{1,6}\s+")
    bad = F.col("form").isNotNull() & (clean.is_system_sender("sender") | (~(F.col("body") == "") & clean.is_purged("body")))
    stop = ~blank & (dated | clean.is_purged(line) | heading | bad)
    staged = staged.withColumn("stop", stop).withColumn("head", F.col("form").isNotNull() & ~stop & ~blank)
    given = parse_timestamp(F.nullif(F.col("ts_raw"), F.lit("")))
    anchors = F.when(dated, parse_timestamp("__date")).when(
        F.col("head") & F.col("form").isin("bold", "quote", "header"), given
    )
    untimed = (F.col("head") & (F.col("ts_raw") == "")).cast("int")
    clock = scan(
        staged.withColumns({"__given": given, "__anchor": anchors, "__untimed": untimed}),
        ["chat_id"], ["block", "place"], chunk=F.col("block"), running={"__count": F.col("__untimed")},
    )
    clock = scan(
        clock, ["chat_id"], ["block", "place"], chunk=F.col("block"),
        last_seen={"__base": F.when(F.col("__anchor").isNotNull(), F.struct(F.col("__anchor").alias("t"), F.col("__count").alias("c")))},
    )
    ticks = F.make_dt_interval(secs=((F.col("__count") - F.col("__base.c")) * 60).cast("decimal(18,6)"))
    timed = F.when(F.col("ts_raw") != "", F.col("__given")).otherwise(F.col("__base.t") + ticks)
    messages = _messages(clock.withColumn("ts", timed))
    return messages.filter(trim("content") != "")


def _alias(row: Column, names: list[str], kind: str = "string") -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(row, f"$.{n}", kind), F.lit("")) for n in names])


def _not_noise(text: Column) -> Column:
    return ~clean.is_system_notice(text) & ~clean.is_group_announcement(text)


def export_messages(documents: DataFrame) -> DataFrame:
    """(chat_id, v variant) of chat export objects -> messages."""
    return _export_rows(_export_items(documents))


def _export_items(documents: DataFrame) -> DataFrame:
    items = F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("line_no", "m")
    return documents.select("chat_id", items).withColumn("line_no", F.col("line_no").cast("long"))


def _export_rows(items: DataFrame) -> DataFrame:
    m = F.col("m")
    parts = F.try_variant_get(m, "$.text", "array<variant>")
    joined = F.array_join(
        F.transform(
            parts,
            lambda p: F.coalesce(
                F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")),
                F.try_variant_get(p, "$.text", "string"),
                F.lit(""),
            ),
        ),
        "",
    )
    plain = F.try_variant_get(m, "$.text", "string")
    media = F.try_variant_get(m, "$.media_type", "string")
    text = F.coalesce(F.nullif(F.coalesce(F.when(parts.isNotNull(), joined), plain), F.lit("")), F.concat(F.lit("["), media, F.lit("]")), F.lit(""))
    tag = F.lit("tg_")
    reply = F.try_variant_get(m, "$.reply_to_message_id", "string")
    raw_time = F.try_variant_get(m, "$.date", "string")
    rows = items.filter(F.try_variant_get(m, "$.type", "string") == "message").select(
        "chat_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.concat(tag, F.try_variant_get(m, "$.id", "string")).alias("id"),
        raw_time.alias("ts_raw"),
        parse_timestamp(raw_time).alias("ts"),
        F.coalesce(
            _alias(m, ["from", "actor"]),
            F.concat(F.lit("User_"), F.try_variant_get(m, "$.from_id", "string")),
            F.lit("Unknown"),
        ).alias("sender"),
        text.alias("content"),
        F.concat(tag, reply).alias("reply_to_id"),
        F.coalesce(media, F.when(F.try_variant_get(m, "$.photo", "string").isNotNull(), F.lit("image"))).alias("media_type"),
    )
    return rows.filter(_not_noise(F.col("content")))


def row_messages(rows: DataFrame) -> DataFrame:
    """(chat_id, line_no, m variant) of message objects with any of the known field names."""
    m = F.col("m")
    content = F.coalesce(
        _alias(m, ["content", "text", "message", "body"]),
        F.to_json(F.coalesce(*[F.try_variant_get(m, f"$.{n}", "variant") for n in ("content", "text", "message", "body")])),
        F.lit(""),
    )
    raw_time = _alias(m, ["timestamp", "date", "time", "created_at"])
    out = rows.select(
        "chat_id",
        "line_no",
        F.coalesce(_alias(m, ["id"]), F.concat(F.lit("json_msg_"), (F.col("line_no") + 1).cast("string"))).alias("id"),
        raw_time.alias("ts_raw"),
        parse_timestamp(raw_time).alias("ts"),
        F.coalesce(_alias(m, ["sender", "from", "author", "speaker", "role", "user.name"]), F.lit("Unknown")).alias("sender"),
        content.alias("content"),
        _alias(m, ["replyToId", "reply_to", "reply_to_id"]).alias("reply_to_id"),
        _alias(m, ["media_type", "mediaType"]).alias("media_type"),
    )
    return out.filter(_not_noise(F.col("content")))


# A JSON document beyond this size does not fit the type it is parsed to, and is read in pieces.
MAX_JSON_BYTES = 128 * 1024 * 1024


def _documents(spark: SparkSession, path: str | list[str], whole_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((chat_id, v) of the JSON documents that are parsed whole, (chat_id, name, line_no, m) of those that are too large)."""
    limit = MAX_JSON_BYTES if whole_bytes is None else whole_bytes
    whole = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") < limit)
    docs = whole.select(F.col("_metadata.file_path").alias("chat_id"), F.try_parse_json("value").alias("v"))
    large = large_files(spark, path, limit)
    return docs, elements(read_pieces(spark, large)) if large else None


def read_chat_export_json(spark: SparkSession, path: str | list[str], whole_bytes: int | None = None) -> DataFrame:
    """Export objects, one per file; files of ``whole_bytes`` (128 MiB) and more are read in pieces by many tasks."""
    docs, large = _documents(spark, path, whole_bytes)
    items = _export_items(docs)
    return _export_rows(items if large is None else items.unionByName(_large_export(large)))


def _large_export(large: DataFrame) -> DataFrame:
    # A file that is an error has a row without a name, which raises when it is read.
    return large.filter("name in ('messages', '')").drop("name")


def json_lines(lines: DataFrame) -> DataFrame:
    """JSON lines with a line number per file; lines that do not parse are left out."""
    parsed = lines.withColumn("m", F.try_parse_json("line")).filter(F.col("m").isNotNull())
    light = parsed.select("chat_id", "block", "place", F.to_json("m").alias("j"))
    numbered = scan(light, ["chat_id"], ["block", "place"], chunk=F.col("block"), number="n")
    return numbered.select("chat_id", (F.col("n") - 1).alias("line_no"), F.try_parse_json("j").alias("m"))


def read_chat_json_rows(spark: SparkSession, path: str | list[str], lines: bool = False, whole_bytes: int | None = None) -> DataFrame:
    """An array, ``{data: [...]}`` or ``{history: [...]}`` per file, large ones in pieces; with ``lines`` one object per line."""
    if lines:
        return row_messages(json_lines(read_lines(spark, path)))
    docs, large = _documents(spark, path, whole_bytes)
    items = _array_rows(docs)
    return row_messages(items if large is None else items.unionByName(_large_rows(large)))


def _large_rows(large: DataFrame) -> DataFrame:
    """The rows of the first of the arrays known that a document has."""
    place = F.array_position(F.array(F.lit("$"), F.lit("data"), F.lit("history")), F.col("name"))
    known = large.withColumn("__place", place).filter("__place > 0 or name = ''")
    first = known.groupBy("chat_id").agg(F.min("__place").alias("__place"))
    return known.join(first, ["chat_id", "__place"]).select("chat_id", "line_no", "m")


def _array_rows(docs: DataFrame) -> DataFrame:
    items = F.coalesce(
        *[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.data", "$.history")]
    )
    return docs.select("chat_id", F.posexplode(items).alias("line_no", "m")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


class _Node:
    """An open message element: its own text and the text of the fields inside it."""

    def __init__(self, depth: int, attrs: dict, classes: list[str]):
        self.depth, self.attrs, self.classes = depth, attrs, classes
        self.text: list[str] = []
        self.fields: dict[str, list[str]] = {}
        self.title: str | None = None


class _Messages(HTMLParser):
    VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
    FIELDS = {
        "from_name", "date", "text", "sender", "author", "user", "content", "body", "time", "timestamp",
    }

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.tags: list[str] = []
        self.open: list[_Node] = []
        self.inside: list[tuple[int, _Node, str]] = []
        self.done: list[_Node] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        if tag in self.VOID:
            return
        self.tags.append(tag)
        depth = len(self.tags)
        for node in self.open:
            for name in self.FIELDS.intersection(classes):
                node.fields.setdefault(name, [])
                self.inside.append((depth, node, name))
                if name == "date" and node.title is None:
                    node.title = attrs.get("title")
        if self.wanted(attrs, classes):
            node = _Node(depth, attrs, classes)
            self.open.append(node)
            self.done.append(node)

    def handle_endtag(self, tag):
        if tag not in self.tags:
            return
        # Tags left open inside end with the one that is closed.
        while self.tags.pop() != tag:
            pass
        depth = len(self.tags)
        self.inside = [x for x in self.inside if x[0] <= depth]
        self.open = [n for n in self.open if n.depth <= depth]

    def handle_data(self, data):
        for node in self.open:
            node.text.append(data)
        for _, node, name in self.inside:
            node.fields[name].append(data)


def _page_rows(html: str) -> list[tuple]:
    """(message number, id, sender or None, raw time, text) of a page."""

    def parse(wanted) -> list[_Node]:
        parser = _Messages(wanted)
        parser.feed(html or "")
        return parser.done

    def text(node: _Node, *names: str) -> str:
        return "".join("".join(node.fields.get(n, [])) for n in names).strip()

    rows = []
    for i, node in enumerate(parse(lambda a, c: "message" in c), start=1):
        if "service" in node.classes:
            continue
        sender = text(node, "from_name") if "from_name" in node.fields else None
        rows.append((i, node.attrs.get("id") or f"html_msg_{i}", sender, node.title or text(node, "date") or None, text(node, "text")))
    if any(r[4] for r in rows):
        return rows
    rows = []
    for i, node in enumerate(parse(lambda a, c: "chat-message" in c or "bubble" in c or "data-sender" in a), start=1):
        sender = node.attrs.get("data-sender") or text(node, "sender", "author", "user") or "Speaker"
        body = text(node, "content", "text", "body") or "".join(node.text).strip()
        rows.append((i, f"html_{i}", sender, text(node, "time", "timestamp", "date") or None, body))
    return rows


def extract_messages_html(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with a column of HTML -> messages; the sender of a message without one is the last named."""
    kind = dict(pages.dtypes)[id]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, *row) for page, source in zip(batch[id], batch[html], strict=True) for row in _page_rows(source)]
            yield pd.DataFrame(rows, columns=[id, "line_no", "id", "named", "ts_raw", "content"])

    found = pages.select(id, html).mapInPandas(
        parse, f"`{id}` {kind}, line_no long, id string, named string, ts_raw string, content string"
    )
    carried = scan(found, [id], ["line_no"], last_seen={"sender": F.col("named")})
    none = F.lit(None).cast("string")
    return carried.filter((F.col("content") != "") & _not_noise(F.col("content"))).select(
        F.col(id).cast("string").alias("chat_id"), "line_no", "id", "ts_raw", parse_timestamp("ts_raw").alias("ts"),
        F.coalesce("sender", F.lit("Unknown")).alias("sender"), "content", none.alias("reply_to_id"), none.alias("media_type"),
    )


def read_messages_html(spark: SparkSession, path: str | list[str]) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("html"))
    return extract_messages_html(pages, "page", "html")


def read_transcript_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return text_messages(read_lines(spark, path))


def read_transcript_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return markdown_messages(read_lines(spark, path))


def _manifest(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """Number of files and largest size for each kind of file in a folder; "other" is what no kind claims."""
    kind = F.coalesce(*[F.when(F.col("path").rlike(_ends(k)), F.lit(k)) for k in KINDS], F.lit("other"))
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    rows = files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest")).collect()
    return {r.kind: (r.n, r.largest) for r in rows}


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """All transcripts of a folder, by file name in either case.

    Other files are read as a JSON document if they start like one and hold messages, else tried as JSON lines,
    Markdown, then text.  A count of the files by kind comes first, and only kinds that are there are planned, each over
    its own files.  Where the content has to decide, it is looked up when this is called, and the names of the files
    are kept as a table, so that no reader repeats the plan of the one before.  A folder without files gives no rows.
    """
    found = _manifest(spark, folder)
    parts = []

    def names(rows: DataFrame) -> DataFrame:
        return lineage.cut(rows.select("chat_id").distinct())

    if "text" in found:
        parts.append(text_messages(read_lines(spark, folder, "text")))
    if "page" in found:
        whole = spark.read.option("pathGlobFilter", _glob("page")).text(folder, wholetext=True)
        parts.append(extract_messages_html(whole.select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("html")), "page", "html"))
    if "rows" in found:
        parts.append(row_messages(json_lines(read_lines(spark, folder, "rows"))))
    if "json" in found:
        parts += _json_files(spark, folder, found["json"][1], names)
    tried = read_lines(spark, folder, "markdown") if "markdown" in found else None
    if "other" in found:
        other, more = _other_files(spark, folder, names)
        parts += more
        tried = other if tried is None else tried.unionByName(other)
    if tried is not None:
        markdown = markdown_messages(tried)
        hit = names(markdown)
        parts.append(markdown)
        if hit.count() < found.get("markdown", (0, 0))[0] + found.get("other", (0, 0))[0]:
            parts.append(text_messages(tried.join(hit, "chat_id", "left_anti")))
    if not parts:
        parts.append(text_messages(read_lines(spark, folder, "text")))
    out = parts[0].select(*RAW)
    for part in parts[1:]:
        out = out.unionByName(part.select(*RAW))
    return out


def _holds() -> Column:
    """Whether a JSON document ``v`` holds messages."""
    return F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.messages", "$.data", "$.history")]).isNotNull()


def _json_files(spark: SparkSession, folder: str, largest: int, names: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Messages of the .json files: documents, those too large to be parsed whole, and files that hold rows."""
    whole = spark.read.option("pathGlobFilter", _glob("json")).text(folder, wholetext=True)
    whole = whole.filter(F.col("_metadata.file_size") < MAX_JSON_BYTES)
    docs = whole.select(F.col("_metadata.file_path").alias("chat_id"), F.try_parse_json("value").alias("v"))
    parts = [export_messages(docs), row_messages(_array_rows(docs))]
    # A .json file may hold rows, of which the parser takes the first for the document.
    no_document = docs.filter(F.col("v").isNull() | ~_holds())
    if largest >= MAX_JSON_BYTES:
        large = [f for f in large_files(spark, folder, MAX_JSON_BYTES) if f.lower().endswith(".json")]
        pieces = elements(read_pieces(spark, large))
        parts += [_export_rows(_large_export(pieces)), row_messages(_large_rows(pieces))]
        files = spark.read.format("binaryFile").option("pathGlobFilter", _glob("json")).load(folder).filter(F.col("length") >= MAX_JSON_BYTES)
        files = files.select(F.col("_metadata.file_path").alias("chat_id"))
        no_document = no_document.select("chat_id").unionByName(files.join(names(pieces.filter("name <> ''")), "chat_id", "left_anti"))
    no_document = names(no_document)
    if no_document.count():
        said = F.coalesce(*[F.try_variant_get("m", f"$.{n}", "variant") for n in ("content", "text", "message", "body")]).isNotNull()
        lines = read_lines(spark, folder, "json").join(no_document, "chat_id", "left_semi")
        parts.append(row_messages(json_lines(lines).filter(said)))
    return parts


def _other_files(spark: SparkSession, folder: str, names: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """(lines of the files of no known kind that are not JSON, messages of those that are)."""
    lines = read_lines(spark, folder, known=False)
    # Files that start like JSON may be one document.
    first = lines.filter(trim("line") != "").groupBy("chat_id").agg(F.min_by(trim("line"), F.struct("block", "place")).alias("l"))
    likely = [r.chat_id for r in first.filter(F.substring("l", 1, 1).isin("{", "[")).select("chat_id").collect()]
    parts, rest = [], lines
    if likely:
        odd = spark.read.text([unquote(n) for n in likely], wholetext=True)
        odd = odd.select(F.col("_metadata.file_path").alias("chat_id"), F.try_parse_json("value").alias("v")).filter(_holds())
        parts = [export_messages(odd), row_messages(_array_rows(odd))]
        rest = lines.join(names(odd), "chat_id", "left_anti")
    rows = row_messages(json_lines(rest))
    return rest.join(names(rows), "chat_id", "left_anti"), [*parts, rows]
