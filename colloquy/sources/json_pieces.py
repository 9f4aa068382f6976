"""Elements of JSON documents of any size, by many tasks.

A file is read as pieces that end at every ``}``, which Spark splits like lines.  What a piece means depends on all that
stands before it, and is carried by ordered scans over the blocks of the file: first the number of quotes, which says
whether a piece starts inside a string; then the depth of brackets at its start; then the kind of root, the root key in
force and the number of the element.  The pieces of one element are put together and parsed alone.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.ordered import scan

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
#: Whole strings, marks, and what stands between them.
_TOKEN = rf'(?s){_STRING}"?|[\[\]{{}}:]|[^"\[\]{{}}:]++'
_REST_OF_STRING = r'(?s)\A[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BY = {"keys": ["chat_id"], "order": ["block", "place"]}


def read_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chat_id, block, place, size, piece): what stands between one closing brace and the next."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("chat_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"),
    )


def large_files(spark: SparkSession, path: str | list[str], least: int) -> list[str]:
    """Names of the files of at least so many bytes; their content is not read."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") >= least)
    return [unquote(r.file_path) for r in files.select("_metadata.file_path").collect()]


def _walk(tokens: Column, depth: Column) -> Column:
    """struct(key, first, open1, open2): last root key set, first mark, places of the last braces opened at depth 1 and 2."""
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("long")
    zero = F.struct(
        depth.alias("depth"), F.lit(0).cast("long").alias("at"), none.alias("last"), none.alias("pending"), none.alias("key"), none.alias("first"),
        nowhere.alias("open1"), nowhere.alias("open2"),
    )

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("[", "{"), t.isin("]", "}")
        one = s["depth"] == 1
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            (s["at"] + F.length(t)).cast("long").alias("at"),
            F.when(F.startswith(t, F.lit('"')), t).otherwise(s["last"]).alias("last"),
            F.when(one & (t == ":"), s["last"]).otherwise(s["pending"]).alias("pending"),
            F.when(one & opens, F.concat(s["pending"], t)).otherwise(s["key"]).alias("key"),
            F.coalesce(s["first"], F.when(opens, t)).alias("first"),
            F.when(one & (t == "{"), s["at"]).otherwise(s["open1"]).alias("open1"),
            F.when((s["depth"] == 2) & (t == "{"), s["at"]).otherwise(s["open2"]).alias("open2"),
        )

    return F.aggregate(tokens, zero, step)


def elements(pieces: DataFrame) -> DataFrame:
    """(chat_id, name, line_no, m variant) of the objects in a root array (name ``$``) or in arrays of a root object.

    Objects are numbered from 0 in their array; entries that are no objects are left out and not counted.  A file whose
    brackets do not close is an error.  One element has to fit a row; a file does not.
    """
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    rows = scan(pieces.withColumn("quotes", quotes.cast("long")), **_BY, chunk=F.col("block"), running={"quoted": F.col("quotes")})
    inside = (F.col("quoted") - F.col("quotes")) % 2 == 1
    skip = F.when(inside, F.length(F.regexp_extract("piece", _REST_OF_STRING, 0))).otherwise(0)
    started = F.when(inside & (F.col("skip") == 0), F.lit("")).otherwise(F.substring(F.col("piece"), F.col("skip") + 1, F.length("piece")))
    rows = rows.withColumn("skip", skip).withColumn("tokens", F.regexp_extract_all(started, F.lit(_TOKEN), F.lit(0)))
    # The brace that ended the piece is a mark unless the piece ends inside a string.
    ended = F.when(F.col("quoted") % 2 == 0, 1).otherwise(0)
    marks = lambda *m: F.size(F.filter("tokens", lambda t: t.isin(*m)))
    rows = rows.withColumn("step", (marks("[", "{") - marks("]", "}") - ended).cast("long"))
    rows = scan(rows, **_BY, chunk=F.col("block"), running={"depth": F.col("step")})
    rows = rows.withColumn("start", F.col("depth") - F.col("step")).withColumn("w", _walk(F.col("tokens"), F.col("start")))
    rows = rows.select("chat_id", "block", "place", "piece", "size", "start", "step", "skip", "w.key", "w.open1", "w.open2", F.col("w.first").alias("first"))
    placed = scan(
        rows, **_BY, chunk=F.col("block"),
        last_seen={"root": F.when(F.col("start") == 0, F.col("first")), "name": F.col("key")},
        running={"n1": F.col("open1").isNotNull().cast("int"), "n2": F.col("open2").isNotNull().cast("int")},
    )
    array = F.col("root") == "["
    level, at, n = F.when(array, 1).otherwise(2), F.when(array, F.col("open1")).otherwise(F.col("open2")), F.when(array, F.col("n1")).otherwise(F.col("n2"))
    placed = placed.withColumns({"at": at, "n": n, "name": F.when(array, "$").otherwise(F.regexp_extract("name", r'(?s)\A"(.*)"\[\z', 1))})
    own = placed.filter((F.col("name") != "") & (F.col("at").isNotNull() | (F.col("start") > level)))
    text = F.concat(F.when(F.col("at").isNotNull(), F.substring(F.col("piece"), (F.col("skip") + F.col("at") + 1).cast("int"), F.length("piece"))).otherwise(F.col("piece")), F.lit("}"))
    whole = own.groupBy("chat_id", "name", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", text.alias("t")))), lambda x: x["t"]), "").alias("text")
    )
    first = whole.groupBy("chat_id", "name").agg(F.min("n").alias("from"))
    found = whole.join(first, ["chat_id", "name"]).select("chat_id", "name", (F.col("n") - F.col("from")).cast("long").alias("line_no"), F.try_parse_json("text").alias("m"))
    # The last piece may end with the file instead of a brace.
    total = placed.groupBy("chat_id").agg(F.sum("step").alias("depth"), F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"))
    open_at_end = F.col("depth") + F.when(F.col("bytes") > F.col("size"), 1).otherwise(0)
    why = F.concat(F.lit("a JSON document of "), F.col("size").cast("string"), F.lit(" bytes, too large to be parsed whole, does not close its brackets"))
    broken = total.filter((open_at_end != 0) & F.raise_error(why).cast("boolean")).select(
        "chat_id", F.lit("").alias("name"), F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("variant").alias("m")
    )
    return found.unionByName(broken)
