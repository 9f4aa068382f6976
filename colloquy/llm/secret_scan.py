"""Secret scan by corpus-wide ownership frequency.

Candidates are found in every text by fixed patterns.  The hash of each candidate is counted over the
distinct repositories and owners that hold it: what many owners copied is an example from some manual,
what a single owner keeps in few places looks alive.  The base patterns always report; candidates of
the wider pattern (``opaque``: long runs of mixed letters and digits) are added only where they are
owner-specific and touch no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import text_of

# Kind, pattern, group that holds the secret, least length of the secret.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs are longest matches, so the least length can stand in the pattern.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
]
BASE = 3
MAX_OWNERS = 1
MAX_REPOSITORIES = 3


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id"), text_of())


def candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """(doc_id, row_key, kind, start, end, secret, repository, owner): code points, end exclusive.

    Starts come from the lengths of the gaps and matches before, summed within a text.
    """
    rows = docs.select(
        "doc_id", _row_key(docs).alias("row_key"), text_of().alias("text"),
        F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
    )
    of_kind = []
    for kind, (name, pattern, group, least) in enumerate(KINDS):
        p = F.lit(pattern)
        found = rows.filter(F.col("text").rlike(pattern)).select(
            "doc_id", "row_key", "repository", "owner", F.split("text", pattern, -1).alias("gaps"),
            F.regexp_extract_all("text", p, F.lit(0)).alias("found"), F.regexp_extract_all("text", p, F.lit(group)).alias("secrets"),
        )
        zipped = F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("found")).alias("gap"), "found", "secrets"))
        of_kind.append(
            found.select("doc_id", "row_key", "repository", "owner", F.lit(kind).alias("kind"), zipped.alias("nr", "x")).select(
                "doc_id", "row_key", "repository", "owner", "kind", "nr",
                F.length("x.gap").alias("gap"), F.length("x.found").alias("size"), F.col("x.secrets").alias("secret_text"),
            )
        )
    every = of_kind[0]
    for more in of_kind[1:]:
        every = every.union(more)
    at = Window.partitionBy("row_key", "kind", "doc_id", "repository", "owner").orderBy("nr")
    # Repeated rows count once.
    every = every.dropDuplicates(["row_key", "kind", "doc_id", "repository", "owner", "nr"])
    every = every.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(at))
    mixed = F.col("secret_text").rlike("[0-9].*[0-9]") & F.col("secret_text").rlike("[A-Z]") & F.col("secret_text").rlike("[a-z]")
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    return every.filter((F.length("secret_text") >= least) & ((F.col("kind") < BASE) | mixed)).select(
        "doc_id", "row_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end",
        F.sha2("secret_text", 256).alias("secret"), "repository", "owner",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(secret, n_repositories, n_owners): distinct holders; nulls count as one holder of their own."""
    by_owner = found.select("secret", "owner", "repository").distinct().groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: doc_id, row_key, n_assign, n_access, n_hex, base_spans, spans, n_live, n_copied.

    spans: kind:start:end by start, then kind, comma-joined; n_live and n_copied count the reported spans whose
    secret is owner-specific or not.  Null text is empty and has none; a null doc_id stays null; repeated rows
    have one result each; columns other than doc_id, text, repository and owner are ignored.  row_key is a hash of id
    and text, by which ``redact`` tells rows of one id apart.
    """
    found = candidates(docs, repository, owner)
    counts = ownership(found).select("secret", ((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).alias("live"))
    spans = found.select("doc_id", "row_key", "kind", "start", "end", "secret").distinct()
    judged = spans.join(counts, "secret").filter((F.col("kind") < BASE) | F.col("live"))
    by_row = judged.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < BASE)
    by_row = by_row.withColumn("base", base).withColumn(
        "all",
        F.filter("all", lambda s: (s["kind"] < BASE) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
    )
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda c, keep: F.size(F.filter(c, keep)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    found_rows = by_row.select(
        F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"),
        *[number("base", of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        shown("base").alias("base_spans"), shown("all").alias("spans"),
        number("all", lambda s: s["live"]).alias("n_live"), number("all", lambda s: ~s["live"]).alias("n_copied"),
    )
    rows = docs.select("doc_id", _row_key(docs).alias("row_key"))
    joined = rows.join(found_rows, (F.col("row_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return joined.select("doc_id", "row_key", zero("n_assign"), zero("n_access"), zero("n_hex"), empty("base_spans"), empty("spans"), zero("n_live"), zero("n_copied"))


def redact(docs: DataFrame, spans: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with the reported spans of their ``scan`` masked, other columns as they are; one row out per row in.

    A row is known by its id and text, so texts that share an id, or have none, keep their own spans, and repeated rows
    are all masked alike.  A span that begins inside the one before gives no mask of its own.  A null text stays null.
    """
    found = spans.filter(F.col("spans") != "").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("spans").alias("__spans"))
    marks = found.dropDuplicates(["__id", "__key"])
    joined = docs.join(marks, (_row_key(docs) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    parsed = F.array_sort(F.transform(F.split("__spans", ","), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["end"] <= acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.lit(mask))).alias("out"),
    )
    done = F.aggregate(parsed, zero, step)
    masked = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked)).select(*docs.columns)
