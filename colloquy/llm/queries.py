"""Queries of the operators in this folder, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bloom_fingerprints, decontamination, fill_in_middle, hard_negatives, language_id, line_dedup, order_minhash, packing, quality_cascade, quote_threads, secret_scan, substring_dedup, suffix_tree_lm
from colloquy.llm.common import LOWER, UPPER, WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\x20\\x09\\x0B-\\x0D]', '\\1' || chr(10), 'g'), chr(10)) AS u FROM documents),
    e AS (SELECT r, doc_id, i, u[i] AS t, CAST(sum(length(u[i]) + 1) OVER (PARTITION BY r ORDER BY i) AS BIGINT) - 1 AS z FROM d, unnest(range(1, len(u) + 1)) AS x(i)),
    w AS (SELECT r, doc_id, i, z - length(t) AS a, z, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{decontamination.ITEM_WORD}') AS w FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS no FROM w WHERE len(w) > 0),
    f AS (SELECT w, min({{'doc': doc_id, 'no': no}}) AS f FROM n GROUP BY w),
    x AS (SELECT n.*, f.f.doc AS first_doc, no - row_number() OVER (PARTITION BY r ORDER BY no) AS run FROM n JOIN f USING (w) WHERE {{'doc': n.doc_id, 'no': n.no}} > f.f)
    SELECT doc_id, CAST(arg_min(a, no) FILTER (len(w) >= 4) AS BIGINT) AS start, arg_max(z, no) FILTER (len(w) >= 4) AS "end",
    max(no) FILTER (len(w) >= 4) - min(no) FILTER (len(w) >= 4) + 1 AS n_units, CAST(sum(len(w)) FILTER (len(w) >= 4) AS BIGINT) AS n_words,
    arg_min(first_doc, no) FILTER (len(w) >= 4) AS first_doc_id FROM x GROUP BY r, doc_id, run HAVING sum(len(w)) FILTER (len(w) >= 4) >= 15
    """
)
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


@query()
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


@query()
def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
    k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
    h AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM k WHERE n > 1) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
          CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter FROM w LEFT JOIN h USING (r)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR 2 * n_letter < n_words) AS kept FROM f
    """
)
def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which rule is met first depends on measured times, so the query leaves it out.
    return quality_cascade.cascade(table(spark, sf_dir, "documents")).drop("failed_rule", "rules_run")


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


# Either case of ASCII letters only, which (?i) does not promise in every engine.
_EITHER = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_PATTERNS = [_EITHER + secret_scan.KINDS[0][1].partition("key)")[2].replace("'", "''")] + [k[1] for k in secret_scan.KINDS[1:]]


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
    f AS ({" UNION ALL ".join(f"SELECT r, {k} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {2 if k == 0 else 0}) AS secrets FROM d WHERE regexp_matches(t, '{p}')" for k, p in enumerate(_PATTERNS))}),
    e AS (SELECT r, kind, i, gaps[i] AS g, found[i] AS m, secrets[i] AS s FROM f, unnest(range(1, len(found) + 1)) AS u(i)),
    p AS (SELECT r, kind, s, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e, length(m) AS n FROM e),
    c AS (SELECT r, kind, e - n AS b, e, sha256(s) AS secret FROM p
          WHERE (kind < 3 OR (regexp_matches(s, '[0-9].*[0-9]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]')))
          AND length(s) >= CASE kind WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END),
    o AS (SELECT secret, count(DISTINCT source) <= 1 AND count(DISTINCT doc_id) <= 3 AS live FROM c JOIN d USING (r) GROUP BY secret),
    k AS (SELECT c.*, live FROM c JOIN o USING (secret)
          WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM c AS x WHERE x.r = c.r AND x.kind < 3 AND x.b < c.e AND c.b < x.e))),
    a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < 3) AS base,
          string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans,
          count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM k GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (r)
    """
)
def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents")).drop("row_key")
    return found.withColumn("base_spans", F.sha2("base_spans", 256)).withColumnRenamed("base_spans", "base_sha256")


@query(
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS u FROM documents),
    l AS (SELECT doc_id, i - 1 AS no, u[i] AS t, CAST(sum(length(u[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS z FROM d, unnest(range(1, len(u) + 1)) AS x(i)),
    w AS (SELECT doc_id, no, z - length(t) AS a, z, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM l),
    k AS (SELECT *, array_to_string(w, ' ') AS s FROM w WHERE len(w) >= 3),
    f AS (SELECT s, any_value(w) AS w, min({{'doc': doc_id, 'no': no}}) AS first FROM k GROUP BY s),
    v AS (SELECT s, first, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) AS h FROM f, unnest(range(1, len(w) + 1)) AS x(i) WHERE len(w) >= 8),
    o AS (SELECT s, first, md5(s) AS h FROM f WHERE len(w) >= 8),
    p AS (SELECT h, i, min(first) AS m FROM v GROUP BY h, i),
    r AS (SELECT s, m AS near FROM v JOIN p USING (h, i) WHERE m < first
          UNION ALL SELECT v.s, o.first FROM v JOIN o USING (h) WHERE o.first < v.first
          UNION ALL SELECT o.s, v.first FROM v JOIN o USING (h) WHERE v.first < o.first),
    n AS (SELECT s, min(near) AS near FROM r GROUP BY s),
    e AS (SELECT s, coalesce(near, first) AS keeper, CASE WHEN near IS NULL THEN 0 ELSE 1 END AS edits FROM f LEFT JOIN n USING (s))
    SELECT doc_id, no AS line_no, a AS start, z AS "end", len(w) AS n_words, keeper.doc AS first_doc_id, keeper.no AS first_line_no, edits
    FROM k JOIN e USING (s) WHERE {{'doc': doc_id, 'no': no}} > keeper
    """
)
def op7_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicates(table(spark, sf_dir, "documents"))


@query()
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


_ITEM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontamination.ITEM_WORD}')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
    s AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
    g AS (SELECT DISTINCT item, m, list_slice(w, i, i + m - 1) AS gram FROM s),
    x AS (SELECT r, i, z.m, list_slice(w, i, i + z.m - 1) AS gram FROM d, (SELECT DISTINCT m FROM g) AS z, unnest(range(1, len(w) - z.m + 2)) AS u(i)),
    h AS (SELECT r, i, x.m, item FROM x JOIN g ON x.m = g.m AND x.gram = g.gram),
    n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
    t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
    """
)
def op8_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.sha2(F.array_join("items", ","), 256)).withColumnRenamed("items", "items_sha256")


_MARK = r"^([ \t]*>)+"


def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[ \\t\\r\\n>]+', ' ', 'g'))"


@query(
    f"""
    WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS u FROM conversations),
    l AS (SELECT r, conv_id, turn, i, u[i] AS line, coalesce(u[i + 1], '') AS below FROM m, unnest(range(1, len(u) + 1)) AS x(i)),
    p AS (SELECT r, conv_id, turn, i, line, CASE WHEN regexp_matches(line, 'wrote:[ \t]*$') AND regexp_matches(below, '{_MARK}') THEN -1
          ELSE length(regexp_replace(regexp_extract(line, '{_MARK}'), '[^>]', '', 'g')) END AS level, {_plain(f"regexp_replace(line, '{_MARK}[ \t]?', '')")} AS unit FROM l),
    s AS (SELECT r, count(*) FILTER (level > 0) AS n_quoted, coalesce(max(level) FILTER (level > 0), 0) AS max_level,
          coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '^\\s+|\\s+$', '', 'g'), '') AS own FROM p GROUP BY r),
    o AS (SELECT r, conv_id, turn, role, CASE WHEN n_quoted > 0 THEN own ELSE text END AS own, n_quoted, CAST(max_level AS BIGINT) AS max_level FROM m JOIN s USING (r)),
    e AS (SELECT conv_id, turn, unnest(list_append(string_split(own, chr(10)), own)) AS t FROM o WHERE own IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
    g AS (SELECT conv_id, {_plain("t")} AS unit, min(turn) AS f FROM e GROUP BY 1, 2 HAVING unit <> ''),
    q AS (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM p WHERE level > 0),
    b AS (SELECT conv_id, turn, level, {_plain("string_agg(unit, ' ' ORDER BY i)")} AS unit FROM q GROUP BY r, conv_id, turn, level, run),
    a AS (SELECT conv_id, turn, level, unit FROM b WHERE unit <> '' UNION SELECT conv_id, turn, level, unit FROM q WHERE unit <> ''),
    c AS (SELECT a.conv_id, a.turn, level, f, sum(length(a.unit)) AS n FROM a JOIN g ON a.conv_id = g.conv_id AND a.unit = g.unit AND f < a.turn GROUP BY ALL),
    h AS (SELECT conv_id, turn, arg_min(f, {{'l': level, 'n': -n, 'f': f}}) AS parent_turn FROM c GROUP BY 1, 2),
    w AS (SELECT unit, min({{'c': conv_id, 't': f}}) AS src FROM g GROUP BY 1),
    y AS (SELECT a.conv_id, a.turn, min({{'l': level, 'n': -length(a.unit), 's': src}}) AS k FROM a ANTI JOIN h USING (conv_id, turn) JOIN w USING (unit) WHERE src.c <> a.conv_id GROUP BY 1, 2),
    t AS (SELECT conv_id, turn, parent_turn AS root, 1 AS depth FROM h
          UNION ALL SELECT t.conv_id, t.turn, h.parent_turn, depth + 1 FROM t JOIN h ON h.conv_id = t.conv_id AND h.turn = t.root),
    z AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM t GROUP BY 1, 2)
    SELECT conv_id, turn, role, own AS text, n_quoted, max_level, parent_turn, CASE WHEN parent_turn IS NULL THEN k.s.c ELSE conv_id END AS source_conv_id,
    coalesce(parent_turn, k.s.t) AS source_turn, coalesce(root, turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth
    FROM o LEFT JOIN h USING (conv_id, turn) LEFT JOIN y USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn)
    """
)
def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.format_chat(table(spark, sf_dir, "conversations"))


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    k AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
          CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || x || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
    """
)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"),
        hashed(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query(
    """
    WITH u AS (SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS label,
          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT * FROM u WHERE vec_id % 100 = 0),
    s AS (SELECT a.r, a.vec_id AS anchor_id, u.vec_id, a.label = u.label AS same, CAST(list_inner_product(a.v, u.v) AS BIGINT) AS score FROM a JOIN u ON a.r <> u.r),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
          row_number() OVER (PARTITION BY p.r, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """
)
def op12_coordinate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), scale=256.0)


@query()
def op13_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_fingerprints.neighbours(table(spark, sf_dir, "documents"))
