"""Quality rules as a short-circuit cascade ordered by rejections per cost.

A bounded sample tells for every rule how many documents it rejects and how long it takes; the rules run in
descending order of rejections per second, and a document leaves at its first failure, so that dear rules
see few documents.  The verdict does not depend on the order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, ship, text_of

SAMPLE_ROWS = 500

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")


class Features:
    """What the rules ask of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if _WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, upto = 0, 0  # words [0, upto) are settled
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered

    @cached_property
    def n_letter_words(self) -> int:
        return sum(any(map(str.isalpha, w)) for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The first two are the base; the others reject what is hardly text at all.
RULES = [
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("symbols", lambda f: 5 * f.n_symbols > f.word_chars),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("letterless_words", lambda f: 2 * f.n_letter_words < f.n_words),
]
BASE = ("few_words", "repeated_windows")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[int, float]]:
    """Rejections and seconds of every rule over ``sample_rows`` documents, those with the least hashes."""
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), text_of().alias("text"))
    chosen = F.broadcast(hashed.select("h").orderBy("h").limit(sample_rows).distinct())
    sample = hashed.join(chosen, "h").select("text").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rejected, seconds = [], []
            for rule in rules:
                start = time.perf_counter()
                rejected.append(sum(rule.rejects(Features(t)) for t in texts))
                seconds.append(time.perf_counter() - start)
            columns = [pa.array([r.name for r in rules]), pa.array(rejected, pa.int64()), pa.array(seconds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["rule", "rejected", "seconds"])

    sums = sample.mapInArrow(run, "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s"))
    return {row.rule: (row.r, row.s) for row in sums.collect()}  # one row per rule


def order(rules: list[Rule], found: dict[str, tuple[int, float]]) -> list[Rule]:
    """By rejections per second, highest first; rules that reject nothing last, the cheapest of them first."""

    def rank(rule: Rule) -> tuple:
        rejected, seconds = found.get(rule.name, (0, 0.0))
        return -rejected / max(seconds, 1e-9), seconds, rule.name

    return sorted(rules, key=rank)


def cascade(docs: DataFrame, rules: list[Rule] = RULES, base: tuple = BASE, metrics: tuple = METRICS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the metrics, base_failed, kept, failed_rule (first in the order run), rules_run.

    Metrics are whole numbers that are reported for every document, kept or not.  Null text has no words, so the
    base rejects it; a null doc_id stays null; repeated rows have one result each; other columns are ignored.
    """
    ordered = order(rules, estimate(docs, rules, sample_rows))
    basic = [r for r in rules if r.name in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {m: [] for m in (*metrics, "base_failed", "kept", "failed_rule", "rules_run")}
            for text in batch.column(1):
                f = Features(text.as_py())
                failed, ran = None, 0
                for rule in ordered:
                    ran += 1
                    if rule.rejects(f):
                        failed = rule.name
                        break
                for m in metrics:
                    out[m].append(getattr(f, m))
                out["base_failed"].append(any(r.rejects(f) for r in basic))
                out["kept"].append(failed is None)
                out["failed_rule"].append(failed)
                out["rules_run"].append(ran)
            kinds = [pa.int64()] * len(metrics) + [pa.bool_(), pa.bool_(), pa.string(), pa.int32()]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, " + "".join(f"{m} long, " for m in metrics) + "base_failed boolean, kept boolean, failed_rule string, rules_run int"
    return rows.mapInArrow(run, schema)


ship(__name__)
