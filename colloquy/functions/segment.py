"""Words of scripts without spaces: the cheapest path over a lattice of dictionary words.

A dictionary is a parameter of bounded size that travels with the function; its words stand in a trie.  Runs of such
script are cut apart on Arrow batches, all other tokens are left as the regular expression found them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import CJK, EMOJI_SIGN, extract_all, join_cjk_spaces

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: As ``TOKEN``, but a run of CJK characters is one token.
RUN = rf"[{CJK}]+|[\p{{L}}\p{{N}}'&&[^{CJK}]]+|{EMOJI_SIGN}+"


def trie_of(words: dict[str, float]) -> dict:
    """Nested dictionaries by character; ``""`` holds the cost of the word that ends there, -log of its share."""
    total = sum(words.values())
    root: dict = {}
    for word, weight in words.items():
        if not word or weight <= 0:
            raise ValueError("words have to be non-empty and weights positive")
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = -math.log(weight / total)
    return root


def best_path(run: str, trie: dict, unknown: float) -> list[str]:
    """The cheapest cut of a run; a character that no word covers costs ``unknown``.  Of equal paths the longer first word wins."""
    n = len(run)
    cost, step = [0.0] * (n + 1), [1] * n
    for i in reversed(range(n)):
        best, size = unknown + cost[i + 1], 1
        node, j = trie.get(run[i]), i + 1
        while node is not None:
            if "" in node and node[""] + cost[j] <= best:
                best, size = node[""] + cost[j], j - i
            node, j = node.get(run[j]) if j < n else None, j + 1
        cost[i], step[i] = best, size
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def segmenter(words: dict[str, float], unknown: float | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its tokens, for ``ngram_rows(segment=...)`` and the like.

    ``words`` are weights (counts or shares).  An unknown character costs as much as half of the rarest word by default.
    Null text has no tokens (null).
    """
    trie = trie_of(words)
    price = unknown if unknown is not None else -math.log(min(words.values()) / sum(words.values()) / 2)

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def parts(run: str) -> list[str]:
            if not "一" <= run[0] <= "龥":
                return [run]
            if run not in known:
                known[run] = best_path(run, trie, price)
            return known[run]

        return runs.map(lambda tokens: None if tokens is None else [p for run in tokens for p in parts(run)])

    return lambda c: cut(extract_all(F.lower(join_cjk_spaces(c)), RUN))
