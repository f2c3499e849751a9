"""The keyword blocklist: refining the list, and judging texts by it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

#: Keywords that built-in functions look for before a text leaves the JVM.
FIRST = 32


def refine(blocklist: DataFrame, pos_ratio: float | None = 0.4) -> DataFrame:
    """Distinct keywords with pos_ratio above the threshold (null and NaN never are; no threshold: all) that, if the list says so, are relevant."""
    kept = blocklist
    if pos_ratio is not None:
        kept = kept.where(F.nanvl("pos_ratio", F.lit(None).cast("double")) > pos_ratio)
    if "is_relevant" in blocklist.columns:
        kept = kept.where(F.coalesce("is_relevant", F.lit(False)))
    return kept.select("keyword").where(F.col("keyword").isNotNull()).distinct()


def refine_counts(blocklist: DataFrame, pos_ratio: float | None = 0.4) -> DataFrame:
    """n_before (rows), n_after (rows that pass) and n_keywords (distinct)."""
    passed = F.lit(True) if pos_ratio is None else F.coalesce(F.nanvl("pos_ratio", F.lit(None).cast("double")) > pos_ratio, F.lit(False))
    if "is_relevant" in blocklist.columns:
        passed = passed & F.coalesce("is_relevant", F.lit(False))
    return blocklist.agg(F.count("*").alias("n_before"), F.count_if(passed).alias("n_after"), F.count_distinct(F.when(passed, F.col("keyword"))).alias("n_keywords"))


def keyword_list(refined: DataFrame) -> list[str]:
    """The keywords in order, so that reports don't depend on a set's order.  A blocklist fits the driver."""
    return sorted(r["keyword"] for r in refined.collect())


def hits(text: Column, keywords: list[str], most: int) -> Column:
    """The first ``most`` keywords, in order, that occur in ``text`` whatever the case; null texts have none.

    Every distinct raw keyword counts, also inside words and inside other keywords.  All keywords are looked for at
    once: one automaton, made once a task, reads each text once, however long the list is.  (Built-in functions would
    read it once for each keyword.)  The text is lower-cased before it leaves the JVM, and only it travels; of a list of
    at most FIRST keywords, only texts that hold one do, which built-in functions find out.
    """
    if not keywords:
        return F.array().cast("array<string>")
    most = max(most, 1)

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ahocorasick import Automaton

        by_word: dict[str, list[int]] = {}
        for k, word in enumerate(keywords):
            by_word.setdefault(word.lower(), []).append(k)
        everywhere = by_word.pop("", [])  # the empty word is in every text
        automaton = Automaton()
        for word, places in by_word.items():
            automaton.add_word(word, places)
        automaton.make_automaton()

        def one(low: str | None) -> list[str]:
            if low is None:
                return []
            seen = {id(places): places for _, places in automaton.iter(low)} if by_word else {}
            return [keywords[k] for k in sorted([*everywhere, *(k for places in seen.values() for k in places)])[:most]]

        for batch in batches:
            yield batch.map(one)

    if len(keywords) > FIRST:
        return scan(F.lower(text))
    low = F.lower(text)
    return scan(F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in sorted({w.lower() for w in keywords})]), low))


def verdict(text: Column, keywords: list[str], threshold: int = 2) -> Column:
    """struct(should_filter, metadata struct(keywords)): true iff ``threshold`` keywords (1 or more) occur."""
    return once(hits(text, keywords, max(threshold, 1)), lambda h: F.struct(
        ((F.size(h) >= threshold) & F.lit(threshold >= 1)).alias("should_filter"), F.struct(F.array_join(h, ", ").alias("keywords")).alias("metadata")))
