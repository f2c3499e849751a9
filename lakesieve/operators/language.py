"""Languages of texts by profiles of letter triples, learnt from a bounded sample; built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .samples import stratified

#: Documents of each language that profiles are learnt from, at most, and triples of each that are kept.
DOCUMENTS, TRIPLES = 400, 1000
#: Languages at most: with TRIPLES the bound of what is broadcast.
LANGUAGES = 500


def triples(text: Column) -> Column:
    """All runs of three characters of each word in lower case, with a blank before and behind it; cut word by word, so that a long text costs no more a character than a short one."""
    padded = F.transform(words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))))


@dataclass
class Profiles:
    """``languages`` in order; ``table``: triple, scores (log share in each); ``unseen``: the log share of a triple that a profile lacks."""

    languages: list[str]
    table: DataFrame
    unseen: list[float]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCUMENTS, most: int = TRIPLES) -> Profiles:
    """Profiles from ``per_language`` whole documents of each language (the same whatever the partitions): shares of its ``most`` most frequent triples, plus one.

    Rows without a language or a text teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    grams = stratified(known, ["lang"], per_language, ["k"]).select("lang", F.explode(triples(F.col("text"))).alias("triple"))
    counts = grams.groupBy("lang", "triple").agg(F.count("*").alias("n"))
    first = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "triple"))), 1, most).alias("top"))  # triples of the bounded sample
    rows = first.select("lang", "total", F.explode("top").alias("t")).select("lang", "total", F.col("t.triple").alias("triple"), (-F.col("t.col1")).alias("n")).limit(LANGUAGES * most + 1).collect()
    languages = sorted({r["lang"] for r in rows})
    if len(languages) > LANGUAGES or len(rows) > LANGUAGES * most:
        raise ValueError(f"over {LANGUAGES} languages")
    total = {r["lang"]: r["total"] + most for r in rows}
    unseen = [-math.log(total[x]) for x in languages]
    scores: dict[str, list[float]] = {}
    for r in rows:
        scores.setdefault(r["triple"], list(unseen))[languages.index(r["lang"])] = math.log(r["n"] + 1) - math.log(total[r["lang"]])
    return Profiles(languages, docs.sparkSession.createDataFrame(sorted(scores.items()), "triple string, scores array<double>"), unseen)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id), language and margin of each row: the language under which the whole text's triples are likeliest, and by how much a triple it is likelier than the next.

    A text without words has nulls; ties go to the first name; without profiles all is null.  The texts stay where they
    are: each task adds up its triples' scores, and a row a document is shuffled.
    """
    keep = keep or ["doc_id"]
    n = len(profiles.languages)
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    rows = rows.select(*keep, "_row", F.explode_outer(triples(F.col("_text"))).alias("triple"))
    scored = rows.join(F.broadcast(profiles.table), "triple", "left")  # LANGUAGES * TRIPLES rows at most
    share = lambda k: F.sum(F.when(F.col("triple").isNotNull(), F.coalesce(F.get("scores", F.lit(k)), F.lit(profiles.unseen[k]))))
    sums = scored.groupBy(*keep, "_row").agg(F.count("triple").alias("_n"), *[share(k).alias(f"_s{k}") for k in range(n)])
    order = F.sort_array(F.array(*[F.struct((-F.col(f"_s{k}")).alias("score"), F.lit(k).alias("k")) for k in range(n)])) if n else F.array()
    if not n:
        return sums.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("margin"))
    names = F.array(*map(F.lit, profiles.languages))
    out = sums.withColumn("_best", F.when(F.col("_n") > 0, order))
    margin = (F.get("_best", F.lit(1))["score"] - F.get("_best", F.lit(0))["score"]) / F.col("_n")
    return out.select(*keep, F.get(names, F.get("_best", F.lit(0))["k"]).alias("language"), margin.alias("margin"))
