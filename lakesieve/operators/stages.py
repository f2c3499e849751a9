"""Cascade stages: each turns documents into a verdict and metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as text_functions
from . import blocklist


class Stage(Protocol):
    """The extension point: anything with a name, a metadata default and a ``judge`` can stand in a cascade.

    Optional: ``gated = True`` if ``judge`` takes the gate as a second argument, and ``costly = False`` if judging a
    row twice does no harm.
    """

    name: str

    def default_metadata(self) -> Column:
        """What documents get that never reach the stage."""

    def judge(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``_should`` (boolean) and ``_metadata`` added; rows stay as they are."""


def within(judged: DataFrame, gate: Column | None, default: Column) -> DataFrame:
    """Where the gate is shut, the verdict is false and the metadata the default."""
    if gate is None:
        return judged
    kind = judged.schema["_metadata"].dataType
    return judged.withColumn("_should", F.when(gate, F.col("_should")).otherwise(False)).withColumn("_metadata", F.when(gate, F.col("_metadata")).otherwise(default.cast(kind)))


def opened(value: Column, gate: Column | None) -> Column:
    """``value`` where the gate is open, else null; without a gate ``value``."""
    return value if gate is None else F.when(gate, value)


@dataclass
class BlocklistStage:
    keywords: list[str]
    threshold: int = 2
    name: str = "word_filter"

    gated, costly = True, False

    def default_metadata(self) -> Column:
        return F.struct(F.lit("").alias("keywords"))

    def judge(self, docs: DataFrame, gate: Column | None = None) -> DataFrame:
        judged = docs.withColumn("_v", blocklist.verdict(opened(F.col("text"), gate), sorted(set(self.keywords)), self.threshold))
        judged = judged.withColumn("_should", F.col("_v.should_filter")).withColumn("_metadata", F.col("_v.metadata")).drop("_v")
        return within(judged, gate, self.default_metadata())


def density_scorer(terms: list[str]) -> Callable[[Column], Column]:
    """A stand-in classifier in SQL's reach: the share of a slice's words that are in ``terms``."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return lambda tokens: F.size(F.filter(tokens, lambda w: F.array_contains(wanted, F.lower(w)))) / F.size(tokens)


@dataclass
class ClassifierStage:
    """Scores every slice of ``context_length`` tokens; true iff any score is above the threshold.

    ``scorer``: array<string> of a slice's tokens -> double.  Texts without tokens and texts whose scoring yields a
    null fail closed: true with zero metadata and an error that says so.  A NaN score is above nothing.
    """

    scorer: Callable[[Column], Column]
    threshold: float = 0.5
    context_length: int = 8192
    tokens: Callable[[Column], Column] = text_functions.words
    name: str = "bert_filter"

    gated, costly = True, False

    def default_metadata(self) -> Column:
        return F.struct(F.lit(0.0).alias("highest_score"), F.lit(0.0).alias("lowest_score"), F.lit(0.0).alias("mean_score"), F.lit(None).cast("string").alias("error"))

    def judge(self, docs: DataFrame, gate: Column | None = None) -> DataFrame:
        judged = docs.withColumn("_tokens", opened(self.tokens(F.col("text")), gate))
        judged = judged.withColumn("_parts", F.when(F.col("_tokens").isNotNull(), text_functions.slices(F.col("_tokens"), self.context_length)))
        judged = judged.withColumn("_scores", F.transform("_parts", lambda p: self.scorer(p).cast("double"))).drop("_parts", "_tokens")
        return within(judged_by_scores(judged, self.threshold, self.default_metadata()), gate, self.default_metadata())


def judged_by_scores(docs: DataFrame, threshold: float, default: Column, error: Column | None = None) -> DataFrame:
    """Verdict and metadata from ``_scores`` (array<double>; null, empty or with a null: failed); ``error``: what a failure is told as, if that is known."""
    failed = F.col("_scores").isNull() | (F.size("_scores") == 0) | F.exists("_scores", lambda s: s.isNull())
    metadata = F.struct(
        F.array_max("_scores").alias("highest_score"), F.array_min("_scores").alias("lowest_score"),
        (F.aggregate("_scores", F.lit(0.0), lambda a, s: a + s) / F.size("_scores")).alias("mean_score"), F.lit(None).cast("string").alias("error"),
    )
    over = F.exists("_scores", lambda s: ~F.isnan(s) & (s > threshold))
    why = F.when(F.size("_scores") == 0, "no tokens").otherwise("no score")
    told = default.withField("error", why if error is None else F.coalesce(error, why))
    out = docs.withColumn("_should", F.when(failed, True).otherwise(over))
    return out.withColumn("_metadata", F.when(failed, told).otherwise(metadata)).drop("_scores")


@dataclass
class ModelStage:
    """A classifier outside SQL: ``load()`` runs once a task and returns texts -> scores; an exception fails closed, and its kind and words are the verdict's error."""

    load: Callable[[], Callable[[list[str]], list[float]]]
    threshold: float = 0.5
    context_length: int = 8192
    batch_size: int = 64
    tokens: Callable[[Column], Column] = text_functions.words
    name: str = "bert_filter"

    gated, costly = True, True

    default_metadata = ClassifierStage.default_metadata

    def judge(self, docs: DataFrame, gate: Column | None = None) -> DataFrame:
        load, size = self.load, self.batch_size

        @F.pandas_udf("scores array<double>, error string")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = None

            def one(parts) -> tuple[list[float] | None, str | None]:
                nonlocal model
                if parts is None:
                    return None, None
                try:
                    model = model or load()
                    parts = list(parts)
                    return [float(s) for k in range(0, len(parts), size) for s in model(parts[k : k + size])], None
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}"

            for batch in batches:
                yield pd.DataFrame([one(parts) for parts in batch], columns=["scores", "error"])

        score = score.asNondeterministic()  # a model's call is never moved, repeated or put into another expression
        split = docs.withColumn("_tokens", opened(self.tokens(F.col("text")), gate))
        parts = F.when(F.col("_tokens").isNotNull(), F.transform(text_functions.slices(F.col("_tokens"), self.context_length), lambda p: F.array_join(p, " ")))
        scored = split.withColumn("_s", score(parts)).drop("_tokens").withColumns({"_scores": F.col("_s.scores"), "_e": F.col("_s.error")})
        judged = judged_by_scores(scored, self.threshold, self.default_metadata(), F.col("_e"))
        return within(judged.drop("_s", "_e"), gate, self.default_metadata())


def parse_completion(completion: Column) -> Column:
    """struct(judgment, error) of a judge's answer: the first digit behind the last bracket is 1; no digit fails closed."""
    digit = text_functions.first_digit(completion)
    return F.struct(F.coalesce(digit == 1, F.lit(True)).alias("judgment"), F.when(digit.isNull(), F.lit("no digit in the completion")).alias("error"))


def chat_messages(text: Column, prompt: str | list[dict[str, str]]) -> Column:
    """array<struct(role, content)>: the prompt (a string: a system message) and the text up to the sentinel as the user's."""
    before = [{"role": "system", "content": prompt}] if isinstance(prompt, str) else prompt
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*[message(m["role"], F.lit(m["content"])) for m in before], message("user", text_functions.until(text)))


@dataclass
class JudgeStage:
    """A language model as judge.  ``connect()`` runs once a task and returns messages -> completion; no default client, no network.

    ``max_new_tokens`` and ``options`` (such as model, address and temperature) are given to the client as keywords, as far
    as they are set.  An exception fails closed, and its kind and words are the verdict's error.
    """

    connect: Callable[[], Callable[[list[dict[str, str]]], str]]
    prompt: str | list[dict[str, str]] = field(default="Answer [1] if the text is to be removed, else [0].")
    name: str = "lm_filter"
    max_new_tokens: int | None = None
    options: dict = field(default_factory=dict)

    gated, costly = True, True

    def default_metadata(self) -> Column:
        return F.struct(F.lit(False).alias("judgment"), F.lit("").alias("completion"), F.lit(None).cast("string").alias("error"))

    def judge(self, docs: DataFrame, gate: Column | None = None) -> DataFrame:
        connect, options = self.connect, self.options | ({} if self.max_new_tokens is None else {"max_new_tokens": self.max_new_tokens})

        @F.pandas_udf("completion string, error string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            client = None
            for batch in batches:
                rows = []
                for messages in batch:
                    if messages is None:
                        rows.append((None, None))
                        continue
                    try:
                        client = client or connect()
                        rows.append((client([dict(m) for m in messages], **options), None))
                    except Exception as e:
                        rows.append((f"Error during LM filtering: {e}", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["completion", "error"])

        ask = ask.asNondeterministic()  # see above
        asked = docs.withColumn("_a", ask(opened(chat_messages(F.col("text"), self.prompt), gate))).withColumn("_p", parse_completion(F.col("_a.completion")))
        judgment = F.when(F.col("_a.error").isNotNull(), True).otherwise(F.col("_p.judgment"))
        metadata = F.struct(judgment.alias("judgment"), F.col("_a.completion").alias("completion"), F.coalesce("_a.error", "_p.error").alias("error"))
        return within(asked.withColumn("_should", judgment).withColumn("_metadata", metadata).drop("_a", "_p"), gate, self.default_metadata())
