"""Token counts, budgets, chunks and fixed-length packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article, slices, words
from .rows import places, running_sum


def token_counts(docs: DataFrame, tokens: Callable[[Column], Column] = words, id_col: str = "id") -> DataFrame:
    """id, num_tokens by a tokenizer that is an expression."""
    return docs.select(id_col, F.size(tokens(F.col("text"))).alias("num_tokens"))


def token_counts_by(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list]]], id_col: str = "id") -> DataFrame:
    """id, num_tokens by a tokenizer outside SQL: ``load()`` runs once a task and returns texts -> token lists; whole Arrow batches go through it."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield pd.Series([len(ids) for ids in encode(batch.fillna("").tolist())])

    return docs.select(id_col, count("text").alias("num_tokens"))


def budget_cut(counts: DataFrame, target: int, order_by: list[str]) -> DataFrame:
    """One row: reached, final_index (0-based place of the row that reaches ``target``, else the last), num_docs, target and actual token count."""
    # a row of ``places`` stands for _c equal ones, of which the k-th brings the sum to _before + k * _v
    found = places(counts, order_by, F.col("num_tokens"))
    reaches = (F.col("_before") < target) & (F.col("_before") + F.col("_c") * F.col("_v") >= target)
    k = F.expr(f"(CAST({target} AS BIGINT) - _before + _v - 1) div nullif(_v, 0)")
    if target > 0:
        place = F.when(reaches, F.struct((F.col("_first") + k - 1).alias("index"), (F.col("_before") + k * F.col("_v")).alias("total")))
    else:
        place = F.when(F.col("_first") == 0, F.struct(F.col("_first").alias("index"), F.col("_v").alias("total")))
    placed = found.groupBy().agg(F.min(place).alias("hit"), F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_v")).alias("all")).select("hit.*", "n", "all")
    reached = F.col("index").isNotNull()
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    index = F.coalesce("index", F.greatest(n - 1, F.lit(0))).cast("bigint")
    return placed.select(
        reached.alias("reached_target_token_count"), index.alias("final_index"), F.least(index + 1, n).alias("num_docs"),
        F.lit(target).cast("bigint").alias("target_token_count"), F.coalesce("total", "all", F.lit(0)).cast("bigint").alias("actual_token_count"),
    )


def within_budget(docs: DataFrame, counts: DataFrame, target: int, order_by: list[str], id_col: str = "id") -> DataFrame:
    """Documents up to and with the one that reaches the budget."""
    total = running_sum(counts, F.col("num_tokens").cast("bigint"), order_by, "running")
    return docs.join(total.where(F.col("running") - F.col("num_tokens") < target).select(id_col), id_col, "left_semi")


def chunks(docs: DataFrame, size: int, tokens: Callable[[Column], Column] = words, id_col: str = "id") -> DataFrame:
    """id, chunk, tokens, text: consecutive slices of ``size`` tokens, decoded with spaces."""
    out = docs.select(id_col, tokens(F.col("text")).alias("_t")).select(id_col, F.posexplode(slices(F.col("_t"), size)).alias("chunk", "tokens"))
    return out.withColumn("text", F.array_join("tokens", " "))


def cut(docs: DataFrame, length: int, order_by: list[str], end: str = "<eos>", tokens: Callable[[Column], Column] = words, head: list[str] | None = None) -> DataFrame:
    """seq_id, input_ids: ``head`` (fewer than ``length`` tokens that are left from before), then each document as one leading ``end`` and its tokens, concatenated in order and cut every ``length``; the last may be shorter.

    Rows whose order keys are null come first, and rows that tie go by a hash of what they hold; each is packed once.
    Only keys and token counts take part in the running sum, and meet their texts again.  A document's tokens are cut
    where sequences begin, so a row is a part of a document in a sequence, never a single token, and a sequence's
    parts meet by its id: at most ``length``.
    """
    head = head or []
    docs = docs.select(*order_by, "text")
    body = F.concat(F.array(F.lit(end)), tokens(F.col("text")))
    ends = running_sum(docs, F.size(body), order_by, "_end").withColumn("_end", F.col("_end") + len(head))
    placed = ends.select(body.alias("_t"), "_end").withColumn("_start", F.col("_end") - F.size("_t"))
    first, last = F.floor(F.col("_start") / length), F.floor((F.col("_end") - 1) / length)
    parts = placed.withColumn("seq_id", F.explode(F.sequence(first, last)))
    begin, stop = F.greatest(F.col("seq_id") * length, F.col("_start")), F.least((F.col("seq_id") + 1) * length, F.col("_end"))
    parts = parts.select("seq_id", begin.alias("_at"), F.slice("_t", (begin - F.col("_start") + 1).cast("int"), (stop - begin).cast("int")).alias("_part"))
    if head:
        parts = parts.unionByName(docs.sparkSession.createDataFrame([(0, 0, head)], "seq_id long, _at long, _part array<string>"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_part")))
    return parts.groupBy("seq_id").agg(F.flatten(F.transform(ordered, lambda p: p["_part"])).alias("input_ids"))


def pack(docs: DataFrame, length: int, order_by: list[str], end: str = "<eos>", tokens: Callable[[Column], Column] = words) -> DataFrame:
    """seq_id, input_ids, labels: ``cut`` without the incomplete tail; the labels are a copy of the ids."""
    return cut(docs, length, order_by, end, tokens).where(F.size("input_ids") == length).withColumn("labels", F.col("input_ids"))


def epochs(packed: DataFrame, n: int) -> DataFrame:
    """The sequences ``n`` times, with the epoch's number."""
    return packed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def max_length_articles(docs: DataFrame, length: int, tokens: Callable[[Column], Column] = words, pad: str = "<pad>", title: str = "title", abstract: str = "abstract", text: str = "text") -> DataFrame:
    """``docs`` with input_ids, attention_mask and labels of title, abstract and text as one article: padded on the right to ``length`` tokens, longer ones whole.

    The labels are a copy of the ids, padding included; an article with a null part has null columns.
    """
    body = F.when(article(F.col(title), F.col(abstract), F.col(text)).isNotNull(), tokens(article(F.col(title), F.col(abstract), F.col(text))))
    gap = F.greatest(F.lit(length) - F.size("_t"), F.lit(0))
    out = docs.withColumn("_t", body).withColumn("input_ids", F.concat("_t", F.array_repeat(F.lit(pad), gap)))
    return out.withColumn("attention_mask", F.concat(F.transform("_t", lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))).withColumn("labels", F.col("input_ids")).drop("_t")


def batches(packed: DataFrame, size: int) -> DataFrame:
    return packed.withColumn("batch", F.floor(F.col("seq_id") / size))


def chunk_pad(docs: DataFrame, size: int = 2048, most: int = 5, pad: int = 0, ids_col: str = "input_ids") -> DataFrame:
    """One row for each of the first ``most`` chunks: chunk, input_ids, attention_mask, labels, token_type_ids, each of length ``size``.

    Padding goes to the right: ``pad`` in the ids, 0 in the mask, -100 in the labels; token types are 0.
    """
    parts = docs.withColumn("_first", F.slice(F.col(ids_col), 1, size * most)).withColumn("_p", slices(F.col("_first"), size)).select(*[c for c in docs.columns if c != ids_col], F.posexplode("_p").alias("chunk", "_c"))
    gap = F.lit(size) - F.size("_c")
    fill = lambda body, value: F.concat(body, F.array_repeat(F.lit(value), gap))
    return parts.select(
        *[c for c in docs.columns if c != ids_col], "chunk", fill(F.col("_c"), pad).alias("input_ids"),
        fill(F.array_repeat(F.lit(1), F.size("_c")), 0).alias("attention_mask"), fill(F.col("_c"), -100).alias("labels"), F.array_repeat(F.lit(0), size).alias("token_type_ids"),
    )
