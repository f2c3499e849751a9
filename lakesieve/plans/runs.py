"""The four runs from configuration to files: filter, assemble, count tokens, spectrum."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, blocklist, linalg, report, rows, tokens
from ..operators.cascade import cascade
from ..operators.stages import BlocklistStage, JudgeStage, Stage
from ..sources import files, readers, sinks
from .config import AssembleConfig, FilterConfig, SpectrumConfig, TokenBudgetConfig


def stages_of(spark: SparkSession, config: FilterConfig, classifier: Stage | None = None, judge: Stage | None = None) -> list[Stage]:
    """In their fixed order, without those that the configuration skips."""
    skip = lambda value: value.lower() == "skip"
    out: list[Stage] = []
    if config.blocklist and not skip(config.word_stage):
        words = blocklist.keyword_list(blocklist.refine(readers.blocklist(spark, config.blocklist), config.block_words_threshold))
        out.append(BlocklistStage(words, config.block_words_occuring_threshold))
    if classifier is not None and not skip(config.bert_stage):
        out.append(classifier)
    if judge is not None and not skip(config.lm_stage):
        if isinstance(judge, JudgeStage):
            prompt = readers.prompt(spark, config.lm_filter_prompt_path) if config.lm_filter_prompt_path else judge.prompt
            judge = dataclasses.replace(judge, prompt=prompt, max_new_tokens=config.lm_max_new_tokens)
        out.append(judge)
    return out


def finished_chunks(spark: SparkSession, run: str, split: str) -> set[int]:
    """Chunks that a former attempt wrote whole: its marker is written after the chunk's files are committed."""
    return {int(n[:-5]) for n in files.names(spark, f"{run}/done/{split}") if n.endswith(".done")}


def chunked(spark: SparkSession, config: FilterConfig, docs: DataFrame, split: str) -> tuple[str, list[int]]:
    """Where a split's documents are, numbered and dealt by chunks, and the chunks' numbers: written once, by the first attempt."""
    folder, marker = f"{config.output}/chunks/{split}", f"{config.output}/chunks/{split}.done"
    if not files.exists(spark, marker):
        parts = rows.percent_chunks(rows.ensure_id(docs, config.order_by), "id", config.save_every, split)
        parts.write.mode("overwrite").partitionBy("chunk_idx").parquet(folder)
        files.write_text(spark, marker, "")
    return folder, sorted(int(n.partition("=")[2]) for n in files.names(spark, folder) if n.startswith("chunk_idx="))


def run_filter(spark: SparkSession, config: FilterConfig, classifier: Stage | None = None, judge: Stage | None = None) -> DataFrame:
    """Judge every split, chunk by chunk if ``save_every`` says so, and write verdicts, a sample and a report; returns the verdicts.

    Chunks are parts of a table that is written once, so each is read for itself.  Started again with the same output,
    the run goes on with the chunks that aren't there.  All of it, markers and reports too, is in the output's file
    system.
    """
    config.save(spark, config.output)
    stages = stages_of(spark, config, classifier, judge)
    source = readers.read(spark, config.dataset)
    for split in config.splits:
        docs = source.where(F.col("split") == split) if "split" in source.columns else source.withColumn("split", F.lit(split))
        docs = readers.split_slice(docs, config.order_by, config.num_samples)
        if config.save_every is None:
            docs, todo = rows.ensure_id(docs, config.order_by).withColumn("chunk_idx", F.lit(0).cast("bigint")), [0]
        else:
            folder, todo = chunked(spark, config, docs, split)
            docs = spark.read.parquet(folder)
        done = finished_chunks(spark, config.output, split)
        for k in todo:
            if k not in done:
                judged = cascade(docs.where(F.col("chunk_idx") == k).withColumn("chunk_idx", F.lit(k).cast("bigint")), stages)
                sinks.write_verdicts(judged, config.output)
                files.write_text(spark, f"{config.output}/done/{split}/{k}.done", "")
    verdicts = readers.verdicts(spark, config.output)
    sinks.write_sample(verdicts, f"{config.output}/sample.csv")
    if config.log_judgments and "lm_filter_metadata" in verdicts.columns:
        sinks.judgments(verdicts, f"{config.output}/judgments")
    if config.publish_path:
        sinks.publish(verdicts, config.publish_path)
    sinks.report(spark, report.confusion(verdicts, "combined_filter", "is_filter_target"), f"{config.output}/report.json")
    return verdicts


def run_assemble(spark: SparkSession, config: AssembleConfig) -> dict:
    """Retained (and, if asked, removed) documents as JSON lines, with results.json; an error ends the run."""
    config.save(spark, config.output_dir)
    base = readers.split_slice(readers.read(spark, config.base_dataset_path), "id", config.num_samples)
    verdicts = readers.read(spark, config.filter_results_path)
    if config.bert_threshold is not None:
        verdicts = assemble.rethreshold(verdicts, config.bert_threshold, config.compat)
    assemble.check_coverage(base, verdicts) if config.num_samples is None else None
    kept = assemble.retained(base, verdicts, config.decision_filter, keep_unjudged=config.keep_unjudged)
    sources = {}
    if config.replace_with_retained_docs:
        extra = assemble.approved_escalations(assemble.judged_documents(base, verdicts), verdicts)
        kept = kept.unionByName(extra)
        if "source" in base.columns:
            count = lambda df: {str(r["source"]): r["n"] for r in df.collect()}  # noqa: E731  a row a source
            sources = {"appended_sources": count(assemble.appended_sources(extra)), "counterfactual_sources": count(assemble.counterfactual_sources(kept, extra))}
    inserted = 0
    if config.insert_dataset_path:
        extra = readers.read(spark, config.insert_dataset_path)
        inserted = extra.count()
        kept = assemble.insert(kept, extra, config.insert_dataset_path.rstrip("/").split("/")[-1].split(".")[0], config.insert_order_by, seed=config.seed)
    out = sinks.write_jsonl(kept, f"{config.output_dir}/{config.output_filename}", config.disable_retained_dataset)
    gone = sinks.write_jsonl(assemble.removed(base, verdicts, config.decision_filter), f"{config.output_dir}/filtered_documents", not config.save_filtered_documents)
    stats = assemble.assembly_stats(base, verdicts, kept, config.decision_filter, inserted).first().asDict()
    return sinks.report(spark, stats | sources | {"output_file": out, "filtered_documents_file": gone}, f"{config.output_dir}/results.json")


def run_token_budget(spark: SparkSession, config: TokenBudgetConfig, count=tokens.token_counts) -> dict:
    """num_tokens as Parquet, and where the budget is reached as results.json."""
    config.save(spark, config.output_dir)
    counts = count(readers.read(spark, config.dataset))
    sinks.write_parquet(counts, f"{config.output_dir}/token_counts", "id", "num_tokens")
    written = spark.read.parquet(f"{config.output_dir}/token_counts")  # so that tokens are counted once
    return sinks.report(spark, tokens.budget_cut(written, config.num_tokens, [config.order_by]), f"{config.output_dir}/results.json")


def run_spectrum(spark: SparkSession, config: SpectrumConfig) -> dict:
    """Singular values of every layer as JSON, and at the schedule's batches if a batch column is named; the rows' sums are made in one pass."""
    config.save(spark, config.output_dir)
    df = readers.read(spark, config.dataset)
    row = lambda r: {k: r[k] for k in ("singular_values", "n_samples", "hidden_dim")}
    if not config.batch:
        found = {str(r[config.layer]): row(r) for r in linalg.spectrum(df, config.vector, config.layer).collect()}  # a row a layer
        return sinks.report(spark, found, f"{config.output_dir}/spectrum.json")
    last = df.agg(F.max(config.batch)).first()[0]
    points = linalg.checkpoint_schedule(int(last or 0))
    results: dict[int, dict] = {p: {} for p in points}
    if points:
        for r in linalg.checkpointed_spectrum(df, config.batch, points, config.vector, config.layer).collect():  # a row a layer and checkpoint
            results[r["checkpoint"]][str(r[config.layer])] = row(r)
    for point, found in results.items():
        content = {"batch_idx": point, "samples_processed": max((r["n_samples"] for r in found.values()), default=0), "results": found}
        files.write_json(spark, f"{config.output_dir}/checkpoint_batch_{point}.json", content)
    return sinks.report(spark, results[points[-1]] if points else {}, f"{config.output_dir}/spectrum.json")
