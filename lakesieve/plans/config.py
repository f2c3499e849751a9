"""Configurations of the four runs, and their manifests."""

from __future__ import annotations

import dataclasses
import datetime
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources import files, readers


def run_id(name: str, seconds: bool = False, now: datetime.datetime | None = None) -> str:
    """``name``'s last path part with the time: what a run's folder is called."""
    now = now or datetime.datetime.now()
    return f"{name.rstrip('/').split('/')[-1]}-{now.strftime('%Y%m%d-%H%M%S' if seconds else '%Y%m%d-%H%M')}"


class Manifest:
    """A run's folder holds its configuration as config.json, so it can be resumed by its id; in any file system that Spark writes."""

    def save(self, spark: SparkSession, folder: str) -> str:
        return files.write_json(spark, f"{folder}/config.json", dataclasses.asdict(self))

    @classmethod
    def load(cls, spark: SparkSession, folder: str):
        found = readers.config(spark, f"{folder}/config.json")
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in found.items() if k in known})


@dataclass
class FilterConfig(Manifest):
    dataset: str
    output: str
    blocklist: str | None = None
    bert_threshold: float = 0.5
    context_length: int = 8192
    block_words_threshold: float | None = 0.4
    block_words_occuring_threshold: int = 2
    word_stage: str = "use"
    bert_stage: str = "use"
    lm_stage: str = "skip"
    num_samples: int | None = None
    splits: list[str] = field(default_factory=lambda: ["train"])
    save_every: float | None = None
    order_by: str = "id"
    #: A judge's prompt (text, or JSON with messages), and how much it may write.
    lm_filter_prompt_path: str | None = None
    lm_max_new_tokens: int = 5
    #: Also write what the judge said, and publish the verdicts to a path.
    log_judgments: bool = False
    publish_path: str | None = None


@dataclass
class AssembleConfig(Manifest):
    base_dataset_path: str
    filter_results_path: str
    output_dir: str
    output_filename: str = "retained_dataset.jsonl"
    decision_filter: str = "combined_filter"
    bert_threshold: float | None = None
    compat: bool = False
    num_samples: int | None = None
    replace_with_retained_docs: bool = False
    insert_dataset_path: str | None = None
    insert_order_by: str = "text"
    seed: int = 42
    save_filtered_documents: bool = False
    disable_retained_dataset: bool = False
    keep_unjudged: bool = False


@dataclass
class TokenBudgetConfig(Manifest):
    dataset: str
    output_dir: str
    num_tokens: int = 500_000_000_000
    order_by: str = "id"


@dataclass
class SpectrumConfig(Manifest):
    dataset: str
    output_dir: str
    layer: str = "layer"
    vector: str = "x"
    batch: str | None = None
