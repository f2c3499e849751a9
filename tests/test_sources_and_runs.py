import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesieve import streaming
from lakesieve.operators import linalg
from lakesieve.operators.stages import BlocklistStage, ClassifierStage, JudgeStage, density_scorer
from lakesieve.plans import config, runs
from lakesieve.sources import files, readers, shared, sinks


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(i, ["apple pie", "fig fig", "none", "apple fig fig"][i % 4], i % 4 == 3) for i in range(40)]
    path = f"{tmp_path}/corpus"
    spark.createDataFrame(rows, "id long, text string, is_filter_target boolean").write.parquet(path)
    (tmp_path / "words.csv").write_text("keyword,pos_ratio,is_relevant\napple,0.9,true\nnone,0.1,true\n")
    return path


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n')
    assert readers.read(spark, f"{tmp_path}/a.jsonl").first()["text"] == "x"
    (tmp_path / "a.txt").write_text("line\n")
    assert readers.read(spark, f"{tmp_path}/a.txt").columns == ["text"]
    (tmp_path / "arrow").mkdir()
    table = pa.table({"id": [1, 2], "tags": [["a"], []]})
    with pa.OSFile(f"{tmp_path}/arrow/1.arrow", "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(f"{tmp_path}/arrow/2.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    got = readers.read(spark, f"{tmp_path}/arrow")
    assert got.columns == ["id", "tags"] and got.count() == 4
    (tmp_path / "p.json").write_text(json.dumps({"messages": [{"role": "system", "content": "c"}]}))
    assert readers.prompt(spark, f"{tmp_path}/p.json")[0]["role"] == "system" and readers.prompt(spark, f"{tmp_path}/a.txt") == "line\n"
    assert readers.split_slice(got, "id", 99).count() == 4
    point = {"batch_idx": 2, "samples_processed": 5, "results": {"l": {"singular_values": [1.0], "n_samples": 5, "hidden_dim": 1}}}
    (tmp_path / "checkpoint_batch_2.json").write_text(json.dumps(point))
    assert readers.checkpoints(spark, f"{tmp_path}/checkpoint_batch_*.json").first()["results"]["l"]["n_samples"] == 5


def test_filter_resume_and_assembly(spark, tmp_path, corpus):
    out = f"{tmp_path}/run"
    c = config.FilterConfig(corpus, out, f"{tmp_path}/words.csv", block_words_occuring_threshold=1, save_every=0.25)
    stage = ClassifierStage(density_scorer(["fig"]), 0.5, 4)
    v = runs.run_filter(spark, c, stage)
    assert v.count() == 40 and v.where("combined_filter").count() == 10 and v.select("chunk_idx").distinct().count() == 4
    assert runs.finished_chunks(spark, out, "train") == {0, 1, 2, 3}
    assert runs.run_filter(spark, config.FilterConfig.load(spark, out), stage).count() == 40
    report = json.loads((tmp_path / "run/report.json").read_text())
    assert (report["tp"], report["fp"], report["fn"]) == (10, 0, 0)
    a = config.AssembleConfig(corpus, f"{out}/verdicts", f"{tmp_path}/assembled", replace_with_retained_docs=True, save_filtered_documents=True)
    found = runs.run_assemble(spark, a)
    assert found["retained_dataset_size"] == 40 and found["filtered_records_size"] == 10
    assert spark.read.json(found["filtered_documents_file"]).count() == 10


def test_a_run_goes_on_where_it_was_broken_off(spark, tmp_path, corpus):
    out = f"file://{tmp_path}/remote"  # a path with a scheme, as any store's
    c = config.FilterConfig(corpus, out, f"{tmp_path}/words.csv", block_words_occuring_threshold=1, save_every=0.25, publish_path=f"{tmp_path}/published", log_judgments=True)
    (tmp_path / "prompt.txt").write_text("Is it ripe?")
    c.lm_filter_prompt_path, c.lm_stage, c.lm_max_new_tokens = f"{tmp_path}/prompt.txt", "use", 7
    asked = spark.sparkContext.accumulator(0)

    def connect():
        def client(messages, max_new_tokens):
            asked.add(1)
            assert messages[0]["content"] == "Is it ripe?" and max_new_tokens == 7
            return "[1]"

        return client

    v = runs.run_filter(spark, c, judge=JudgeStage(connect))
    assert v.count() == 40 and v.where("combined_filter").count() == 20 and asked.value == 20
    assert spark.read.parquet(c.publish_path).count() == 40 and spark.read.json(f"{out}/judgments.jsonl").count() == 20
    files.delete(spark, f"{out}/done/train/2.done")
    runs.run_filter(spark, c, judge=JudgeStage(connect))
    assert asked.value == 25  # one chunk of ten, half of it escalated, is judged again
    assert files.names(spark, f"{out}/chunks/train") and readers.verdicts(spark, out).count() == 40
    a = config.AssembleConfig(corpus, f"{out}/verdicts", f"{out}/assembled", output_filename="kept.jsonl")
    assert runs.run_assemble(spark, a)["output_file"].endswith("/kept.jsonl") and spark.read.json(f"{out}/assembled/kept.jsonl").count() == 20
    assert config.AssembleConfig.load(spark, f"{out}/assembled") == a


def test_shared_folder(spark, monkeypatch):
    df = shared.written(spark.range(3))
    assert df.count() == 3 and shared.discard(spark) >= 1 and shared.discard(spark) == 0

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())


def test_records_to_look_at(spark):
    df = spark.createDataFrame([("x" * 9, [1, 2], 5)] * 3, "t string, a array<int>, n int")
    got = readers.first_records(df, 2, 4).collect()
    assert len(got) == 2 and tuple(got[0]) == ("xxxx...", "[1,2..." if len("[1,2]") > 4 else "[1,2]", 5)


def test_budget_and_spectrum_runs(spark, tmp_path, corpus):
    got = runs.run_token_budget(spark, config.TokenBudgetConfig(corpus, f"{tmp_path}/budget", 10))
    assert got["reached_target_token_count"] and got["final_index"] == 4  # 2, 4, 5, 8, 10
    spark.createDataFrame([("l", [1.0, 0.0], b) for b in (1, 2, 3)], "layer string, x array<double>, batch int").write.parquet(f"{tmp_path}/x")
    s = runs.run_spectrum(spark, config.SpectrumConfig(f"{tmp_path}/x", f"{tmp_path}/s", batch="batch"))
    assert s["l"]["singular_values"][0] == pytest.approx(3**0.5)
    assert [r["batch_idx"] for r in readers.checkpoints(spark, f"{tmp_path}/s/checkpoint_batch_*.json").collect()] == [1, 2, 3]


def test_sample_and_observation(spark, tmp_path, corpus):
    df = spark.read.parquet(corpus).withColumn("m", F.struct("id"))
    sinks.write_sample(df, f"{tmp_path}/sample", most=3)
    assert spark.read.csv(f"{tmp_path}/sample", header=True).count() == 3
    seen_df, seen = sinks.observed(df, "n", rows=F.count("*"))
    sinks.write_parquet(seen_df, f"{tmp_path}/w", "id")
    assert seen.get["rows"] == 40


def test_streams(spark, tmp_path, corpus):
    docs = lambda: readers.stream(spark, corpus, "id long, text string")
    for _ in range(2):  # the second call finds nothing new
        streaming.stream_cascade(docs(), [BlocklistStage(["apple"], 1)], f"{tmp_path}/v", f"{tmp_path}/c1")
    v = spark.read.parquet(f"{tmp_path}/v")
    assert v.count() == 40 and v.where("combined_filter").count() == 20
    streaming.stream_retained(docs(), v.where("combined_filter").select("id"), f"{tmp_path}/kept", f"{tmp_path}/c2")
    assert spark.read.json(f"{tmp_path}/kept").count() == 20
    x = spark.createDataFrame([("l", [1.0, 2.0]), ("l", [3.0, 4.0]), ("m", [1.0, 1.0])], "layer string, x array<double>")
    x.repartition(3).write.parquet(f"{tmp_path}/x")
    streaming.stream_gram(readers.stream(spark, f"{tmp_path}/x", "layer string, x array<double>"), f"{tmp_path}/g", f"{tmp_path}/c3")
    got = {(r["layer"], r["i"], r["j"]): r["g"] for r in streaming.current_gram(spark, f"{tmp_path}/g").collect()}
    assert got == {(r["layer"], r["i"], r["j"]): r["g"] for r in linalg.gram(x).collect()}


def test_stream_packing_carries_its_tail_over(spark, tmp_path):
    texts = ["a b c", "d", "e f g h i j k", "", "l m", "n o p q r s t u v"]
    folder, read = f"{tmp_path}/docs", "id long, text string"
    for start in (0, 2, 4):  # three files, so three batches
        spark.createDataFrame([(start + k, t) for k, t in enumerate(texts[start : start + 2])], read).coalesce(1).write.mode("append").parquet(folder)
        streaming.stream_pack(readers.stream(spark, folder, read), f"{tmp_path}/packed", f"{tmp_path}/c", 4, ["id"])
    stream = [t for x in texts for t in ["<eos>", *x.split()]]
    got = spark.read.parquet(f"{tmp_path}/packed/sequences").orderBy("seq_id").collect()
    assert [r["seq_id"] for r in got] == list(range(len(stream) // 4))
    assert [r["input_ids"] for r in got] == [stream[k : k + 4] for k in range(0, len(stream) - 3, 4)]
    tail = spark.read.parquet(f"{tmp_path}/packed/tail").orderBy(F.col("batch").desc()).first()
    assert tail["tokens"] == stream[len(stream) // 4 * 4 :] and tail["next_id"] == len(stream) // 4


def test_manifest_and_run_id():
    import datetime

    assert config.run_id("org/corpus", now=datetime.datetime(2024, 1, 2, 3, 4)) == "corpus-20240102-0304"
