"""Arrow files as a data source."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesieve.sources import arrow, readers

SCHEMA = pa.schema([("k", pa.int64()), ("text", pa.string()), ("xs", pa.list_(pa.float32())), ("s", pa.struct([("a", pa.int32()), ("t", pa.timestamp("us", "UTC"))]))])


def table_of(start, n):
    return pa.table({"k": range(start, start + n), "text": [None if k % 7 == 0 else f"text {k}" * (k % 3) for k in range(start, start + n)], "xs": [[1.0, None, k] if k % 2 else None for k in range(start, start + n)],
                     "s": [{"a": k, "t": dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)} for k in range(start, start + n)]}, schema=SCHEMA)


@pytest.fixture
def folder(tmp_path):
    with pa.OSFile(str(tmp_path / "1.arrow"), "wb") as f, pa.ipc.new_file(f, SCHEMA) as w:
        w.write_table(table_of(0, 1000), max_chunksize=10)
    with pa.OSFile(str(tmp_path / "2.arrow"), "wb") as f, pa.ipc.new_stream(f, SCHEMA) as w:
        w.write_table(table_of(1000, 50), max_chunksize=7)
    with pa.OSFile(str(tmp_path / "3.arrow"), "wb") as f, pa.ipc.new_file(f, SCHEMA) as w:
        pass
    (tmp_path / "left.writing").write_bytes(b"of a task that was lost")
    return str(tmp_path)


@pytest.mark.parametrize("split", [64 << 20, 5000])
def test_files_are_split_by_ranges_of_batches(spark, folder, monkeypatch, split):
    monkeypatch.setattr(arrow, "SPLIT_BYTES", split)
    spark.dataSource.register(arrow.ArrowFiles)
    df = spark.read.format("arrow_files").option("path", folder).option("splitBytes", split).load()
    want = sorted((x["k"], x["text"], x["xs"], x["s"]["a"]) for x in pa.concat_tables([table_of(0, 1000), table_of(1000, 50)]).to_pylist())
    assert sorted((r["k"], r["text"], r["xs"], r["s"]["a"]) for r in df.collect()) == want
    used = df.select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.count("*").alias("n")).collect()
    assert len(used) == 2 if split > 1 << 20 else len(used) > 10 and max(r["n"] for r in used) < 200


def test_named_columns_alone_are_read(spark, folder):
    df = readers.arrow_folder(spark, folder, columns=["text", "k"])
    assert df.columns == ["text", "k"] and df.count() == 1050 and df.agg(F.sum("k")).first()[0] == sum(range(1050))
    reader, _ = arrow._opened(folder, f"{folder}/1.arrow", ["k"])
    assert reader.get_batch(0).schema.names == ["k"]
    assert readers.arrow_folder(spark, folder, "k long, text string").agg(F.max("k")).first()[0] == 1049
    with pytest.raises(Exception, match="no column"):
        readers.arrow_folder(spark, folder, columns=["missing"]).collect()


def test_both_ways_agree(spark, folder):
    rows = lambda df: sorted(map(repr, df.select("k", "text", "xs").collect()))
    assert rows(readers.arrow_folder(spark, folder)) == rows(readers._arrow_by_spark(spark, folder))
    assert not arrow.known_store("viewfs://store/in") and arrow.known_store(folder) and arrow.known_store(f"file://{folder}")


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"é日 {k}", [k, None], {"m": k}, dt.date(2024, 1, 1)) for k in range(97)], "k long, text string, xs array<int>, m map<string,int>, d date").repartition(4)
    assert arrow.write_arrow(df, path) == 4 and arrow.write_arrow(df.where("false"), path) == 0
    back = readers.arrow_folder(spark, path)
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    arrow.write_arrow(df.limit(3).coalesce(1), path)
    assert readers.arrow_folder(spark, path).count() == 100
    (tmp_path / "empty").mkdir()
    assert readers.arrow_folder(spark, str(tmp_path / "empty"), "k long").count() == 0
    with pytest.raises(Exception, match="name a schema"):
        readers.arrow_folder(spark, str(tmp_path / "empty"))
