"""The shared folder for cut lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Paths of the tables that ``written`` made, by application.
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Without one a local session (as in tests) gets a new one; a cluster's has to name one that the driver and all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if context.master.partition("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lakesieve-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder: the lineage is cut, and partitions and their numbers stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """The address of a folder in the shared one that nobody has used; ``discard`` deletes it with the tables."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again: smaller than a checkpoint where neighbouring rows repeat values, and later reads take only the columns they use."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has made for this application: to be called when results that come from them have been written.  Checkpoints go by spark.cleaner.referenceTracking.cleanCheckpoints.  Returns their number."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files.delete(spark, path)
    return len(paths)
