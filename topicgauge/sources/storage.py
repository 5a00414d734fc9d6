"""Storing intermediate and final tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. A session in a single process may do without, and gets one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="topicgauge-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table once and read it back from the shared folder.

    The copy survives lost executors, cuts the lineage, and lets every reader fetch only the
    columns it needs.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/topicgauge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write a result, for example heatmap rows as JSON partitioned by ``query_id``."""
    df.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)
