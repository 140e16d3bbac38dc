"""Materialising intermediate tables in the shared folder, so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    A local session that names none gets a temporary folder, which is shared
    there by definition; anywhere else an unnamed folder is an error, because
    other machines could not read a local one.
    """
    named = spark.conf.get(_CONF, None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_CONF} to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tabscout-")
        spark.conf.set(_CONF, named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """A small table that is computed once and has no lineage behind it."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same for a larger table: Parquet in the shared folder, read back with column pruning."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
