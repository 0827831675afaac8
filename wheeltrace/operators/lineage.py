"""Cutting lineage where a loop or several consumers would run a plan again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder. Where the session names none, a local one gets a new folder; a cluster,
    whose executors would each write to a disk of their own, is refused."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wheeltrace_"))
    return df.checkpoint()
