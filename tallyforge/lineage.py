"""Cutting a plan's lineage between stages that read their input more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


#: Tasks a core that rows are dealt to.
_A_CORE = 4


def tasks(df: DataFrame) -> int:
    """How many tasks rows are dealt to: some for each core, so that none has more than its share."""
    return _A_CORE * df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to tasks. A small file may hold millions of rows in one task, which then makes all that comes of them."""
    return df.repartition(tasks(df))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents. Its shuffled bytes may be few as equal values compress well, and its rows then would all go to the driver for a broadcast."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's shared checkpoint folder; a local folder only where none is named."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyforge-"))
    return df.checkpoint(eager=True)


#: Rows that go to all tasks at most.
_FEW = 100_000


def few(df: DataFrame, most: int = _FEW) -> DataFrame:
    """The rows cut, and broadcast to what they are joined with if they are counted to be few: what is cut tells the planner no size, and the other side would be shuffled whole."""
    df = cut(df)
    return df.hint("broadcast") if df.count() <= most else df
