"""Tables in the folder that driver and executors share, to cut lineages that would else be recomputed; rows dealt out."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a task of heavy work gets at least, the tasks that a table of some size has, and the rows that more tasks get.
LEAST, TASKS, MOST = 2500, 64, 20_000
#: Rows of a narrow table that a join may send to all tasks.
SENT = 10_000


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'loomlight-shared')}"
    return named.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that never goes through the driver.

    The planner decides by compressed bytes, or by those of the columns that an expression begins with; what it would
    have the driver gather and send to all tasks can be far larger.
    """
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """A table that was cut, of narrow rows, as a side of a join: sent to all tasks only while its counted rows are few."""
    return F.broadcast(df) if df.count() <= SENT else shuffled(df)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out over enough tasks for work that costs far more than reading the rows does.

    A file of narrow rows is read in few splits, however many rows it has, so that a few tasks would do all that follows.
    The rows are counted for that, which costs the footers' numbers for a table as it was read.
    """
    rows = df.count()
    n = min(-(-rows // LEAST), max(TASKS, -(-rows // MOST)))
    return df.repartition(n, *by) if n > 1 else df


def settled(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are made once a row: what follows neither repeats their expressions nor filters ahead of them.

    A projection alone doesn't ensure that: the optimizer copies it into whatever names its columns, and moves a filter on
    them below it and below a shuffle, so that costly columns are made several times, and by the few tasks that read.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in made.items()]))
    return df.select("*", F.inline(row).alias(*made))
