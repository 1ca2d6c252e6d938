"""Shared pieces of the training-data operators: table access, lineage cuts, and connected components.

Every helper is distributed: nothing here brings rows, links or components to the driver.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Links that one task joins up; rows of a narrow table that a join may send to all tasks.
FEW, SENT = 1 << 20, 10_000

#: Bytes of Arrow data handed to a Python worker at once, and rows at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that long texts don't fill a worker; let workers find the package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'loomlight-shared')}"
    return named.rstrip("/")


def _write(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A lost executor costs a re-read, never a recomputation of what lies before. Unlike a cached frame the
    table also carries its true size, so the planner's broadcast decisions are checked ones.
    """
    return _write(df, tag)[0]


class Scratch:
    """The tables that an operator needs until its result is written; at the end of the block they go.

    Spark removes shuffle files when the driver collects what refers to them, which an idle driver rarely does, so the
    collection is asked for as well.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = _write(df, tag)
        self.paths.setdefault(tag, []).append(path)
        return out

    def drop(self, *tags: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for tag in tags:
            for path in self.paths.pop(tag, []):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        gc.collect()
        jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that never goes through the driver.

    The planner decides by compressed bytes, of which ids and flags take next to none, so what it would have the driver
    gather and send to all tasks can be a hundred times as large.
    """
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """A kept table of narrow rows as a side of a join: sent to all tasks only while its counted rows are few."""
    return F.broadcast(df) if df.count() <= SENT else shuffled(df)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels 0..n-1 of the connected components of the links a[i]-b[i]; a label is its component's smallest node."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _joined_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = pd.concat([pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)}), *frames], ignore_index=True)
    node, place = np.unique(np.concatenate((links["u"], links["v"])), return_inverse=True)
    label = forest(place[: len(links)], place[len(links) :], len(node))
    yield pd.DataFrame({"node": node, "component_id": node[label]})


def components(edges: DataFrame, scratch: Scratch, tag: str = "components") -> DataFrame:
    """(node, component_id) for every node of edges(u, v); component_id is the smallest node reachable.

    Up to FEW distinct links, counted first, one task joins them up: a bounded one of 16 bytes a link, for which rounds
    would cost some hundred jobs. Beyond that, first every node is contracted to its smallest neighbour's smallest neighbour, which leaves little of a dense
    group's many links. Then alternating large-star and small-star rounds: each turns every neighbourhood into a star
    around its smallest node, so the number of rounds is logarithmic in the longest path. A node with very many
    neighbours is never gathered: its minimum is a partially aggregated groupBy, and the minimum returns to its links
    by a shuffled join that adaptive execution may split. Each round is written to the shared folder. Ends when a round changes
    nothing. The result is a table kept in scratch as `tag`; the rounds' tables are gone.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(shuffled(least), "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    with Scratch(edges.sparkSession) as own:
        e = own.keep(tidy(edges), tag)
        if e.count() <= FEW:
            return scratch.keep(e.coalesce(1).mapInPandas(_joined_up, "node long, component_id long"), tag)
        ends = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        home = own.keep(least.join(shuffled(least.select(F.col("u").alias("p"), F.col("p").alias("home"))), "p").select(F.col("u").alias("node"), "home"), tag)
        e = e.join(shuffled(home.select(F.col("node").alias("u"), F.col("home").alias("a"))), "u").join(shuffled(home.select(F.col("node").alias("v"), F.col("home").alias("b"))), "v")
        e = own.keep(tidy(e.select(F.col("a").alias("u"), F.col("b").alias("v"))), tag)
        before = digest(e)
        while before[0]:
            e = own.keep(star(star(e, True), False), tag)
            now = digest(e)
            if now == before:
                break
            before = now
        return scratch.keep(home.join(shuffled(e.select(F.col("u").alias("home"), F.col("v").alias("root"))), "home", "left").select("node", F.coalesce("root", "home").alias("component_id")), tag)


def gathered(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Regroup a stream sorted by keys into frames of about `rows` rows that never split a run of equal keys."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole[keys].iloc[-1]
        tail = np.ones(len(whole), bool)
        for k in keys:
            tail &= (whole[k] == last[k]).to_numpy()
        if not tail.all():
            yield whole[~tail]
        held, n = [whole[tail] if not tail.all() else whole], int(tail.sum())
    if n:
        yield pd.concat(held, ignore_index=True)
