"""Whitening of embeddings by a two-pass covariance.

Each entry c becomes the integer x = floor(1024 c) + 100000. The first pass sums the x of every dimension exactly, as
integers; their mean is what the second pass centres by, before anything is multiplied: each task adds up the outer
products of its centred rows by matrix products of NumPy, a batch at a time, and treeAggregate merges the tasks' sums.
The eigenvectors of the covariance (LAPACK, symmetric) go back to the tasks by a broadcast, as one matrix of dimensions
by components, and every row is projected. How far the result is from white is measured on the result, not inferred.

What travels between tasks and driver has the size of the dimensions squared, whatever the number of rows: 32 KB for 64
dimensions, 134 MB for 4096, which bounds the dimensions, not the data. The rows are read once a pass.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or an entry whose x fits no long,
are dropped, and so are rows of another length than most (of equal numbers the longer one); a null key stays null;
repeated rows count and are returned each; of equal eigenvalues any order is right; components without variance (up to
1e-12 of the whole) can't be scaled and are left out, so that one row, or copies of one, give no rows; vectors of
fewer dimensions have fewer components; other columns are dropped; an empty table gives no rows. deviation_exact holds
every deviation; deviation is null where that fits no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, prepare, table

SCALE, SHIFT, COMPONENTS, NOTHING = 1024, 100_000, 8, 1e-12


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x array<long>) of the rows that remain."""
    d = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("c")).where("size(c) > 0")
    fits = f"forall(c, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < {(1 << 63) // SCALE - SHIFT}D)"
    x = d.where(fits).select("key", F.expr(f"transform(c, v -> floor({SCALE} * v) + {SHIFT}L) AS x"))
    most = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return x.where(F.size("x") == (most["size"] if most else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the number of rows and the exact sum of each dimension, as decimal text."""
    n, sums = 0, None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("x"))
            # halves of 32 bits can't overflow within a batch
            part = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            n, sums = n + len(x), part if sums is None else sums + part
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]})


def _outer(batches: Iterator[pa.RecordBatch], whole: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a task: the sum of the outer products of its centred rows. The mean is whole + rest, 0 <= rest < 1."""
    out = np.zeros((len(whole), len(whole)))
    for b in batches:
        if b.num_rows:
            centred = (_matrix(b.column("x")) - whole).astype(float) - rest
            out += centred.T @ centred
    yield pa.RecordBatch.from_pydict({"outer": [out.tobytes()]})


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def _add_bytes(a: np.ndarray, row) -> np.ndarray:  # noqa: ANN001
    return a + np.frombuffer(row.outer).reshape(a.shape)


def _add_sums(a: tuple[int, list[int]], b) -> tuple[int, list[int]]:  # noqa: ANN001
    return a[0] + b[0], [s + int(t) for s, t in zip(a[1], b[1], strict=True)]


class Whitening:
    """What a fit has learned: n and the sums S, the mean's parts, eigenvalues and vectors by falling value, the trace."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        value, vector = np.linalg.eigh(covariance)
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        keep = np.flatnonzero(value[::-1] > max(self.trace, 0) * NOTHING)[:components]
        self.values, self.vectors = value[::-1][keep], vector[:, ::-1][:, keep]
        self.whole, self.rest = mean_parts(n, sums)


def mean_parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of x(x array<long>), all of one length; None if there are no rows."""
    prepare(x.sparkSession)
    some = x.select("x")
    first = some.first()
    if first is None:
        return None
    size = len(first.x)
    n, sums = some.mapInArrow(_sums, "n long, sums array<string>").rdd.treeAggregate((0, [0] * size), _add_sums, _add_sums)
    whole, rest = mean_parts(n, sums)
    outer = some.mapInArrow(partial(_outer, whole=whole, rest=rest), "outer binary").rdd.treeAggregate(np.zeros((size, size)), _add_bytes, _add)
    return Whitening(n, sums, outer / n, components)


def _project(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    w: Whitening = shared.value
    by = w.vectors / np.sqrt(w.values)
    sums = np.array(w.sums, object)
    for b in batches:
        x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, len(sums)), np.int64)
        white = ((x - w.whole).astype(float) - w.rest) @ by
        exact = ((x.astype(object) * w.n - sums) ** 2).sum(axis=1) if len(x) else []
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * by.shape[1], pa.int32()), pa.array(white.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("key"), lists, pa.array([str(e) for e in exact], pa.string())], ["key", "white", "deviation"])


def project(x: DataFrame, w: Whitening) -> DataFrame:
    """(key, white array<double>, deviation decimal(38,0)) of x(key, x)."""
    shared = x.sparkSession.sparkContext.broadcast(w)
    key = x.schema["key"].dataType.simpleString()
    out = x.select("key", "x").mapInArrow(partial(_project, shared=shared), f"key {key}, white array<double>, deviation string")
    return out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of white(white) minus the identity; every product is of centred values."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    row = white.agg(*[F.covar_pop(F.get("white", F.lit(i)), F.get("white", F.lit(j))) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, white, explained, identity_error): a row for each vector that remains, white by component."""
    spark = vectors.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        x = scratch.keep(integers(vectors, vector, key), "whitening-integers")
        w = fit(x, components)
        if w is None or not len(w.values):
            none = "n long, deviation decimal(38,0), white array<double>, explained array<double>, identity_error double"
            return spark.createDataFrame([], f"`{key}` {x.schema['key'].dataType.simpleString()}, {none}")
        white = materialize(project(x, w), "whitening")
    error = identity_error(white, len(w.values))
    share = F.lit([float(v) for v in w.values / w.trace])
    return white.select(F.col("key").alias(key), F.lit(w.n).cast("long").alias("n"), "deviation", "white", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whiten(table(spark, sf_dir, "embeddings"))
    d = d.select("*", F.posexplode("white").alias("at", "whitened"))
    return d.select(
        "vec_id",
        F.expr("int(at + 1)").alias("component"),
        "n",
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened",
        F.expr("explained[at]").alias("explained"),
        "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )
