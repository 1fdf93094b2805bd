"""Centroid clustering by Lloyd's rounds, sharded by dimension, in exact integers.

The vectors are written once as cells: a chunk of rows (``chunk``) times a block of columns
(``block``). In every round

1. a *column-block task* has cells and its slice of the centroids only, and computes the exact
   partial squared distances of the chunk's rows to every centroid slice;
2. a *reduce by chunk* adds the partial distances of the blocks and takes the argmin (ties: the
   smaller number), one byte string of cluster numbers a chunk;
3. *each shard updates its own slice*: the cells of a block meet the cluster numbers of their chunk,
   componentwise sums and counts are added up within the task, then by (block, cluster), and the
   floor of sum / count is the next slice. A centroid without vectors stays.

Scale: a round shuffles the partial distances (``blocks x k`` numbers a vector in the smallest
integer type that holds them) and the cells (one to eight bytes a component), in chunks of fixed
size, so no task's memory grows with the table, and a cluster that holds most vectors is only a
partial sum per task. What reaches the driver is the centroids: ``k x width`` numbers, parameters
both. Every round's assignment is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import written

CELL = "chunk long, block int, n int, x binary"


class Clustering(NamedTuple):
    assigned: DataFrame  #: id, cluster, distance (squared), a row per vector
    totals: DataFrame  #: cluster, inertia (distance summed over the cluster); clusters with vectors only
    centroids: np.ndarray  #: k x width integers after the last round


def quantised(df: DataFrame, id_col: str, vec_col: str, width: int, scale: int = 64) -> DataFrame:
    """``(id, vec)``: floor(scale * x) of every component, of vectors with exactly ``width``
    components, none null or not finite. Other vectors and other columns go; null ids and
    repeated rows stay, each row a vector of its own."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    largest = float(math.isqrt((2 ** 63 - 1) // max(1, width)) // 2)

    def whole(v):
        f = F.floor(v * F.lit(float(scale)).cast("double"))
        return F.when(F.abs(v * float(scale)) < largest, f.cast("long")).otherwise(
            F.raise_error(F.lit("a squared distance to this component may not fit 64 bits")).cast("long"))

    return (df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == width) & fine)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("vec")))


def _pack(matrix: np.ndarray) -> bytes:
    """Row-major bytes in the smallest signed integer type."""
    top = int(max(-(matrix.min(initial=0) + 1), matrix.max(initial=0)))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return matrix.astype(kind).tobytes()


def _unpack(raw: bytes, rows: int) -> np.ndarray:
    """The matrix of ``rows`` rows behind a leading byte that says its item size."""
    return np.frombuffer(raw, dtype=f"i{raw[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _tagged(matrix: np.ndarray) -> bytes:
    packed = _pack(matrix)
    return bytes([len(packed) // max(1, matrix.size)]) + packed if matrix.size else b"\x01"


def _cutter(width: int, block: int, rows: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                n = part.num_rows
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                cells = [_tagged(x[:, c:c + block]) for c in range(0, width, block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first] * (len(cells) + 1), pa.int64()), pa.array([-1, *range(len(cells))], pa.int32()),
                     pa.array([n] * (len(cells) + 1), pa.int32()), pa.array([None, *cells], pa.binary()),
                     pa.array([part.column(0).to_pylist()] + [None] * len(cells), pa.list_(pa.int64()))],
                    names=["chunk", "block", "n", "x", "ids"])
                first += 1

    return cut


def _partial(centroids: np.ndarray, block: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, n, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "x"))):
                x, c = _unpack(raw, n), centroids[:, b * block:(b + 1) * block]
                d = np.empty((n, len(c)), dtype=np.int64)
                for j, own in enumerate(c):
                    d[:, j] = ((x - own) ** 2).sum(axis=1)
                out.append(_tagged(d))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("chunk", "block", "n")]
                                             + [pa.array(out, pa.binary())], names=["chunk", "block", "n", "x"])

    return measure


def _argmin(table: pa.Table) -> pa.Table:
    n = table["n"][0].as_py()
    total = sum(_unpack(raw, n) for raw in table["x"].to_pylist())
    best = total.argmin(axis=1)  # the first of the smallest
    return pa.table({"chunk": table["chunk"].slice(0, 1), "n": table["n"].slice(0, 1),
                     "cluster": pa.array([_tagged(best[:, None])], pa.binary()),
                     "distance": pa.array([_tagged(total[np.arange(n), best][:, None])], pa.binary())})


def _sums(k: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # block -> k rows of sums, with the counts in front
        for batch in batches:
            for b, n, raw, who in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "x", "cluster"))):
                x, who = _unpack(raw, n), _unpack(who, n)[:, 0]
                have = sums.setdefault(b, np.zeros((k, 1 + x.shape[1]), dtype=np.int64))
                np.add.at(have, who, np.concatenate([np.ones((n, 1), dtype=np.int64), x], axis=1))
        for b, have in sums.items():
            some = np.flatnonzero(have[:, 0])
            size = have.shape[1] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some) * size, b, dtype=np.int32)), pa.array(np.repeat(some, size).astype(np.int32)),
                 pa.array(np.tile(np.arange(size, dtype=np.int32), len(some))),
                 pa.array(have[some, 1:].ravel()), pa.array(np.repeat(have[some, 0], size))],
                names=["block", "cluster", "place", "total", "members"])

    return add


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, n, who, d in zip(batch.column("ids"), *(batch.column(c).to_pylist()
                                                         for c in ("n", "cluster", "distance"))):
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(_unpack(who, n)[:, 0].astype(np.int32)), pa.array(_unpack(d, n)[:, 0])],
                names=["id", "cluster", "distance"])


def _inertia(k: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in batches:
            for n, who, d in zip(*(batch.column(c).to_pylist() for c in ("n", "cluster", "distance"))):
                who, d = _unpack(who, n)[:, 0], _unpack(d, n)[:, 0]
                for c in np.unique(who).tolist():
                    seen[c] = seen.get(c, 0) + int(d[who == c].astype(object).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())],
                                         names=["cluster", "inertia"])

    return add


def lloyd(vectors: DataFrame, width: int, k: int = 16, rounds: int = 3, seed: int = 1, block: int = 16,
          chunk: int = 4096) -> Clustering:
    """``rounds`` rounds of Lloyd over ``(id, vec)`` (``vec``: ``width`` longs, see ``quantised``),
    then one more assignment.

    The centroids start as the k vectors with the smallest lowercase-hex sha256 of ``seed:id``, in
    that order (a null id last, equal ids by vector); fewer vectors than k are all centroids, no
    vectors give no rows. Equal centroids may arise (repeated rows): ties go to the smaller number.
    A sum or distance beyond 64 bits raises.
    """
    spark = vectors.sparkSession
    start = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
                            .asc_nulls_last(), "vec").limit(k).collect()
    if not start:
        empty = "cluster int, {} long".format
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"),
                          spark.createDataFrame([], empty("inertia")), np.zeros((0, width), dtype=np.int64))
    centroids = np.array([r["vec"] for r in start], dtype=np.int64)
    k = len(centroids)
    rows = max(1, min(chunk, (1 << 24) // k))
    laid = written(vectors.select("id", "vec").mapInArrow(_cutter(width, block, rows), f"{CELL}, ids array<long>"), "cells")
    cells = laid.where("block >= 0").select("chunk", "block", "n", "x")

    def assign() -> DataFrame:
        measured = cells.mapInArrow(_partial(centroids, block), CELL)
        return written(measured.groupBy("chunk").applyInArrow(
            _argmin, "chunk long, n int, cluster binary, distance binary"), "assigned")

    for _ in range(rounds):
        added = (cells.join(assign().select("chunk", "cluster"), "chunk")
                 .mapInArrow(_sums(k), "block int, cluster int, place int, total long, members long")
                 .groupBy("block", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members")))
        floor = F.expr("(total - pmod(total, members)) div members")
        centroids = centroids.copy()
        for r in added.select("block", "cluster", "place", floor.alias("mean")).collect():  # k x width numbers
            centroids[r["cluster"], r["block"] * block + r["place"]] = r["mean"]
    last = assign()
    ids = laid.where("block < 0").select("chunk", "ids")
    assigned = last.join(ids, "chunk").select("ids", "n", "cluster", "distance").mapInArrow(
        _rows, "id long, cluster int, distance long")
    totals = (last.select("n", "cluster", "distance").mapInArrow(_inertia(k), "cluster int, inertia long")
              .groupBy("cluster").agg(F.sum("inertia").alias("inertia")))
    return Clustering(assigned, totals, centroids)
