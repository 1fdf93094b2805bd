"""A sparse matrix in cells and tall factors in blocks, for iterations of many products.

Keys of either side are dealt over blocks by their hash. A *cell* holds the entries of one row
block and one column block as index and value arrays; a *factor* is one dense matrix per block, its rows in the
order of the block's keys. A product sends a block's matrix to the cells that need it, multiplies
with numpy inside the task and adds the cells' results up, at most ``FAN`` at a time, so a task holds
a bounded number of block matrices whatever the number of blocks. A matrix of bounded size (a
checked number of entries) lies in *strips* of whole rows instead; every task reads them all
as they lie in the shared folder and has some of the factor's columns, so that a polynomial of A^T A
takes one pass, and its shuffles do not depend on the number of products. A plain product holds the strips once, in double
precision, for both directions (12 bytes an entry); a polynomial holds rows and columns in single precision (16 bytes), since it
only makes the correction of a factor. Beside them a task has so few of the factor's columns that these stay within ``HELD``
bytes. Everything that outlives a job is written to the shared folder; only matrices of the factor's width reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import discarded, written

FAN = 32
PART = "key int, part long, m binary"


#: Entries up to which every task may hold all of A (12 or 16 bytes each); beyond, products go cell by cell.
WHOLE = 32_000_000
#: Entries multiplied at a time.
SCATTER = 1 << 20
#: Bytes of a factor's columns, and of what is made of them, that a task holds beside the strips.
HELD = 256 << 20
#: Numbers gathered at a time for rows of the same length.
GATHER = 1 << 18


class Cells(NamedTuple):
    cells: DataFrame | None  #: rb, cb, rows, cols, vals (binary: int32, int32, float64)
    strips: DataFrame | None  #: side (0: rows), block, degs, at, idx, vals (binary: int32 and float64)
    row_keys: DataFrame  #: block, keys
    col_keys: DataFrame
    n_rows: int
    n_cols: int
    row_blocks: int
    col_blocks: int
    row_sizes: dict[int, int]  #: a number a block
    col_sizes: dict[int, int]
    thin: DataFrame | None = None  #: strips of rows (side 0) and of columns (side 1), vals as float32


def _keys(entries: DataFrame, name: str, size: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Keys in blocks of about ``size`` (more, if there are many): per block its ordered keys, and per key its place."""
    keys = entries.select(F.col(name).cast("long").alias("k")).distinct()
    n = keys.count()
    size = max(size, min(16_384, -(-n // 128)))
    blocks = max(1, -(-n // size))
    dealt = keys.select("k", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"))
    lists = written(dealt.groupBy("block").agg(F.array_sort(F.collect_list("k")).alias("keys")), f"{name}-blocks")
    return lists, lists.select("block", F.posexplode("keys").alias("at", "k")), n, blocks


def _packed(table: pa.Table) -> pa.Table:
    raw = {c: pa.array([table[c].to_numpy().astype(k).tobytes()], pa.binary())
           for c, k in (("rows", "i4"), ("cols", "i4"), ("vals", "f8"))}
    return pa.table({"rb": table["rb"].slice(0, 1), "cb": table["cb"].slice(0, 1), **raw})


STRIP = "side int, block int, degs binary, at binary, idx binary, vals binary"


def _strip(table: pa.Table, kind: str = "f8") -> pa.Table:
    """The rows of a block by their number of entries: ``degs`` pairs of that number and
    how many rows have it, ``at`` the rows, ``idx`` and ``vals`` their entries row after row."""
    own, other, vals = (table[c].to_numpy() for c in ("own", "other", "vals"))
    order = np.lexsort((other, own))
    own = own[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(first, len(own)))
    by = np.argsort(count, kind="stable")
    length = count[by]
    order = order[np.repeat(first[by] - np.cumsum(length) + length, length) + np.arange(len(own))]
    degs = np.stack(np.unique(length, return_counts=True), axis=1)
    raw = {"degs": degs.astype("i4"), "at": own[first[by]].astype("i4"), "idx": other[order].astype("i4"),
           "vals": vals[order].astype(kind)}
    return pa.table({"side": table["side"].slice(0, 1), "block": table["block"].slice(0, 1),
                     **{c: pa.array([x.tobytes()], pa.binary()) for c, x in raw.items()}})


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    blocks = sorted(sizes)
    return dict(zip(blocks, np.concatenate([[0], np.cumsum([sizes[b] for b in blocks])]).astype(int).tolist()))


def cells(entries: DataFrame, row: str, col: str, value: str, size: int = 4096, whole: int = WHOLE) -> Cells:
    """``entries`` (row, col, value; a pair once) in blocks of about ``size`` keys: as strips up to
    ``whole`` entries, as cells beyond."""
    row_keys, rows, n_rows, rb = _keys(entries, row, size)
    col_keys, cols, n_cols, cb = _keys(entries, col, size)
    row_sizes, col_sizes = ({r["block"]: r["n"] for r in k.select("block", F.size("keys").alias("n")).collect()}
                            for k in (row_keys, col_keys))  # a number a block
    placed = (entries.select(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"),
                             F.col(value).cast("double").alias("vals"))
              .join(rows.select(F.col("k").alias("r"), F.col("block").alias("rb"), F.col("at").alias("rows")), "r")
              .join(cols.select(F.col("k").alias("c"), F.col("block").alias("cb"), F.col("at").alias("cols")), "c")
              .select("rb", "cb", "rows", "cols", "vals"))
    if entries.count() > whole:
        packed = placed.groupBy("rb", "cb").applyInArrow(_packed, "rb int, cb int, rows binary, cols binary, vals binary")
        return Cells(written(packed, "cells"), None, row_keys, col_keys, n_rows, n_cols, rb, cb, row_sizes, col_sizes)
    spark = entries.sparkSession
    for block, at, sizes in (("rb", "rows", row_sizes), ("cb", "cols", col_sizes)):
        table = spark.createDataFrame(list(_starts(sizes).items()), f"{block} int, start int")
        placed = placed.join(F.broadcast(table), block).withColumn(at, F.col(at) + F.col("start")).drop("start")
    placed = written(placed, "placed")
    own, other = (placed.select(F.lit(side).alias("side"), F.col(block).alias("block"), F.col(here).alias("own"),
                                F.col(there).alias("other"), "vals")
                  for side, block, here, there in ((0, "rb", "rows", "cols"), (1, "cb", "cols", "rows")))
    strips = written(own.groupBy("side", "block").applyInArrow(lambda t: _strip(t), STRIP), "strips")
    columns = other.groupBy("side", "block").applyInArrow(lambda t: _strip(t, "f4"), STRIP)
    thin = written(strips.mapInArrow(_thinned, STRIP).unionByName(columns), "thin")
    discarded(placed)
    return Cells(None, strips, row_keys, col_keys, n_rows, n_cols, rb, cb, row_sizes, col_sizes, thin)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("vals")
        vals = [np.frombuffer(raw.as_buffer()).astype("f4").tobytes() for raw in batch.column(at)]
        yield batch.set_column(at, "vals", pa.array(vals, pa.binary()))


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width)


def _product(width: int, transposed: bool):
    here, there = ("cb", "rb") if transposed else ("rb", "cb")

    def multiply(cell: pa.Table, factor: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if cell.num_rows and factor.num_rows:
            r, c = (np.frombuffer(cell[x][0].as_py(), dtype=np.int32) for x in ("rows", "cols"))
            v = np.frombuffer(cell["vals"][0].as_py())
            if transposed:
                r, c = c, r
            order = np.argsort(r, kind="stable")
            r, c, v = r[order], c[order], v[order]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            x = _matrix(factor["m"][0].as_py(), width)
            y = np.zeros((int(factor["size"][0].as_py()), width))
            for a in range(0, len(first), 256):  # rows in strips, so that no copy of all entries arises
                cut = first[a:a + 256]
                stop = first[a + 256] if a + 256 < len(first) else len(r)
                y[r[cut]] = np.add.reduceat(v[cut[0]:stop, None] * x[c[cut[0]:stop]], cut - cut[0], axis=0)
            out = ([cell[here][0].as_py()], [cell[there][0].as_py()], [y.tobytes()])
        return pa.table({"key": pa.array(out[0], pa.int32()), "part": pa.array(out[1], pa.int64()),
                         "m": pa.array(out[2], pa.binary())})

    return multiply


def _adder(table: pa.Table) -> pa.Table:
    total = None
    for raw in table["m"]:
        m = np.frombuffer(raw.as_buffer(), dtype=np.float64)
        total = m.copy() if total is None else total.__iadd__(m)
    return pa.table({"key": table["key"].slice(0, 1), "part": table["part"].slice(0, 1),
                     "m": pa.array([total.tobytes()], pa.binary())})


def add_up(parts: DataFrame, most: int) -> DataFrame:
    """The matrices ``(key, part, m)`` added up per key; ``part`` lies within 0 .. most - 1."""
    while True:
        most = -(-most // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("key", "part").applyInArrow(_adder, PART)
        if most <= 1:
            return parts.select("key", "m")


def product(a: Cells, factor: DataFrame, width: int, transposed: bool = False,
            also: Sequence[tuple[DataFrame, float]] = (), scale: float = 1.0) -> DataFrame:
    """``scale * A @ M`` (or with A transposed) plus multiples of factors of that shape, as ``key, m``."""
    here, there = ("cb", "rb") if transposed else ("rb", "cb")
    sizes = a.col_keys if transposed else a.row_keys
    parts_in = a.row_blocks if transposed else a.col_blocks
    size = sizes.select(F.col("block").alias(here), F.size("keys").alias("size"))  # a number a block
    asked = (factor.select(F.col("key").alias(there), "m").join(a.cells.select("rb", "cb"), there)
             .join(size, here).select("rb", "cb", "size", "m"))
    asked = asked.toDF(*asked.columns)  # columns of its own: both sides come from the cells
    left = a.cells.select("rb", "cb", "rows", "cols", "vals")
    parts = left.groupBy("rb", "cb").cogroup(asked.groupBy("rb", "cb")).applyInArrow(_product(width, transposed), PART)
    if scale != 1.0:
        parts = scaled(parts, scale)
    for i, (other, times) in enumerate(also):
        parts = parts.unionByName(scaled(other.select("key", F.lit(parts_in + i).cast("long").alias("part"), "m"), times))
    return add_up(parts, parts_in + len(also))


def scaled(parts: DataFrame, times: float) -> DataFrame:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("m")
            done = [(np.frombuffer(raw.as_buffer(), dtype=np.float64) * times).tobytes() for raw in batch.column(at)]
            yield batch.set_column(at, "m", pa.array(done, pa.binary()))
    return parts.mapInArrow(multiply, parts.schema)


# -------------------------------------------- A^T A and polynomials of it, applied to a factor
def _pieces(strips: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of at most ``SCATTER`` entries: rows, the number of entries of each, and the entries' places and values."""
    for degs, at, idx, vals in strips:
        ends = np.cumsum(np.repeat(*degs.reshape(-1, 2).T), dtype=np.int64)
        for lo in range(0, len(idx), SCATTER):
            hi = min(lo + SCATTER, len(idx))
            first, last = np.searchsorted(ends, [lo, hi - 1], "right")
            counts = np.diff(np.concatenate([[lo], ends[first:last], [hi]]))
            yield at[first:last + 1].astype(np.intp), counts, idx[lo:hi].astype(np.intp), vals[lo:hi]


def _times(strips: list[tuple[np.ndarray, ...]], x: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """The matrix whose rows the strips hold times ``x``, added to ``out``: rows of the same number of entries together,
    some at a time."""
    width = x.shape[1]
    out = np.zeros((n, width), dtype=x.dtype) if out is None else out
    most = max(1, GATHER // max(1, width))
    for degs, at, idx, vals in strips:
        row = entry = 0
        for long, rows in degs.reshape(-1, 2).tolist():
            stop = row + rows
            if long > most:  # a row longer than a chunk
                for row in range(row, stop):
                    for lo in range(entry, entry + long, most):
                        hi = min(lo + most, entry + long)
                        out[at[row]] += vals[lo:hi] @ x.take(idx[lo:hi], axis=0)
                    entry += long
                row = stop
            while row < stop:
                some = min(max(1, most // long), stop - row)
                cut = slice(entry, entry + some * long)
                near = x.take(idx[cut], axis=0).reshape(some, long, width)
                out[at[row:row + some]] += np.matmul(vals[cut].reshape(some, 1, long), near)[:, 0]
                row, entry = row + some, cut.stop
    return out


def _back(strips: list[tuple[np.ndarray, ...]], y: np.ndarray, n: int) -> np.ndarray:
    """The transpose of the matrix whose rows the strips hold times ``y``: entries are added up over
    their columns, those of small strips together."""
    out, y = np.zeros((y.shape[1], n)), np.ascontiguousarray(y.T)
    parts: list[tuple[np.ndarray, ...]] = []

    def add():
        own, idx, vals = (np.concatenate(k) for k in zip(*parts))
        for total, column in zip(out, y):
            total += np.bincount(idx, vals * column.take(own), n)
        parts.clear()

    held = 0
    for rows, counts, idx, vals in _pieces(strips):
        parts.append((np.repeat(rows, counts), idx, vals))
        held += len(idx)
        if held >= SCATTER:
            add()
            held = 0
    if parts:
        add()
    return np.ascontiguousarray(out.T)


def shard_count(tasks: int, width: int, n_rows: int, n_cols: int, held: int | None = None) -> int:
    """Shards of a factor's columns: one a task, a multiple of it where a task would hold over ``HELD`` bytes
    (``held``: bytes a column)."""
    held = held or 8 * (6 * n_cols + 2 * n_rows)
    return max(1, min(width, tasks * max(1, -(-width * held // (HELD * tasks)))))


def _sharded(a: Cells, factor: DataFrame, width: int, made: Sequence[str], fn: Callable[..., Sequence[np.ndarray]],
             shards: int | None, out_rows: bool = False, used: list[DataFrame] | None = None, found: int = 0,
             single: bool = False, base: DataFrame | None = None,
             put: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``key`` and the matrices ``fn(forward, back, matrix)`` makes of a factor's, each task for
    one shard of the columns over all rows; it reads all strips of A from the shared folder. With ``found``, the
    factor's first columns go to every task, and only the others come out. ``single``: in single precision, with
    ``fn(forward, back, matrix, first columns or None, which columns)``. With ``base`` (key, m), ``m`` comes out as it is
    beside ``made``; with ``put`` each of ``made`` comes out as ``put(base's matrix of that name, the one made)``. A table that is of no use once the result is written joins ``used``."""
    spark = factor.sparkSession
    n_rows, n_cols = sum(a.row_sizes.values()), sum(a.col_sizes.values())
    held = 4 * (3 * n_cols + n_rows) if single else 8 * (3 * n_cols + 2 * n_rows)
    shards = shards or shard_count(spark.sparkContext.defaultParallelism, width, a.n_rows, a.n_cols, held)
    shards = max(1, min(shards, width - found))
    cuts = np.linspace(found, width, shards + 1).astype(int).tolist()
    col_starts, col_sizes = _starts(a.col_sizes), a.col_sizes
    sizes = a.row_sizes if out_rows else a.col_sizes
    starts = _starts(sizes)
    kind = np.float32 if single else np.float64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = _matrix(batch.column(1)[i].as_buffer(), width).astype(kind, copy=False)
                for g, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), batch.column(0).slice(i, 1),
                         pa.array([np.hstack([m[:, :found], m[:, lo:hi]]).tobytes()], pa.binary())], names=["shard", "block", "vals"])

    sliced = written(factor.select("key", "m").mapInArrow(cut, "shard int, block int, vals binary"), "shards", "uncompressed")
    if used is not None:
        used.append(sliced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: tuple[list, list] = ([], [])
        shard = x = None
        for batch in batches:
            for i in range(batch.num_rows):
                if shard is None:
                    shard = batch.column("id")[i].as_py()
                    x = np.zeros((n_cols, found + cuts[shard + 1] - cuts[shard]), dtype=kind)
                side, block = batch.column("side")[i].as_py(), batch.column("block")[i].as_py()
                raw = batch.column("vals")[i].as_buffer()
                if side == 2:
                    x[col_starts[block]:col_starts[block] + col_sizes[block]] = np.frombuffer(raw, dtype=kind).reshape(-1, x.shape[1])
                else:
                    ints = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("degs", "at", "idx"))
                    strips[side].append((*ints, np.frombuffer(raw, dtype=kind)))
        if shard is None:
            return
        known = np.ascontiguousarray(x[:, :found]) if found else None
        x = np.ascontiguousarray(x[:, found:])
        if single:
            done = fn(lambda m: _times(strips[0], m, n_rows), lambda m, out=None: _times(strips[1], m, n_cols, out), x, known,
                      slice(cuts[shard], cuts[shard + 1]))
        else:
            done = fn(lambda m: _times(strips[0], m, n_rows), lambda m: _back(strips[0], m, n_cols), x)
        for key, at in starts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([key], pa.int32())]
                + [pa.array([m[at:at + sizes[key]].tobytes()], pa.binary()) for m in done], names=["shard", "key", *made])

    based = base is not None
    names = ["m", *made] if based and not put else [*made]

    def together(table: pa.Table) -> pa.Table:
        order = np.argsort(table["shard"].to_numpy()).tolist()
        n, out = sizes[table["key"][0].as_py()], {}
        if based:
            own = {c: np.frombuffer(table[c][order[0]].as_buffer()).reshape(n, -1) for c in (made if put else made[:1])}
            out["m"] = own[made[0]]
            order = order[1:]
        for c in made:
            m = np.concatenate([np.frombuffer(table[c][i].as_buffer(), dtype=kind).reshape(n, -1) for i in order], axis=1)
            out[c] = put(own[c], m) if put else m
        return pa.table({"key": table["key"].slice(0, 1),
                         **{c: pa.array([np.ascontiguousarray(out[c], dtype=np.float64).tobytes()], pa.binary()) for c in names}})

    none = F.lit(None).cast("binary")
    feed = (a.thin if single else a.strips).withColumn("shard", F.lit(None).cast("int")).unionByName(sliced.select(
        F.lit(2).alias("side"), "block", "shard", none.alias("degs"), none.alias("at"), none.alias("idx"), "vals"))
    tasks = spark.range(0, shards, 1, shards).select(F.col("id").cast("int").alias("id"))
    # a nested loop over partitions: every task reads the feed itself, nothing of it is shuffled or broadcast
    every = feed.coalesce(1).hint("shuffle_replicate_nl").join(tasks, F.col("shard").isNull() | (F.col("shard") == F.col("id")))
    binaries = lambda columns: "key int" + "".join(f", {n} binary" for n in columns)
    done = every.select("id", "side", "block", "degs", "at", "idx", "vals").mapInArrow(run, f"shard int, {binaries(made)}")
    if based:  # as the shard before all others; what is not put together with anything travels as the first one made
        done = done.unionByName(base.select(F.lit(-1).alias("shard"), "key", *(
            F.col(c) if put else F.col("m").alias(c) if c == made[0] else none.alias(c) for c in made)))
    return done.groupBy("key").applyInArrow(together, binaries(names))


def filtered(a: Cells, factor: DataFrame, width: int, turn: np.ndarray, half: float, degree: int,
             shards: int | None = None, values: Sequence[float] = (), theta: np.ndarray | None = None,
             near: bool = True) -> DataFrame:
    """``key, m, im``: T_degree((A^T A - half) / half) of the turned factor, and A^T A of that;
    written. T_n+1 = 2 (A^T A - half) / half T_n - T_n-1. With ``values`` (strips only), the first
    columns are eigenvectors of these values: they stay, and are taken out of A^T A for the others.

    In strips every column x is divided by T_degree((theta - half) / half), its Ritz value ``theta`` being that of the turned
    ``m, im``: T_n(B) x / T_n(t) = x + e_n, where e follows the same recurrence from 0, driven by the residual B x - t x.
    So single precision is enough for e, whose error is small beside the residual; m and im are of double precision. While
    this is not ``near``, A^T A e is of single precision too, and im the sum; a later pass makes it anew."""
    w = turn.shape[1]
    n = len(values)
    if a.strips is not None:
        used: list[DataFrame] = []
        now = mapped(factor, ["m"], [width], ["m"], lambda m: [m @ turn])
        if degree:
            ritz = np.asarray(theta, dtype=np.float64)
            shift = np.maximum(ritz / half - 1.0, 1.0)
            fixed = np.asarray(values, dtype=np.float32)[:, None]

            def rest(m, im):
                m, im = m @ turn, im @ turn
                return [np.hstack([m[:, :n], (im[:, n:] - m[:, n:] * ritz[n:]) / half])]

            def correction(forward, back, drive, known, at):
                t = shift[at]
                ratio, before, now = 1.0 / t, None, drive / t.astype(np.float32)  # ratio: T_j-1 / T_j of t
                for _ in range(1, degree):
                    after = 1.0 / (2.0 * t - ratio)
                    if before is not None:  # what the product is added to
                        before *= (-0.5 * half * ratio).astype(np.float32)
                    up = back(forward(now), before)
                    if known is not None:
                        up -= known @ (fixed * (known.T @ now))
                    up *= (2.0 * after / half).astype(np.float32)
                    twice = (2.0 * after).astype(np.float32)
                    for lo in range(0, len(up), 65_536):
                        part = slice(lo, lo + 65_536)
                        up[part] += (drive[part] - now[part]) * twice
                    before, now, ratio = now, up, after
                before = None
                return [now] if near else [now, back(forward(now))]

            def put(own, e):
                return own + np.hstack([np.zeros((len(own), n)), e])

            drive = mapped(factor, ["m", "im"], [width] * 2, ["m"], rest)
            made = ["m"] if near else ["m", "im"]
            now = mapped(factor, made, [width] * len(made), made, lambda *ms: [m @ turn for m in ms])
            now = written(_sharded(a, drive, w, made, correction, shards, used=used, found=n, single=True, base=now, put=put),
                          "filtered", "uncompressed")
            if not near:
                discarded(*used)
                return now
            used.append(now)
        out = _sharded(a, now, w, ["im"], lambda forward, back, m: [back(forward(m))], shards, used=used, base=now)
        out = written(out, "filtered", "uncompressed")
        discarded(*used)
        return out
    turned = mapped(factor, ["m"], [width], ["m"], lambda m: [m @ turn])
    before, now = None, written(turned, "turned", "uncompressed")
    for step in range(degree):
        also = [(now, -2.0), (before, -1.0)] if step else [(now, -1.0)]
        old, before, now = before, now, written(product(a, product(a, now, w), w, transposed=True, scale=(2 if step else 1) / half,
                                                        also=also), "filtered", "uncompressed")
        discarded(*(t for t in (old,) if t is not None))
    image = product(a, product(a, now, w), w, transposed=True)
    out = written(now.join(image.withColumnRenamed("m", "im"), "key"), "filtered", "uncompressed")
    discarded(*(t for t in (before, now) if t is not None))
    return out


def left_product(a: Cells, factor: DataFrame, width: int, shards: int | None = None,
                 used: list[DataFrame] | None = None) -> DataFrame:
    """``key, m``: A times a factor."""
    if a.strips is None:
        return product(a, factor, width)
    return _sharded(a, factor, width, ["m"], lambda forward, back, m: [forward(m)], shards, out_rows=True, used=used)


def mapped(factor: DataFrame, columns: Sequence[str], widths: Sequence[int], names: Sequence[str],
           fn: Callable[..., Sequence[np.ndarray]]) -> DataFrame:
    """``key`` and the matrices that ``fn`` makes of a block's matrices."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = fn(*(_matrix(batch.column(c + 1)[i].as_py(), w) for c, w in enumerate(widths)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1)] + [pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in made],
                    names=["key", *names])
    schema = "key int" + "".join(f", {n} binary" for n in names)
    return factor.select("key", *columns).mapInArrow(apply, schema)


def gathered(factor: DataFrame, columns: Sequence[str], widths: Sequence[int],
             fn: Callable[..., np.ndarray], blocks: int) -> np.ndarray:
    """The sum over all blocks of a small matrix that ``fn`` makes of a block's matrices (flat)."""
    one = mapped(factor, columns, widths, ["m"], lambda *ms: [fn(*ms)])
    parts = one.select(F.lit(0).alias("key"), F.col("key").cast("long").alias("part"), "m")
    return np.frombuffer(add_up(parts, blocks).first()["m"], dtype=np.float64)


def rows(factor: DataFrame, keys: DataFrame, width: int, column: str = "m") -> DataFrame:
    """A factor as rows ``key, vec``."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = _matrix(batch.column(1)[i].as_py(), width)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, vec], names=["key", "vec"])
    joined = keys.join(factor.select(F.col("key").alias("block"), F.col(column).alias("m")), "block")
    return joined.select("keys", "m").mapInArrow(spread, "key long, vec array<double>")
