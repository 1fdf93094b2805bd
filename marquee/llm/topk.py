"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights (term = position). Candidates are cut
into blocks and queries into blocks; every (query block, candidate block) cell is
one group of a cogrouped Arrow pass. Inside a cell the candidates become postings
(per term the rows that hold it and their weights), each query term scatters
``weight * posting weight`` into dense score arrays, and a partition selection
keeps the best k of the cell. The cells' lists are merged by a rank per query.

Scale: a cell holds at most about ``block_candidates`` + ``block_queries`` rows
whatever the size of the table, so a task's memory does not grow with the data;
the number of cells is (queries / block) x (candidates / block), which is the work
an exhaustive search has. Nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIT = "query_id long, vec_id long, score long"


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """``(id, weights)``: floor(scale * x) of every component, one row per id.

    Rows with a null id, a null vector, or null / non-finite components take no
    part. An id that occurs more than once counts once, with its smallest vector
    (so repeated rows change nothing). Other columns are ignored.
    """
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    weights = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
            .where(fine)
            .select(F.col(id_col).cast("long").alias("id"), weights.alias("weights"))
            .groupBy("id").agg(F.min("weights").alias("weights")))


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)
    out[rows, at] = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in column.chunks if len(c)), default=0)


def _scores(queries: np.ndarray, postings: list, n: int, small: bool) -> np.ndarray:
    """Score rows of one group of queries: term after term, weights times postings."""
    kind = np.int32 if small else np.int64
    score = np.zeros((len(queries), n), dtype=kind)
    for term, (rows, weights) in enumerate(postings):
        own = queries[:, term].astype(kind)
        holders = np.flatnonzero(own)
        if not len(rows) or not len(holders):
            continue
        if 2 * len(rows) > n:  # most candidates hold the term: add whole rows
            full = np.zeros(n, dtype=kind)
            full[rows] = weights
            if 2 * len(holders) > len(own):
                score += own[:, None] * full[None, :]
            else:
                score[holders] += own[holders, None] * full[None, :]
        else:
            for q in holders:
                score[q, rows] += own[q] * weights.astype(kind)
    return score


def _cell(k: int, chunk: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        width = max(_widest(left["weights"]), _widest(right["weights"]))
        if left.num_rows and right.num_rows and width == 0:
            width = 1
        if left.num_rows and right.num_rows:
            ids = right["id"].combine_chunks().to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            cand = _dense(right["weights"], width)[order]
            queries = _dense(left["weights"], width)
            query_ids = left["id"].combine_chunks().to_numpy(zero_copy_only=False)
            bound = float(np.abs(queries).max()) * float(np.abs(cand).max()) * width
            postings = []
            for term in range(width):
                rows = np.flatnonzero(cand[:, term])
                postings.append((rows, cand[rows, term]))
            for start in range(0, len(queries), chunk):
                score = _scores(queries[start:start + chunk], postings, len(ids), bound < 2 ** 31)
                for row, qid in zip(score, query_ids[start:start + chunk]):
                    own = np.searchsorted(ids, qid)
                    keep = np.arange(len(ids))
                    if own < len(ids) and ids[own] == qid:
                        keep = np.delete(keep, own)
                    s = row[keep]
                    if len(s) > k:  # selection: all above the k-th score, ties by smaller id
                        kth = np.partition(s, len(s) - k)[len(s) - k]
                        above = np.flatnonzero(s > kth)
                        level = np.flatnonzero(s == kth)[:k - len(above)]
                        best = np.concatenate([above, level])
                    else:
                        best = np.arange(len(s))
                    found["query_id"].append(np.full(len(best), qid, dtype=np.int64))
                    found["vec_id"].append(ids[keep[best]].astype(np.int64))
                    found["score"].append(s[best].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
                         for n, v in found.items()})

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_candidates: int = 16384,
          block_queries: int = 1024, chunk: int = 32) -> DataFrame:
    """The k best candidates of every query: ``query_id, rank, vec_id, score``.

    Both inputs are ``(id, weights)`` with distinct ids. The score is the integer
    inner product (missing trailing components count as zero); a query never meets
    the candidate with its own id; ties go to the smaller id; a query with fewer
    than k candidates gets them all, one without candidates no row.
    """
    n_c, n_q = candidates.count(), queries.count()
    c_blocks = max(1, -(-n_c // block_candidates))
    q_blocks = max(1, -(-n_q // block_queries))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "weights", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    right = candidates.select("id", "weights", block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    hits = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_cell(k, chunk), HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
