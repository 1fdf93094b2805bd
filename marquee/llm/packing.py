"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

Only the *lengths* of pieces matter for the plan, and there are at most ``capacity``
different ones, so the plan is made on the count of pieces per length: at most 4096
rows reach the driver, whatever the size of the corpus. The plan says, for runs of
the pieces of one length, which sequences and places they take; it has a few rows
per length. Every piece then finds its place by its length and its number among the
pieces of that length; that numbering is dealt over (length, bucket) groups, so a
length that a third of all pieces have is no group of its own.

Reduction (after Martello and Toth): going down the lengths, a sequence's content is
fixed for good where a set of at most three pieces dominates every other way to fill
the sequence of the longest piece left - each alternative's pieces can be exchanged
one for one (or several for one) with pieces of the set that are no shorter:

* ``{a}``: nothing fits beside a;
* ``{a, b}``, b the longest that fits: it fills the sequence exactly, or no two
  pieces fit beside a, or no three fit and no two that do are longer together than b;
* ``{a, b, c}``, no three fit beside a: b the longest that fits, c the longest that
  fits beside both, and no pair that fits has its shorter piece longer than c.

What is left goes by decreasing length to the sequence with the least room that
still takes it. Both steps treat equal sequences together.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.workers import shielded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Counts:
    """Pieces left per length, with the order of the lengths that have any."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def longest(self, room: int, used: dict[int, int]) -> int:
        """The longest length up to ``room`` with a piece beyond ``used``; 0 if none."""
        i = bisect.bisect_right(self.sizes, room)
        while i:
            i -= 1
            if self.n[self.sizes[i]] > used.get(self.sizes[i], 0):
                return self.sizes[i]
        return 0

    def smallest_sum(self, k: int, used: dict[int, int]) -> float:
        """Together, the k shortest pieces beyond ``used``."""
        total = 0
        for s in self.sizes:
            have = min(k, self.n[s] - used.get(s, 0))
            total, k = total + have * s, k - have
            if not k:
                return total
        return float("inf")

    def pairs(self, room: int, used: dict[int, int]) -> tuple[int, int]:
        """Over pairs that fit: the largest sum, the longest shorter piece (0, 0 if none)."""
        best, shorter = 0, 0
        for y in reversed(self.sizes[:bisect.bisect_right(self.sizes, room // 2)]):
            if self.n[y] <= used.get(y, 0):
                continue
            x = self.longest(room - y, used | {y: used.get(y, 0) + 1})
            if x >= y:
                best, shorter = max(best, x + y), max(shorter, y)
        return best, shorter


def _dominating(left: _Counts, a: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others with a piece of length a, or None."""
    room, used = capacity - a, {a: 1}
    b = left.longest(room, used)
    if not b:
        return (a,)
    if b == room or left.smallest_sum(2, used) > room:
        return (a, b)
    if left.smallest_sum(3, used) > room:
        best, shorter = left.pairs(room, used)
        if best <= b:
            return (a, b)
        used[b] = used.get(b, 0) + 1
        c = left.longest(room - b, used)
        if c and shorter <= c:
            return (a, b, c)
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], dict[str, int]]:
    """Rows ``(length, first, n, sequence, per_sequence, offset)``: of the pieces of
    that length, numbers first .. first + n - 1 go ``per_sequence`` to a sequence from
    ``sequence`` on, the first at ``offset``. And how many sequences each step made."""
    rows: list[tuple] = []
    done: dict[int, int] = {}
    total = 0

    def put(size, n, sequence, per, offset):
        rows.append((size, done.get(size, 0), n, sequence, per, offset))
        done[size] = done.get(size, 0) + n

    left = _Counts(counts)
    for a in sorted(left.n, reverse=True):
        while a in left.n and (group := _dominating(left, a, capacity)):
            need = {s: group.count(s) for s in group}
            n = min(left.n[s] // c for s, c in need.items())
            offset = 0
            for s in group:
                put(s, n, total, 1, offset)
                offset += s
            for s, c in need.items():
                left.take(s, n * c)
            total += n
    reduced = total
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs (sequence, how many) of sequences with that room
    rooms: list[int] = []

    def leave(room, sequence, n):
        if n and room:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((sequence, n))

    for size in sorted(left.n, reverse=True):
        n = left.n[size]
        while n:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                sequence, have = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room = capacity
                sequence, have = total, -(-n // (capacity // size))
                total += have
            per = room // size
            full = min(have, n // per)
            if full:
                put(size, full * per, sequence, per, capacity - room)
                leave(room - per * size, sequence, full)
                n -= full * per
            if full < have:
                rest = min(n, per - 1) if n < per else 0
                if rest:
                    put(size, rest, sequence + full, rest, capacity - room)
                    leave(room - rest * size, sequence + full, 1)
                    n -= rest
                    full += 1
                leave(room, sequence + full, have - full)
    return rows, {"reduced": reduced, "best_fit": total - reduced, "sequences": total}


def _pieces(tokenizer: str, prefix: str, end_id: int | None, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marquee.llm.words import tokenizers_encoder
        encoder = tokenizers_encoder(tokenizer, prefix)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0)
            for at, ids, offsets in encoder.encode(batch.column(1)):
                out = []
                ends = offsets.tolist()
                for key, a, b in zip(keys.slice(at, len(ends) - 1).to_pylist(), ends, ends[1:]):
                    whole = ids[a:b].tobytes() + end
                    for piece, start in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[start:start + 4 * capacity]
                        out.append((key, piece, start // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                names, kinds = (["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                                [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])
                columns = list(zip(*out)) if out else [[] for _ in names]
                use = len(names) if with_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:use], kinds)],
                                                 names=names[:use])

    return cut


def pieces(docs: DataFrame, tokenizer: str, key_col: str = "doc_id", text_col: str = "text", prefix: str = "",
           end_id: int | None = 1, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id, piece, start, length,
    ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    A null text is empty: its one piece is the end id (without an end id an empty
    text has no piece). A null key stays null; rows with equal keys are separate
    documents. Other columns are dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(key_col).cast("long").alias("k"), text.alias("t")).mapInArrow(
        _pieces(tokenizer, prefix, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


def _placed(rows: list[tuple]):
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table[:, 1:3].sum(axis=1).max()) + 1 if len(table) else 1
        first = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            r = table[np.searchsorted(first, length * span + number, side="right") - 1]
            nth = number - r[:, 1]
            kept = [n for n in batch.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(r[:, 3] + nth // r[:, 4], pa.int64()),
                                                   pa.array(r[:, 5] + nth % r[:, 4] * length, pa.int64())],
                names=kept + ["sequence_id", "offset"])

    return place


def pack(table: DataFrame, capacity: int = 4096, bucket_rows: int = 20_000) -> DataFrame:
    """``table`` (``doc_id, piece, length`` and any more columns; lengths from 1 to
    ``capacity``) plus ``sequence_id`` and ``offset``; places are gapless from 0.

    The input is read twice (once to count lengths and buckets): pass a written
    table. Rows that are equal in every key are placed one by one all the same. A length
    is dealt over buckets by a hash of the whole row, as many as leave about ``bucket_rows`` in each
    if all rows had one length. Columns named ``sequence_id`` or ``offset`` are replaced.
    """
    table, restored = shielded(table, "doc_id", "piece", "length", made=("sequence_id", "offset"))
    bad = table.where(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if bad.limit(1).count():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    buckets = max(1, -(-table.count() // bucket_rows))
    salted = table.withColumn("_bucket", F.pmod(F.xxhash64(*table.columns), F.lit(buckets)).cast("int"))
    per_bucket = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # the driver sees a row per length
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    numbered = (salted.withColumn("_row", F.row_number().over(within) - 1)
                .join(starts, ["length", "_bucket"])
                .select(*table.columns, (F.col("_row") + F.col("_before")).alias("_number")))
    schema = ", ".join(f"`{n}` {t}" for n, t in table.dtypes) + ", sequence_id long, offset long"
    return restored(numbered.mapInArrow(_placed(rows), schema))
