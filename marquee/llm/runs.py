"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period ``q``, at least ``min_length``
and ``2 q`` words long, that no neighbouring word extends keeping the period.

1. The words of a document are numbered (exactly, by a dictionary of its own), and a slice of
   documents, each with numbers of its own, gets one suffix array by prefix doubling: only
   suffixes that are not yet alone are sorted again. No match can cross documents. LCP values
   come from the ranks of the doubling levels.
2. For each LCP interval (a node of the suffix tree, but only a depth and two bounds here; children
   are the stretches between its minima) the suffixes of all children but a largest one are taken:
   suffix ``i`` of an interval of depth ``d`` makes a square at ``i`` if ISA[i + d] lies within
   the bounds, and one at ``i - d`` if ISA[i - d] does. It is branching if the word behind breaks the
   period. Skipping a largest child makes this O(n log n) tests.
3. Every run ends in exactly one branching square of its period. Squares of one end are taken by
   period: the smallest is rotated to the left as far as the words repeat, which gives the run, and
   the squares that lie within it (multiples of the period) are merged into it.

A document with a run has two places that agree over ``min_length / 2`` words, so only documents
with such an LCP value go through steps 2 and 3.

Scale: a document is looked at within the map task that reads it, nothing is shuffled, and no group
of documents ever forms. Memory goes with the slice: 100,000 words, or one longer document, at
about 4 bytes a word and doubling level besides some 100 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _numbered(raw: bytes, first: int, most: int = 1 << 20) -> tuple[np.ndarray, list[bytes]]:
    """The words (between ASCII white space) of a text as numbers from ``first``, by first
    appearance, and the distinct words; the text is split in parts of about ``most`` bytes."""
    known: dict[bytes, int] = {}
    parts, at = [np.zeros(0, dtype=np.int64)], 0
    while at < len(raw):
        space = _SPACE.search(raw, at + most)
        stop = space.start() if space else len(raw)
        words = (raw if not at and stop == len(raw) else raw[at:stop]).split()
        parts.append(np.array([known.setdefault(w, first + len(known)) for w in words], dtype=np.int64))
        at = stop
    return np.concatenate(parts), list(known)


def repeating(n: int, seed: int) -> np.ndarray:
    """Places of a word sequence turned periodic: from ``a = seed % n`` on it repeats its first
    ``1 + (n - a) // (3 + seed % 8)`` words. Fixed test rule, for texts without runs of their own."""
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and the rank tables of the doubling levels: in table j two suffixes
    rank alike if their first 2^j words agree (the last entry, of the empty suffix, is -1)."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    sorted_ = s[sa]
    first = np.ones(n, dtype=bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    slots = np.arange(n)
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(first, slots, 0))
    levels, step = [rank], 1
    open_ = slots[~(first & np.append(first[1:], True))]
    while len(open_):
        pos = sa[open_]
        key = rank[pos].astype(np.int64) * (n + 1) + rank[np.minimum(pos + step, n)] + 1
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[open_] = pos
        first = np.ones(len(pos), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[pos] = open_[np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))]
        levels.append(rank)
        open_ = open_[~(first & np.append(first[1:], True))]
        step *= 2
    return sa, levels


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of different suffixes ``x`` and ``y``."""
    n, start = len(levels[0]) - 1, x
    for j in reversed(range(len(levels))):
        step = (levels[j][x] == levels[j][y]) * (1 << j)
        x, y = np.minimum(x + step, n), np.minimum(y + step, n)
    return x - start


def _intervals(lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Per slot k with lcp[k] > 0 the interval [lo, hi) of slots whose depth is lcp[k], and
    ``head``, the first slot of the same interval with that value (a stack of slots, no tree)."""
    n = len(lcp)
    lo, hi, head = [0] * n, [n] * n, list(range(n))
    stack: list[int] = []
    for k, depth in enumerate(lcp):
        while stack and lcp[stack[-1]] > depth:
            hi[stack.pop()] = k
        if stack and lcp[stack[-1]] == depth:
            lo[k], head[k] = lo[stack[-1]], head[stack[-1]]
        else:
            lo[k] = stack[-1] if stack else 0
        if depth:
            stack.append(k)
        else:
            stack = [k]
    return lo, hi, head


def _children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start, size, depth, lo, hi`` of the children of all LCP intervals, but of each
    interval for one of its largest children."""
    lo, hi, head = (np.array(v) for v in _intervals(lcp.tolist()))
    k = np.flatnonzero(lcp)
    k = k[np.argsort(head[k], kind="stable")]
    opens = np.ones(len(k), dtype=bool)
    opens[1:] = head[k[1:]] != head[k[:-1]]
    ends = np.where(np.append(opens[1:], True), hi[k], np.append(k[1:], 0))
    # an interval's children: from its lower bound to its first minimum, then from each minimum on
    of = np.concatenate([k[opens], k])
    start = np.concatenate([lo[k[opens]], k])
    stop = np.concatenate([k[opens], ends])
    order = np.lexsort((start - stop, head[of]))  # the largest child first
    of, start, stop = of[order], start[order], stop[order]
    small = np.zeros(len(of), dtype=bool)
    small[1:] = head[of[1:]] == head[of[:-1]]
    of, start, stop = of[small], start[small], stop[small]
    return start, stop - start, lcp[of], lo[of], hi[of]


def _squares(s: np.ndarray, sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, most: int = 1 << 19
             ) -> tuple[np.ndarray, np.ndarray]:
    """End and period of all branching squares, ordered by end and period. ``sa`` and ``lcp``
    are those of the documents looked at, ``isa`` the slot in them (-1 elsewhere)."""
    n = len(s) - 1  # s ends in a word that occurs nowhere else
    start, size, depth, lo, hi = _children(lcp)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    found = [np.zeros((2, 0), dtype=np.int64)]
    for a, b in zip([0, *cuts], [*cuts, len(size)]):
        who = np.repeat(np.arange(a, b), size[a:b])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        i, d, low, high = sa[start[who] + nth], depth[who], lo[who], hi[who]
        for at in (i, i - d):  # a square at i: i + d is of the interval; one at i - d: i - d is
            other = np.minimum(at + d, n) if at is i else np.maximum(at, 0)
            inside = (at >= 0) & (isa[other] >= low) & (isa[other] < high)
            x, y = at[inside], d[inside]
            branching = s[x + y] != s[np.minimum(x + 2 * y, n)]
            found.append(np.stack([x + 2 * y, y])[:, branching])
    end, period = np.unique(np.concatenate(found, axis=1), axis=1) if len(found) > 1 else found[0]
    return end, period


def _rotated(s: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How often each square can be rotated by one word to the left."""
    times, open_, width = np.zeros(len(start), dtype=np.int64), np.arange(len(start)), 16
    while len(open_):
        width = max(1, min(width, (1 << 22) // len(open_)))
        at = (start[open_] - 1 - times[open_])[:, None] - np.arange(width)
        same = (at >= 0) & (s[np.maximum(at, 0)] == s[np.maximum(at, 0) + period[open_, None]])
        steps = np.where(same.all(axis=1), width, same.argmin(axis=1))
        times[open_] += steps
        open_ = open_[steps == width]
        width *= 4
    return times


def find_runs(symbols: np.ndarray, offsets: np.ndarray, min_length: int) -> np.ndarray:
    """Rows ``start, end, period`` of all runs of a slice of documents, ordered by start and
    period; no two documents share a symbol."""
    n, need = len(symbols), (min_length + 1) // 2
    none = np.zeros((0, 3), dtype=np.int64)
    if not n:
        return none
    sa, levels = _suffixes(symbols)
    level = need.bit_length() - 1
    if len(levels) <= level:
        return none
    ranks = levels[level][sa]
    k = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    k = k[_common(levels, sa[k - 1], sa[k]) >= need]
    # numbers of a document are contiguous, and so are its suffixes in the array
    docs = np.unique(np.searchsorted(offsets, k, side="right") - 1)
    if not len(docs):
        return none
    slots = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in docs])
    sa = sa[slots]
    lcp = np.zeros(len(sa), dtype=np.int64)
    lcp[1:] = _common(levels, sa[:-1], sa[1:])
    del levels
    isa = np.full(n + 1, -1, dtype=np.int64)
    isa[sa] = np.arange(len(sa))
    s = np.append(symbols, -1)
    end, period = _squares(s, sa, isa, lcp)
    runs = [none]
    while len(end):
        first = np.ones(len(end), dtype=bool)
        first[1:] = end[1:] != end[:-1]
        e, q = end[first], period[first]
        begin = e - 2 * q - _rotated(s, e - 2 * q, q)
        long = e - begin >= max(min_length, 1)
        runs.append(np.stack([begin, e, q], axis=1)[long])
        of = np.cumsum(first) - 1
        rest = ~first & (2 * period > (e - begin)[of])  # the others repeat the run's root
        end, period = end[rest], period[rest]
    found = np.concatenate(runs)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _finder(min_length: int, most_words: int):
    def slice_out(keys: list, texts: list[tuple[np.ndarray, list[bytes], int]]) -> pa.RecordBatch:
        sizes = np.array([len(t[0]) for t in texts], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        runs = find_runs(np.concatenate([t[0] for t in texts]), offsets, min_length)
        cuts = np.searchsorted(runs[:, 0], offsets)
        lists, collapsed = [], []
        for d, (ids, known, base) in enumerate(texts):
            own = runs[cuts[d]:cuts[d + 1]] - [offsets[d], offsets[d], 0]
            places = ids - base
            if len(own):
                gone = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 1], -1)
                places = places[np.cumsum(gone[:-1]) == 0]
            lists.append([{"start": a, "length": b - a, "period": q} for a, b, q in own.tolist()])
            collapsed.append(b" ".join([known[p] for p in places.tolist()]))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sizes), pa.array(lists, _RUNS),
             pa.array(collapsed, pa.binary()).view(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list = []
        words = base = 0
        for batch in batches:
            for key, seed, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      batch.column(2).cast(pa.binary())):
                ids, known = _numbered(raw.as_py() or b"", base)
                if seed is not None and len(ids):
                    ids = ids[repeating(len(ids), seed)]
                keys.append(key)
                texts.append((ids, known, base))
                base += len(known)
                words += len(ids)
                if words >= most_words or len(keys) >= 4096:
                    yield slice_out(keys, texts)
                    keys, texts, words, base = [], [], 0, 0
        if keys:
            yield slice_out(keys, texts)

    return find


def periodic_runs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_length: int = 12,
                  seed_col: str | None = None, slice_words: int = 100_000) -> DataFrame:
    """Per row of ``docs``: ``key, n_words, runs, collapsed``.

    ``runs`` lists ``start, length, period`` in words, by start and period; ``collapsed`` is the
    text without the words that a run holds after its first period, the others joined by one space.
    Words stand between ASCII white space and are compared as they are. A null or empty text has
    no words, no runs and collapses to "". Null keys and repeated rows are rows like others; other
    columns are ignored. Texts may be of any length (memory as above). Where ``seed_col`` is not null,
    the words are first made periodic by ``repeating``.
    """
    seed = F.col(seed_col).cast("long") if seed_col else F.lit(None).cast("long")
    return docs.select(F.col(key_col).cast("long").alias("key"), seed.alias("seed"), F.col(text_col).cast("string").alias(
        "text")).mapInArrow(_finder(min_length, slice_words), f"key long, n_words long, runs {RUNS}, collapsed string")
