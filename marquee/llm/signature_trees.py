"""Exact Jaccard join of word n-gram sets by signature trees.

*Signature*: a set of n shingle hashes as a bitmap of about 2n bits (a power of two; folding
halves gives the bitmap of half the width). A bit of ``a`` that ``b`` lacks is at least one shingle
that ``b`` lacks, so ``|a & b| <= (n_a - bits_a) + popcount(a & b)``.

*Tree*: rows of one group, ordered by size, are the leaves; a node over eight nodes holds the OR
of their bitmaps, the range of their sizes, the largest ``n - bits`` and the range of their
components. Trees are traversed in pairs from the roots down: a pair of nodes goes if the sizes are
too different, if all below is in one component already, or if the largest possible overlap,
from the two bitmaps and sizes, is less than the smallest that a link needs.

*Which rows meet*: the hashes' range is dealt into buckets, more of them than the shingles in which two sets that link
can differ, so such sets hold the same shingles in at least one. How many that is depends on their sizes: a size
class reaches to 100 / percent of its least size, a set that links lies in the same class or the next, and a set is dealt
by the bounds of its own class and of the one below. So a group is a class, a bucket and its contents, and the sets that have
it; sets that merely share some shingles do not meet, however many texts there are. Groups of the same members count once.

The same join runs twice: over the groups with bitmaps alone, which leaves *candidates* (a
spanning set of the pairs that the bound lets pass), and over the components of the
candidates with the full sets, where a pair that the trees let pass is compared exactly. No link is lost:
all linked sets meet in a group, pass the bound, and so lie in one candidate component.

What is shuffled: a row per bucket once, by its contents (a set comes from every task that has it; what is alone in
its group goes no further), bitmaps of what met, and the texts of candidates. These are picked from all texts by a table of
bits of bounded size that every task has, so texts that are no candidates stay where they are.

Scale: equal sets are one class from the start, so copies are never compared. Small groups are dealt
over cells of bounded size, many in each. A larger group is dealt over several cells with its
smallest class as a guest in all: what links to it is one component after the first pass, whatever
the size of the group. In a second pass the rest of the group meets all of it, cell by cell; for a
large group without links, such as texts of one template just below the threshold, this pass is quadratic. Pairs are
never written, a cell gives a spanning set of its links. Texts, sets and components never reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.hashing import mix, text_slices
from marquee.llm.minhash import shingle_sets
from marquee.session import written

FAN = 8
WIDEST = 1 << 14  # bits of a bitmap; larger sets fill it more densely
PICKS = 1 << 17  # rows of 64 bits that pick texts: if they fill up, more texts than needed pass


# ------------------------------------------------------------ sets and buckets
def _set_hash(s: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(s, seed).sum(dtype=np.uint64) + np.uint64(len(s)), seed).astype(np.int64))


def _size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """The class of size n and the one below, each with its number of buckets: one more than
    the shingles in which two sets that link can differ, the smaller of them in that class."""
    least, number, found = 1, 0, []
    while least <= n:
        if percent == 100 and least < n - 1:
            least = number = n - 1  # every size is a class
        largest = 100 * least // percent
        differ = (100 - percent) * (largest + 100 * largest // percent) // (100 + percent)
        found.append((number, differ + 1))
        least, number = largest + 1, number + 1
    return found[-2:]


def _contents(s: np.ndarray, number: int, buckets: int, bits: int) -> np.ndarray:
    """Hashes of the contents of a set's buckets, which are runs of 2^bits slots of the hashes' range."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64(1 << bits) // np.uint64(buckets) << np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(mix(s, 500), out=sums[1:])
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        place = mix(np.arange(buckets, dtype=np.uint64) + (np.uint64(number) << np.uint64(40)), 501)
        return mix(sums[at[1:]] - sums[at[:-1]] + place, 502)


def _bitmap(s: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _width(n: int) -> int:
    return min(WIDEST, max(64, 1 << (2 * n - 1).bit_length()))


DEALT = "key long, mark long, n long, h1 long, h2 long, buckets array<long>, data binary"


def _dealer(width: int, seed: int, bits: int, percent: int):
    """Sizes and hashes of the sets; buckets and bitmap of every class of a task, once."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # at most the rows of the task
        for batch in batches:
            keys, marks, texts = (batch.column(i) for i in range(3))
            for row, data, offsets in text_slices(texts):
                sets = shingle_sets(data, offsets, width)
                h1 = [_set_hash(s, 300 + 2 * seed) for s in sets]
                out: tuple[list, list] = ([], [])
                for s, h in zip(sets, h1):
                    n, buckets, bitmap = len(s), None, None
                    if n and h not in seen:
                        seen.add(h)
                        buckets = np.concatenate([_contents(s, *c, bits) for c in _size_classes(n, percent)]).view(np.int64)
                        bitmap = _bitmap(s, _width(n)).tobytes()
                    out[0].append(buckets)
                    out[1].append(bitmap)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, len(sets)), marks.slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(h1, pa.int64()), pa.array([_set_hash(s, 301 + 2 * seed) for s in sets], pa.int64()),
                     pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.binary())],
                    names=["key", "mark", "n", "h1", "h2", "buckets", "data"])

    return deal


# ---------------------------------------------------------------------- the trees
class _Union:
    def __init__(self, n: int):
        self.top = list(range(n))

    def find(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def labels(self) -> np.ndarray:
        top = np.array(self.top)
        while True:
            up = top[top]
            if (up == top).all():
                return top
            top = up


def _levels(grp, bits, n, over, comp, side, wide):
    """The forest, leaves first: per level the nodes' fields and each node's first child."""
    level = {"grp": grp, "bits": bits, "lo": n, "hi": n, "over": over, "lc": comp, "hc": comp, "side": side, "narrow": ~wide}
    out, start = [level], None
    while True:
        g = level["grp"]
        first = np.ones(len(g), dtype=bool)
        first[1:] = g[1:] != g[:-1]
        at = np.arange(len(g))
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        if not place.any():
            return out
        start = np.flatnonzero(place % FAN == 0)
        level = {"grp": g[start], "start": np.append(start, len(g)),
                 "bits": np.bitwise_or.reduceat(level["bits"], start, axis=0),
                 "side": np.bitwise_or.reduceat(level["side"], start), "narrow": np.logical_or.reduceat(level["narrow"], start),
                 **{f: np.minimum.reduceat(level[f], start) for f in ("lo", "lc")},
                 **{f: np.maximum.reduceat(level[f], start) for f in ("hi", "over", "hc")}}
        out.append(level)


def _possible(t: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Node pairs that may hold a link between two components."""
    ok = (percent * t["lo"][j] <= 100 * t["hi"][i]) & (percent * t["lo"][i] <= 100 * t["hi"][j])
    ok &= ~((t["lc"][i] == t["hc"][j]) & (t["hc"][i] == t["lc"][j]) & (t["lc"][i] == t["hc"][i]))
    ok &= ((t["side"][i] & 1) & (t["side"][j] >> 1) | (t["side"][i] >> 1) & (t["side"][j] & 1)).astype(bool)
    ok &= t["narrow"][i] | t["narrow"][j]
    k = np.flatnonzero(ok)
    x, y = i[k], j[k]
    both = np.bitwise_count(t["bits"][x] & t["bits"][y]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(t["hi"][x], t["hi"][y]), both + np.minimum(t["over"][x], t["over"][y]))
    return k[percent * (t["lo"][x] + t["lo"][y]) <= (100 + percent) * most]


def _below(t: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of node pairs; of a node with itself each pair once."""
    start = t["start"]
    ni, nj = start[i + 1] - start[i], start[j + 1] - start[j]
    of = np.repeat(np.arange(len(i)), ni * nj)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(ni * nj) - ni * nj, ni * nj)
    a, b = start[i[of]] + nth // nj[of], start[j[of]] + nth % nj[of]
    once = (i[of] != j[of]) | (a <= b)
    return a[once], b[once]


def _traverse(forest: list[dict], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that the dual traversal cannot prune, in bounded portions."""
    roots = np.arange(len(forest[-1]["grp"]))
    most = max(64, (1 << 21) // max(1, forest[0]["bits"].shape[1]))
    stack = [(len(forest) - 1, roots, roots)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > most:
            stack += [(depth, i[c:c + most], j[c:c + most]) for c in range(0, len(i), most)]
            continue
        t = forest[depth]
        if not depth:
            i, j = i[i != j], j[i != j]
        k = _possible(t, i, j, percent)
        if not len(k):
            continue
        if depth:
            stack.append((depth - 1, *_below(t, i[k], j[k])))
        else:
            yield i[k], j[k]


def _matcher(percent: int, exact: bool):
    """What the links of a cell join, as stars of roots: links between sets (``data``: their
    hashes), or between bitmaps, where a link means that the bound does not rule it out."""
    def match(table: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        keep = [i for i, d in enumerate(table["data"].to_pylist()) if d is not None]
        if len(keep) > 1:
            table = table.take(keep)
            grp, node, side, root, n = (table[c].to_numpy() for c in ("grp", "node", "side", "root", "n"))
            order = np.lexsort((side, node, n, grp))
            new = np.ones(len(order), dtype=bool)
            same = lambda a: a[order[1:]] == a[order[:-1]]
            new[1:] = ~(same(grp) & same(node) & same(side))
            order = order[new]
            _join([table["data"][int(i)].as_py() for i in order], grp[order], node[order], side[order], root[order],
                  n[order], percent, exact, out)
        return pa.table({"u": pa.array(out[0], pa.int64()), "v": pa.array(out[1], pa.int64())})

    return match


def _join(data, grp, node, side, root, n, percent, exact, out):
    roots, kind = np.unique(root, return_inverse=True)
    union = _Union(int(kind.max()) + 1)
    sets = [np.frombuffer(d, dtype=np.uint64) for d in data] if exact else None
    maps = [_bitmap(s, _width(len(s))) for s in sets] if exact else [np.frombuffer(d, dtype=np.uint8) for d in data]
    widths = np.array([8 * len(m) for m in maps])

    def link(pairs):
        for x, y in pairs:
            a, b = union.find(kind[x]), union.find(kind[y])
            if a == b:
                continue
            if exact:
                s, t = sets[x], sets[y]
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if 100 * both < percent * (len(s) + len(t) - both):
                    continue
            union.top[a] = b

    for width in np.unique(widths):
        rows = np.flatnonzero((widths == width) | (widths == 2 * width))  # others differ too much in size
        wide = widths[rows] != width
        bits = np.zeros((len(rows), width // 8), dtype=np.uint8)
        for k, (r, w) in enumerate(zip(rows, wide)):
            bits[k] = maps[r][:width // 8] | maps[r][width // 8:] if w else maps[r]
        bits = bits.view(np.uint64)
        over = n[rows] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        g = grp[rows]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sides = np.where(side[rows] == 0, 3, side[rows])
        if (side == 0).all():  # all of a group against its smallest class, which other cells have too
            least = np.minimum.reduceat(node[rows], first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            lead = np.flatnonzero(node[rows] == least[of])
            flat = _levels(np.arange(len(rows)), bits, n[rows], over, kind[rows], sides, wide)[0]
            pairs = np.arange(len(rows)), lead[of]
            k = _possible(flat, *pairs, percent)
            link(zip(rows[pairs[0][k]].tolist(), rows[pairs[1][k]].tolist()))
        forest = _levels(g, bits, n[rows], over, union.labels()[kind[rows]], sides, wide)
        for i, j in _traverse(forest, percent):
            for c in range(0, len(i), 2048):
                label = union.labels()[kind]
                x, y = rows[i[c:c + 2048]], rows[j[c:c + 2048]]
                apart = label[x] != label[y]
                link(zip(x[apart].tolist(), y[apart].tolist()))
    label = union.labels()  # what came together as a star around its smallest root
    first = np.full(len(roots), len(roots))
    np.minimum.at(first, label, np.arange(len(roots)))
    moved = np.flatnonzero(first[label] != np.arange(len(roots)))
    out[0].extend(roots[first[label[moved]]].tolist())
    out[1].extend(roots[moved].tolist())


# ---------------------------------------------------------------------- the join
def _linked(rows: DataFrame, groups: DataFrame, send: Callable[[DataFrame], DataFrame], percent: int, exact: bool,
            most_rows: int, most_weight: int, name: str) -> DataFrame:
    """``node, root`` of all that is linked within groups. ``rows``: grp, node, weight;
    ``groups``: grp, lead (smallest node), members, weight; ``send`` adds ``n, data`` to requests."""
    total = groups.agg(F.sum("members"), F.sum("weight")).first()
    if not total[0]:
        return rows.sparkSession.createDataFrame([], "node long, root long")
    batches = max(1, -(-total[0] // (8 * most_rows)), -(-total[1] // most_weight))
    salts = F.ceil(F.greatest(F.col("members") / most_rows, F.col("weight") / most_weight))
    groups = written(groups.select("grp", "lead", salts.alias("salts")), f"{name}-groups")
    deal = lambda c, m: F.pmod(F.xxhash64(c), m)
    one = F.col("salts") == 1
    within = rows.join(groups, "grp")
    whole = within.select(
        "grp", "node", F.col("node").alias("root"), F.lit(0).alias("side"),
        F.when(one, deal("grp", F.lit(batches))).otherwise(F.col("grp")).alias("cell"),
        F.when(one, F.lit(-1)).otherwise(deal("node", F.col("salts"))).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    guests = groups.where("salts > 1").select(
        "grp", F.col("lead").alias("node"), F.col("lead").alias("root"), F.lit(0).alias("side"), F.col("grp").alias("cell"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("a"), F.lit(-1).cast("long").alias("b"))

    def match(asked: DataFrame, step: str) -> DataFrame:
        return written(send(asked).groupBy("cell", "a", "b").applyInArrow(_matcher(percent, exact), "u long, v long"),
                       f"{name}-{step}")

    roots = written(components(match(whole.unionByName(guests), "links")), f"{name}-roots")
    large = groups.where("salts > 1")
    if not large.limit(1).count():
        return roots
    root = lambda d, c, out: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(out)), c, "left").withColumn(
        out, F.coalesce(out, c))
    placed = written(root(root(within.where("salts > 1").select("grp", "node", "weight", "lead", "salts"), "node", "root"),
                          "lead", "first"), f"{name}-placed")
    apart = placed.where("root <> first")
    lefts = written(apart.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / most_rows, F.sum("weight") / most_weight))
                                             .alias("lefts")), f"{name}-apart")
    if not lefts.limit(1).count():
        return roots
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = apart.join(lefts, "grp").select(
        "grp", "node", "root", F.lit(1).alias("side"), F.col("grp").alias("cell"), deal("node", F.col("lefts")).alias("a"),
        every("salts").alias("b"))
    right = placed.join(lefts, "grp").select(
        "grp", "node", "root", F.lit(2).alias("side"), F.col("grp").alias("cell"), every("lefts").alias("a"),
        deal("node", F.col("salts")).alias("b"))
    rest = match(left.unionByName(right), "rest")
    if not rest.limit(1).count():
        return roots
    tops = written(components(rest), f"{name}-tops")  # links of roots: a root of a root is the root
    joined = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    alone = tops.join(roots, "node", "left_anti")
    return joined.select("node", F.coalesce("top", "root").alias("root")).unionByName(alone.select("node", "root"))


def _setter(width: int, seed: int):
    """The full set of a request, where the text is of its class."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "node", "root", "side", "cell", "a", "b"]
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text"), most_bytes=1 << 20):
                found = shingle_sets(data, offsets, width)
                node = batch.column("node").slice(row, len(found)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, len(found)) for c in names] + [
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([s.tobytes() if _set_hash(s, 300 + 2 * seed) == h else None for s, h in zip(found, node)],
                                 pa.binary())], names=[*names, "n", "data"])

    return sets


REQUEST = "grp long, node long, root long, side int, cell long, a long, b long, n long, data binary"


def _bits(rows: DataFrame) -> DataFrame:
    """``rows`` with the place and the bit of their ``key, mark`` in a table of bits."""
    pick = F.xxhash64("key", "mark")
    nth = F.shiftright(pick, 17).bitwiseAND(F.lit(63)).cast("int")
    return rows.select("*", F.pmod(pick, F.lit(PICKS)).alias("at"),
                       F.call_function("shiftleft", F.lit(1).cast("long"), nth).alias("bit"))


def _picked(texts: DataFrame, picks: DataFrame) -> DataFrame:
    """All rows of ``texts`` whose bits are set in ``picks`` (at most ``PICKS`` rows), few others unless it is full."""
    return _bits(texts).join(F.broadcast(picks), "at").where("bit & bits <> 0").select(*texts.columns)


def linked_classes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
                   most_rows: int = 1024, most_shingles: int = 200_000, bits: int = 20, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: ``key, n_shingles, component_id``.

    A row's set: its distinct ``width``-word shingles (words between ASCII white space, A-Z lower-cased);
    with fewer words the whole sequence as one. Two rows link where 100 * intersection >= percent *
    union; ``component_id`` is the smallest key reachable by links, the own one included. Null and empty texts,
    and texts without words, have no shingles and no links: they are their own component. Rows with
    a null key are linked like others but lend no name: their component is named by its smallest key, and a component
    without any is null. Rows alike in key are one document when components are named. Other
    columns are ignored; texts may be of any length (a task holds the sets of one cell, or one longer set).
    Shingles are 64-bit hashes, ``bits`` of which deal them into buckets. Cells hold at most about ``most_rows`` rows of a group, or ``most_shingles``.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = written(texts.mapInArrow(_dealer(width, seed, bits, percent), DEALT), "dealt")
    classes = written(rows.where("n > 0").groupBy("h1").agg(
        F.min("key").alias("first"), F.min(F.struct("key", "mark")).alias("place"), F.min("n").alias("n"),
        F.min("h2").alias("lo"), F.max("h2").alias("hi")), "classes")
    if classes.where("lo <> hi").limit(1).count():  # two sets of one 64-bit hash
        return linked_classes(docs, key_col, text_col, width, percent, most_rows, most_shingles, bits, seed + 1)

    dealt = rows.where("buckets is not null").withColumnRenamed("h1", "node")
    held = dealt.select(F.explode("buckets").alias("grp"), "node", F.least("n", F.lit(WIDEST // 2)).alias("weight"))
    same = Window.partitionBy("grp")
    met = held.select("*", F.min("node").over(same).alias("least"), F.max("node").over(same).alias("most")).where("least < most")
    met = written(met.select("grp", "node", "weight").distinct(), "met")  # few of all: the rest goes no further
    groups = met.groupBy("grp").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("lead"), F.sum("weight").alias("weight"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    groups = written(groups.groupBy("members", "lead", "weight", "s1", "s2").agg(F.min("grp").alias("grp"))
                     .select("grp", "lead", "members", "weight"), "groups")  # groups of the same members once
    bitmaps = dealt.select("node", "n", "data").dropDuplicates(["node"])
    found = _linked(met, groups, lambda asked: asked.join(bitmaps, "node").select(
        *[c.split()[0] for c in REQUEST.split(", ")]), percent, False, most_rows, 8 * most_shingles, "candidates")
    near = written(found.join(classes.select(F.col("h1").alias("node"), F.col("n").alias("weight"), "place.*"), "node")
                   .select(F.col("root").alias("grp"), "node", "weight", "key", "mark"), "near")
    picks = written(_bits(near).groupBy("at").agg(F.bit_or("bit").alias("bits")), "picks")
    sizes = near.groupBy("grp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members"),
                                    F.sum("weight").alias("weight"))

    def with_sets(asked: DataFrame) -> DataFrame:
        asked = asked.join(near.select("node", F.col("key").alias("_k"), F.col("mark").alias("_m")), "node")
        return (_picked(texts, picks).join(asked, F.col("mark").eqNullSafe(F.col("_m")) & F.col("key").eqNullSafe(F.col("_k")))
                .select("grp", "node", "root", "side", "cell", "a", "b", "text").mapInArrow(_setter(width, seed), REQUEST))

    roots = _linked(near, sizes, with_sets, percent, True, most_rows, most_shingles, "exact")
    named = classes.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select(
        "h1", "first", F.coalesce("root", "h1").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    by_class = named.join(names, "root").select("h1", "name")
    joined = rows.select("key", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1")).join(by_class, "h1", "left")
    return joined.select("key", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("key")).alias("component_id"))
