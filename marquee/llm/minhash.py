"""Near-duplicate classes over word shingles: fast similarity sketches, banding,
exact verification.

*Sketch* (after Dahlgaard, Knudsen and Thorup): in each of ``t`` rounds every shingle
of a set is hashed into one of ``t`` coordinates with a value; a coordinate keeps the
smallest value of the first round that reached it. Rounds go on only until all are
filled; in rounds t .. 2t - 1 everything goes to one coordinate each, so every coordinate
is sure to fill, also from a single shingle. Agreeing coordinates are an unbiased,
concentrated estimate of the Jaccard similarity.

*Banding*: ``bands`` bands of ``rows`` coordinates; two sets meet where a band agrees.
A pair of similarity s misses every band with probability (1 - s^rows)^bands: at 0.8
with 60 x 8 that is 1.6e-5, at 0.85 3e-9, before other links of its group count.

*Verification* is exact, on the full sets, in two passes. Equal sets are one class from
the start (a 64-bit sum of mixed hashes, checked by a second one). In the first pass
each class meets the leader of its buckets. What is still in different components though
in one bucket meets in the second pass: such classes are laid in an order that puts bucket
mates together and cut into blocks; of each two blocks that a bucket spans, the sets of such
buckets are compared by one matrix product, and the links that join components come out, at most
one per class. So no pairs are written, and no link that banding found is lost.

Scale: a map task sends a class's bands once, so a group of copies of any size adds a
row per task and bucket; comparisons go to groups of at most ``group_rows`` members of
a leader, the leader's set repeated, and to blocks of about ``block_shingles`` shingles
and at most about ``block_rows`` classes, so memory is bounded however short the texts are.
The blocks a bucket spans are compared two by two: where many classes share a bucket without
being linked (texts of one template), time grows with the square of their number.
Links, components and texts never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.positions import running_totals
from marquee.llm.components import components
from marquee.llm.hashing import Prefix, mix, text_slices
from marquee.session import written

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text (words between white space
    of ASCII, A-Z lower-cased). Fewer words than ``width``: the whole sequence is one
    shingle; no words: none."""
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    cut = offsets[1:-1]
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = cut[cut < len(data)], cut[cut > 0] - 1
    begin[first] = inside[first]  # a text's start begins a word whatever stood before
    end[last] = inside[last]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        words = mix(Prefix(_LOWER[data]).span(starts, stops), 1) + mix((stops - starts).astype(np.uint64), 2)
        at = np.searchsorted(starts, offsets)
        joined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for i in range(width):
            joined = mix(joined ^ words[i:len(words) - width + 1 + i], 3) if len(joined) else joined
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                out.append(np.unique(joined[a:b - width + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for w in words[a:b]:
                    one = mix(np.array([one ^ w], dtype=np.uint64), 4)[0]
                out.append(np.array([one], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates per set (rows of empty sets are all ones)."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), top, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    open_ = np.flatnonzero(sizes)
    for r in range(2 * t):
        if not len(open_):
            break
        if r < 4 or r % 8 == 0 or len(open_) != n_open:
            values = np.concatenate([sets[i] for i in open_])
            owner = np.repeat(np.arange(len(open_)), sizes[open_])
            n_open = len(open_)
        h = mix(values, 10 + r)
        where = (h >> np.uint64(32)) % np.uint64(t) if r < t else np.full(len(h), r - t, dtype=np.uint64)
        round_ = np.full(len(open_) * t, top, dtype=np.uint64)
        np.minimum.at(round_, owner * t + where.astype(np.int64), mix(h, 5) >> np.uint64(1))
        round_ = round_.reshape(len(open_), t)
        mine = out[open_]
        out[open_] = mine = np.where(mine == top, round_, mine)
        open_ = open_[(mine == top).any(axis=1)]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2])
    for i in range(rows):
        h = mix(h ^ cut[:, :, i], 6)
    return h


def _set_hash(s: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(s, seed).sum(dtype=np.uint64) + np.uint64(len(s)), seed).astype(np.int64))


def _sketcher(width: int, bands: int, rows: int, seed: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes whose bands this task has sent: at most its own rows
        for batch in batches:
            keys, marks, texts = (batch.column(i) for i in range(3))
            for row, data, offsets in text_slices(texts):
                sets = shingle_sets(data, offsets, width)
                h1 = [_set_hash(s, 100 + 2 * seed) for s in sets]
                h2 = [_set_hash(s, 101 + 2 * seed) for s in sets]
                new = [i for i, s in enumerate(sets) if len(s) and not (h1[i] in seen or seen.add(h1[i]))]
                hashes = band_hashes(sketches([sets[i] for i in new], bands * rows), bands, rows).view(np.int64)
                lists: list = [[]] * len(sets)
                for i, h in zip(new, hashes):
                    lists[i] = h
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, len(sets)), marks.slice(row, len(sets)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()),
                     pa.array(h2, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["key", "mark", "n", "h1", "h2", "bands"])

    return sketch


def _router(width: int, seed: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for row, data, offsets in text_slices(texts, most_bytes=1 << 20):
                sets = shingle_sets(data, offsets, width)
                n = len(sets)
                node = batch.column("node").slice(row, n).to_pylist()
                same = [_set_hash(s, 100 + 2 * seed) == h for s, h in zip(sets, node)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, n) for c in ("node", "a", "b", "root")]
                    + [pa.array([s.tobytes() if ok else None for s, ok in zip(sets, same)], pa.binary())],
                    names=["node", "a", "b", "root", "shingles"])

    return route


def _verifier(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        node, a = table["node"].to_pylist(), table["a"][0].as_py()
        sets = {}
        for n, raw in zip(node, table["shingles"].to_pylist()):
            if raw is not None:
                sets[n] = np.frombuffer(raw, dtype=np.uint64)
        own, found = sets.pop(a, None), []
        for n, other in sets.items():
            both = len(np.intersect1d(own, other, assume_unique=True)) if own is not None else 0
            if own is not None and 100 * both >= percent * (len(own) + len(other) - both):
                found.append(n)
        return pa.table({"u": pa.array([a] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})

    return verify


def _joiner(percent: int, strip: int = 256):
    """Links between components within a cell, as a spanning set of them; one array holds
    all pairs of the cell (4 bytes each), whose rows are looked at in strips."""
    def join(table: pa.Table) -> pa.Table:
        sets, root = {}, {}
        for n, r, raw in zip(*(table[c].to_pylist() for c in ("node", "root", "shingles"))):
            if raw is not None:
                sets[n], root[n] = np.frombuffer(raw, dtype=np.uint64), r
        nodes, u, v = list(sets), [], []
        if len(set(root.values())) > 1:
            size = np.array([len(sets[n]) for n in nodes])
            owner = np.repeat(np.arange(len(nodes)), size)
            _, column, times = np.unique(np.concatenate([sets[n] for n in nodes]), return_inverse=True,
                                         return_counts=True)
            shared = times[column] > 1
            number = np.cumsum(times > 1) - 1
            owner, column = owner[shared], number[column[shared]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            both = np.zeros((len(nodes), len(nodes)), dtype=np.float32)  # counts, exact below 2^24
            for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
                i, j = np.searchsorted(column, (start, start + 2048))
                has = np.zeros((len(nodes), 2048), dtype=np.float32)
                has[owner[i:j], column[i:j] - start] = 1
                both += has @ has.T
            top = {r: r for r in root.values()}
            _, kind = np.unique([root[n] for n in nodes], return_inverse=True)

            def find(r):
                while top[r] != r:
                    top[r] = top[top[r]]
                    r = top[r]
                return r

            for start in range(0, len(nodes), strip):
                stop = start + strip
                part = both[start:stop].astype(np.float64)
                alike = 100 * part >= percent * (size[start:stop, None] + size[None, :] - part)
                alike &= kind[start:stop, None] != kind[None, :]
                for i, j in zip(*np.nonzero(np.triu(alike, start + 1))):
                    x, y = find(root[nodes[start + i]]), find(root[nodes[j]])
                    if x != y:
                        top[x] = y
                        u.append(nodes[start + i])
                        v.append(nodes[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return join


def _sent(asked: DataFrame, classes: DataFrame, texts: DataFrame, width: int, seed: int) -> DataFrame:
    """The sets of the asked classes ``node`` at the groups ``(a, b)`` that ask for them."""
    asked = asked.join(classes.select(F.col("h1").alias("node"), "place"), "node").select(
        "node", "a", "b", "root", F.col("place.key").alias("_k"), F.col("place.mark").alias("_m"))
    return (texts.join(asked, texts["mark"].eqNullSafe(asked["_m"]) & texts["key"].eqNullSafe(asked["_k"]))
            .select("node", "a", "b", "root", "text")
            .mapInArrow(_router(width, seed), "node long, a long, b long, root long, shingles binary"))


def _with_leaders(pairs: DataFrame, group_rows: int) -> DataFrame:
    """Requests of the pairs (leader a, member b): each leader in as many groups as its members need."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("salts"))
    members = pairs.join(sizes, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("b"))
    leaders = sizes.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("b"))
    return members.unionByName(leaders).withColumn("root", F.col("node"))


def _cells(apart: DataFrame, block_shingles: int, block_rows: int = 1024) -> DataFrame:
    """Requests of the rows ``(bucket, h1, n, root)``: of every two blocks with a bucket in common the classes
    of such buckets.
    A class fills at least a ``block_rows``-th of a block, so a block has at most one more."""
    least = -(-block_shingles // block_rows)
    near = Window.partitionBy("bucket")
    nodes = (apart.withColumn("near", F.min("h1").over(near)).groupBy("h1")
             .agg(F.min("n").alias("n"), F.min("root").alias("root"), F.min("near").alias("near")))
    laid = running_totals(nodes, [], ["near", "root", "h1"], F.greatest("n", F.lit(least)), "before")
    blocks = written(laid.select("h1", "root", F.floor(F.col("before") / block_shingles).alias("block")), "blocks")
    within = apart.select("bucket", "h1").join(blocks, "h1")
    spans = within.groupBy("bucket").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    sides = (within.join(spans, "bucket").select("h1", "root", "block", "blocks").distinct()
             .select("h1", "root", "block", F.explode("blocks").alias("other")).distinct())
    return sides.select(F.col("h1").alias("node"), F.least("block", "other").alias("a"),
                        F.greatest("block", "other").alias("b"), "root")


def _sketched(docs: DataFrame, key_col: str, text_col: str, width: int, percent: int, bands: int, rows: int,
              group_rows: int, block_shingles: int, seed: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Per row ``key, mark, n, h1`` (its class, where it has shingles), and per class ``h1, first, root``:
    its smallest key and its component."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketched = written(texts.mapInArrow(
        _sketcher(width, bands, rows, seed),
        "key long, mark long, n long, h1 long, h2 long, bands array<long>"), "sketches")
    full = sketched.where("n > 0")
    classes = written(full.groupBy("h1").agg(
        F.min("key").alias("first"), F.min(F.struct("key", "mark")).alias("place"), F.min("n").alias("n"),
        F.min("h2").alias("lo"), F.max("h2").alias("hi")), "classes")
    if classes.where("lo <> hi").limit(1).count():  # two sets of one 64-bit hash
        return _sketched(docs, key_col, text_col, width, percent, bands, rows, group_rows, block_shingles, seed + 1,
                         block_rows)

    in_bucket = Window.partitionBy("bucket")
    met = written(full.select(F.explode("bands").alias("bucket"), "h1", "n")
                  .withColumn("lead", F.min(F.struct("h1", "n")).over(in_bucket))
                  .withColumn("last", F.max("h1").over(in_bucket))
                  .where(F.col("lead.h1") != F.col("last")).select("bucket", "h1", "n", "lead").distinct(), "met")
    alike = lambda a, b: (5 * F.least(a, b) * 20 >= percent * F.greatest(a, b))
    stars = written(met.where(F.col("h1") != F.col("lead.h1")).where(alike(F.col("n"), F.col("lead.n")))
                    .select(F.col("lead.h1").alias("a"), F.col("h1").alias("b")).distinct(), "stars")
    links = written(_sent(_with_leaders(stars, group_rows), classes, texts, width, seed)
                    .groupBy("a", "b").applyInArrow(_verifier(percent), "u long, v long"), "star-links")
    roots = written(components(links), "roots")

    placed = met.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select(
        "bucket", "h1", "n", F.coalesce("root", "h1").alias("root"))
    apart = written(placed.withColumn("lo", F.min("root").over(in_bucket)).withColumn("hi", F.max("root").over(in_bucket))
                    .where("lo <> hi").select("bucket", "h1", "n", "root"), "apart")
    if apart.limit(1).count():
        more = written(_sent(_cells(apart, block_shingles, block_rows), classes, texts, width, seed)
                       .groupBy("a", "b").applyInArrow(_joiner(percent), "u long, v long"), "cell-links")
        if more.limit(1).count():
            roots = written(components(links.unionByName(more)), "roots")

    named = classes.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select(
        "h1", "first", F.coalesce("root", "h1").alias("root"))
    return sketched.select("key", "mark", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1")), named


def near_duplicates(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, bands: int = 60, rows: int = 8, group_rows: int = 256,
                    block_shingles: int = 60_000, seed: int = 0, block_rows: int = 1024) -> DataFrame:
    """Per row of ``docs``: ``key, n_shingles, component_id, kept``.

    Sets are linked where 100 * intersection >= percent * union; ``component_id`` is the
    smallest key reachable by links, the own one included; ``kept`` says that it is the
    own one. A null or empty text has no shingles and no links: it is its own component.
    Rows with a null key are linked like others but lend no name: their component is
    named by its smallest key, and a component without any is null and kept. Rows alike
    in key are one document when components are named; ``one_of_each`` goes by rows.
    """
    sketched, named = _sketched(docs, key_col, text_col, width, percent, bands, rows, group_rows, block_shingles, seed,
                                block_rows)
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    by_class = named.join(names, "root").select("h1", "name")
    joined = sketched.select("key", "n", "h1").join(by_class, "h1", "left")
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("key"))
    return joined.select("key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("key").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 5,
                percent: int = 80, bands: int = 60, rows: int = 8, group_rows: int = 256,
                block_shingles: int = 60_000, seed: int = 0, block_rows: int = 1024) -> DataFrame:
    """The rows of ``docs``, of each component of linked rows exactly one: the smallest key
    (null last), of rows alike in key the smallest text hash, of rows alike in both the
    smallest row. Rows without shingles are linked to nothing and all stay.

    A row is known by key and text hash; only what goes or is there several times is
    joined with the rows, which are not written again."""
    sketched, named = _sketched(docs, key_col, text_col, width, percent, bands, rows, group_rows, block_shingles, seed,
                                block_rows)
    place = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    best = (sketched.where("n > 0").groupBy("h1").agg(F.min(place).alias("place")).join(named.select("h1", "root"), "h1")
            .groupBy("root").agg(F.min("place").alias("place"))
            .select(F.col("place.key").alias("_k"), F.col("place.mark").alias("_m"), F.lit(True).alias("stays")))
    same = lambda d: d["key"].eqNullSafe(F.col("_k")) & (d["mark"] == F.col("_m"))
    copies = sketched.where("n > 0").groupBy("key", "mark").agg(F.count(F.lit(1)).alias("copies"))
    odd = written(copies.join(best, same(copies), "left").where("stays IS NULL OR copies > 1")
                  .select(F.col("key").alias("_k"), F.col("mark").alias("_m"), "stays"), "not-kept")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(key_col).cast("long").alias("key"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    once = row.join(odd, same(row), "left_anti").select("row.*")
    again = row.join(odd.where("stays"), same(row), "left_semi").groupBy("key", "mark").agg(F.min("row").alias("row"))
    return once.unionByName(again.select("row.*"))
