"""Binary token shards with a minimal perfect hash index from document key to place.

Format (a folder, written and read by Spark, so it lies wherever Spark writes):

* ``shards``: one row per shard: ``part, seq`` (order), ``base`` (ids of the part
  before it), ``n_ids``, ``keys`` / ``ends`` (its documents in ascending key order
  and where each ends), ``payload`` (raw little-endian unsigned 32-bit ids).
* ``parts``: ids before each part.
* ``index``: minimal perfect hashes over bounded groups of keys. A group keeps the
  bit levels of the hash and, by slot, a stored 32-bit fingerprint, shard, offset
  and length; a key costs one group, a few bit probes and one slot.

The texts are shuffled once, by ranges of the key; ids are made after that shuffle
and written at once. Nothing is collected; a shard holds about ``shard_ids`` ids (a
longer document is a shard of its own), an index group about ``group_keys`` keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = ("part int, seq int, base long, n_ids long, keys array<long>, ends array<long>, payload binary")
INDEX = ("grp int, n_keys int, sizes array<long>, bits binary, prints binary, "
         "parts binary, seqs binary, offsets binary, lengths binary")
PLACE = "key long, copy int, part int, seq int, offset long, n long"
_SHARD_TYPES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()),
                          ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def _writer(tokenizer: str, prefix: str, end_id: int | None, shard_ids: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from marquee.llm.words import tokenizers_encoder
        encoder = tokenizers_encoder(tokenizer, prefix)
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        keys, ends, chunks, size = [], [], [], 0

        def shard():
            row = {"part": [part], "seq": [seq], "base": [base], "n_ids": [size // 4], "keys": [keys],
                   "ends": [ends], "payload": [b"".join(chunks)]}
            return pa.RecordBatch.from_pydict(row, schema=_SHARD_TYPES)

        for batch in batches:
            key = batch.column(0)
            for at, found, offsets in encoder.encode(batch.column(1)):
                places = offsets.tolist()
                for k, a, b in zip(key.slice(at, len(places) - 1).to_pylist(), places, places[1:]):
                    ids = found[a:b].tobytes()
                    keys.append(k)
                    chunks.append(ids + end)
                    size += len(ids) + len(end)
                    ends.append(size // 4)
                    if size >= 4 * shard_ids:
                        yield shard()
                        seq, base = seq + 1, base + size // 4
                        keys, ends, chunks, size = [], [], [], 0
        if keys:
            yield shard()

    return encode


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser with a seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _key_hash(key: np.ndarray, copy: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(key.astype(np.uint64), 1) + _mix(copy.astype(np.uint64), 2) * np.uint64(3)


def mph_build(hashes: np.ndarray, load: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(level sizes, bits): keys alone in their cell of a level settle there, the
    others go on to the next level. ``hashes`` are distinct."""
    sizes, bits, left, level = [], [], hashes, 0
    while len(left):
        size = max(8, int(load * len(left)))
        at = (_mix(left, 100 + level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def mph_slots(hashes: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Slot of every hash (0..n-1, one to one over the keys built from); -1 where no level has it."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out = np.full(len(hashes), -1, dtype=np.int64)
    open_, start = np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        at = start + (_mix(hashes[open_], 100 + level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return out


def _build_group(table: pa.Table) -> pa.Table:
    col = {n: table[n].combine_chunks().to_numpy(zero_copy_only=False) for n in table.column_names}
    hashes = _key_hash(col["key"], col["copy"])
    sizes, bits = mph_build(hashes)
    slot = mph_slots(hashes, sizes, bits)
    prints = (_mix(hashes, 7) >> np.uint64(32)).astype(np.uint32)

    def by_slot(values, kind):
        out = np.empty(len(slot), dtype=kind)
        out[slot] = values
        return [out.tobytes()]

    return pa.table({
        "grp": pa.array([int(col["grp"][0])], pa.int32()), "n_keys": pa.array([len(slot)], pa.int32()),
        "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "prints": pa.array(by_slot(prints, "<u4"), pa.binary()),
        "parts": pa.array(by_slot(col["part"], "<i4"), pa.binary()),
        "seqs": pa.array(by_slot(col["seq"], "<i4"), pa.binary()),
        "offsets": pa.array(by_slot(col["offset"], "<i8"), pa.binary()),
        "lengths": pa.array(by_slot(col["n"], "<i8"), pa.binary())})


def _find_group(keys: pa.Table, index: pa.Table) -> pa.Table:
    key = keys["key"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    copy = keys["copy"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32)
    found = {n: np.zeros(0, dtype=t) for n, t in (("part", "i4"), ("seq", "i4"), ("offset", "i8"), ("n", "i8"))}
    ok = np.zeros(len(key), dtype=bool)
    if index.num_rows and len(key):
        row = index.slice(0, 1).to_pylist()[0]
        sizes = np.array(row["sizes"], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        hashes = _key_hash(key, copy)
        slot = mph_slots(hashes, sizes, bits)
        prints = np.frombuffer(row["prints"], "<u4")
        ok = (slot >= 0) & (prints[slot] == (_mix(hashes, 7) >> np.uint64(32)).astype(np.uint32))
        at = slot[ok]
        found = {"part": np.frombuffer(row["parts"], "<i4")[at], "seq": np.frombuffer(row["seqs"], "<i4")[at],
                 "offset": np.frombuffer(row["offsets"], "<i8")[at], "n": np.frombuffer(row["lengths"], "<i8")[at]}
    return pa.table({"key": pa.array(key[ok], pa.int64()), "copy": pa.array(copy[ok], pa.int32()),
                     "part": pa.array(found["part"], pa.int32()), "seq": pa.array(found["seq"], pa.int32()),
                     "offset": pa.array(found["offset"], pa.int64()), "n": pa.array(found["n"], pa.int64())})


def _group_of(n_groups: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(n_groups)).cast("int")


def write(docs: DataFrame, path: str, tokenizer: str, key_col: str = "doc_id", text_col: str = "text",
          prefix: str = " ", end_id: int | None = None, shard_ids: int = 1 << 18, group_keys: int = 50_000) -> str:
    """Encode, write shards in ascending key order, then their index; returns ``path``.

    A null text is empty (it still has the end id). Rows with equal keys are all
    kept, in order of their text, as copies 0, 1, ... of the key. Rows with a null
    key come first; they can be read by place but have no entry in the index.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(F.col(key_col).cast("long").alias("key"), text.alias("text"))
    order = [F.col("key"), F.xxhash64("text")]
    (placed.repartitionByRange(*order).sortWithinPartitions(*order, "text")
     .mapInArrow(_writer(tokenizer, prefix, end_id, shard_ids), SHARDS)
     .write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(f"{path}/shards"))
    shards = read_shards(spark, path)
    # one row per part: as many as the shuffle had partitions, however large the data
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")

    entries = (shards.select("part", "seq", F.posexplode(F.arrays_zip("keys", "ends")).alias("i", "d"), "ends")
               .select("part", "seq", F.col("d.keys").alias("key"),
                       F.when(F.col("i") > 0, F.col("ends")[F.col("i") - 1]).otherwise(F.lit(0)).alias("offset"),
                       F.col("d.ends").alias("end"))
               .where(F.col("key").isNotNull()))
    copies = Window.partitionBy("key").orderBy("part", "seq", "offset", "end")
    entries = entries.select("key", (F.row_number().over(copies) - 1).alias("copy"), "part", "seq", "offset",
                             (F.col("end") - F.col("offset")).alias("n"))
    n_keys = shards.select(F.sum(F.size("keys"))).first()[0] or 0
    n_groups = max(1, -(-int(n_keys) // group_keys))
    (entries.withColumn("grp", _group_of(n_groups)).groupBy("grp").applyInArrow(_build_group, INDEX)
     .write.option("compression", "zstd").parquet(f"{path}/index-{n_groups}"))
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path}/shards")


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    name = next(s.getPath().getName() for s in names if s.getPath().getName().startswith("index-"))
    return spark.read.schema(INDEX).parquet(f"{path}/{name}"), int(name.rpartition("-")[2])


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """Places ``key, copy, part, seq, offset, n`` of the ``key, copy`` rows that the
    store has (each once); other keys return no row, but for a chance of 2^-32 each
    that a fingerprint agrees, which :func:`fetch` then finds out."""
    index, n_groups = _index(keys.sparkSession, path)
    asked = keys.where(F.col("key").isNotNull()).select(F.col("key").cast("long"), F.col("copy").cast("int")).distinct()
    return (asked.withColumn("grp", _group_of(n_groups)).groupBy("grp")
            .cogroup(index.groupBy("grp")).applyInArrow(_find_group, PLACE))


def fetch(keys: DataFrame, path: str) -> DataFrame:
    """``key, copy, ids`` of the asked rows, sliced out of their shards' payloads."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cut(payload, offset, n):
        import pandas as pd
        return pd.Series([np.frombuffer(p, "<u4", c, 4 * o).astype(np.int64)
                          for p, o, c in zip(payload, offset, n)])

    places = lookup(keys, path)
    shards = read_shards(keys.sparkSession, path).select("part", "seq", "keys", "payload")
    return (places.join(shards, ["part", "seq"]).where(F.array_contains("keys", F.col("key")))
            .select("key", "copy", cut("payload", "offset", "n").alias("ids")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1)
            payload = memoryview(r.column("payload")[0].as_buffer())
            ends = np.array(r.column("ends")[0].as_py(), dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(payload[4 * a:4 * b]) for a, b in zip(starts, ends)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r.column("part")[0].as_py()), pa.int32()),
                 pa.array(np.full(n, r.column("seq")[0].as_py()), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(starts + r.column("base")[0].as_py(), pa.int64()),
                 pa.array(ends - starts, pa.int64()), r.column("keys").flatten(), pa.array(crc, pa.int64())],
                names=["part", "seq", "offset", "start", "n", "key", "crc"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document, in one scan of the payloads: its place, ``start`` (ids of
    all documents before it), ``n`` ids, key and the unsigned CRC-32 of its bytes."""
    found = read_shards(spark, path).select("part", "seq", "base", "keys", "ends", "payload").mapInArrow(
        _digests, "part int, seq int, offset long, start long, n long, key long, crc long")
    before = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    return (found.join(F.broadcast(before), "part")  # one row per part
            .select("part", "seq", "offset", (F.col("start") + F.col("before")).alias("start"), "n", "key", "crc"))
