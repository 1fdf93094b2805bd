"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size:
slot (offset + i * skip) mod size for i = 0, 1, ..., with offset and skip hashed from
its name (size is prime, so each order visits every slot). The shards take turns
claiming the first slot of their order that is still free until the table is full, so
each holds size / shards slots to within one, and a shard that leaves gives up its own
slots while the others' barely move. A key's slot is its hash modulo the size.

The table has ``size`` entries whatever the data (65,537 by default) and travels to
the tasks as a broadcast of that proven size; a placement is one hash and one lookup.
A shard's rows are written by as many tasks as salts, so no shard, and no source, is
one task; the salt only decides which of a shard's files a row is in.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = 65_537) -> list[int]:
    """The number (place in ``shards``) of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % max(1, size - 1) + 1 for s in shards]
    table = [-1] * size
    claimed = 0
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: Column | str, size: int = 65_537) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo ``size``. A null key has
    the slot of the empty string."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("long")


def assign(df: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = 65_537) -> DataFrame:
    """``df`` plus ``slot`` and ``shard`` (the name; columns of these names are replaced).
    Equal keys go to the same shard; every row is kept, whatever is null or repeated."""
    table = fill_table(shards, size)
    spark = df.sparkSession
    entries = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot long, shard string")
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(key_col, size))
    return (placed.join(F.broadcast(entries), "slot")  # size entries, whatever the data
            .select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard"))


def write_shards(df: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", size: int = 65_537,
                 task_rows: int = 20_000) -> str:
    """Write the placed rows as Parquet, one ``shard=...`` folder each, and return
    ``path``. As many tasks write a shard together as leave each about ``task_rows`` rows; rows are dealt
    to them by a hash of the whole row, so a key that many rows have is no task of its own."""
    salts = max(1, -(-df.count() // (len(shards) * task_rows)))
    placed = assign(df, shards, key_col, size)
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(salts))
    (placed.repartition(len(shards) * salts, "shard", salt).write.partitionBy("shard").option("compression", "zstd").parquet(path))
    return path


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all shards with their ``shard``; ``schema`` as written."""
    return spark.read.schema(schema).parquet(path)
