import hashlib
import uuid
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.llm import sharding
from marquee.llm.queries import SHARDS, op9_sharding


def table(shards, size):
    """The same fill, turn by turn over explicit preference lists."""
    num = lambda s, salt: int(hashlib.md5(f"{salt}:{s}".encode()).hexdigest()[:15], 16)
    lists = [[(num(s, "offset") + i * (num(s, "skip") % (size - 1) + 1)) % size for i in range(size)] for s in shards]
    out, nxt, turn = {}, [0] * len(shards), 0
    while len(out) < size:
        s = turn % len(shards)
        while lists[s][nxt[s]] in out:
            nxt[s] += 1
        out[lists[s][nxt[s]]] = s
        turn += 1
    return [out[i] for i in range(size)]


def test_fill_is_even_and_moves_little():
    names = [f"s{i}" for i in range(7)]
    assert sharding.fill_table(names, 101) == table(names, 101)
    full = sharding.fill_table(SHARDS)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    less = sharding.fill_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, less) if a != len(SHARDS) - 1)
    assert moved < 0.2 * len(full)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_query_matches_brute_force(spark):
    full = sharding.fill_table(SHARDS)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = []
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 65537
        raw = r.text.encode()
        want.append((r.doc_id, slot, SHARDS[full[slot]], len(raw), zlib.crc32(raw)))
    assert sorted(tuple(r) for r in op9_sharding(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_edge_rows(spark, make_docs, edge_texts, folder):
    ids = [None if i in (1, 2) else 5 if i in (8, 9) else i for i in range(len(edge_texts))]
    docs = make_docs(edge_texts, ids, parts=3)
    path = sharding.write_shards(docs.withColumn("slot", F.lit("clash")), f"{folder}/{uuid.uuid4().hex}", ["a", "b", "c"],
                                 size=13, task_rows=2)
    schema = "doc_id long, text string, key long, part string, slot long, shard string"
    back = sharding.read_shards(spark, path, schema).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(zip(ids, edge_texts), key=str)
    assert len({r.shard for r in back if r.doc_id == 5}) == 1 and len({r.slot for r in back if r.doc_id is None}) == 1
    assert sharding.assign(docs.where(F.lit(False)), ["a"], size=13).count() == 0
