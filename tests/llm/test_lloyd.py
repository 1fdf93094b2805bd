import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from marquee.llm import lloyd

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("cluster", T.StringType()), T.StructField("chunk", T.StringType()),
                       T.StructField("id", T.StringType()), T.StructField("vec", T.StringType())])


def brute(rows, width, k, rounds, seed=1):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, name(r[0]) if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        who = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (w, _) in zip(kept, who) if w == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, w, d) for (i, _), (w, d) in zip(kept, assign())), key=str), cents


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(parts)


def run(spark, rows, width, k, rounds, **kw):
    found = lloyd.lloyd(lloyd.quantised(frame(spark, rows), "vec_id", "embedding", width), width, k, rounds, **kw)
    got = sorted((tuple(r) for r in found.assigned.collect()), key=str)
    sums = {}
    for _, c, d in got:
        sums[c] = sums.get(c, 0) + d
    assert {r.cluster: r.inertia for r in found.totals.collect()} == sums
    return got, found.centroids.tolist()


@pytest.mark.parametrize("width, block, chunk", [(8, 3, 7), (8, 16, 4096), (5, 1, 1)])
def test_against_brute_force(spark, width, block, chunk):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(i % 4, 1) * rng.choice([0.1, 1, 40]) for _ in range(width)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [0.0] * width)]  # repeated and null ids
    rows += [(900, None), (901, []), (902, [1.0] * (width + 1)), (903, [math.nan] * width), (904, [math.inf] * width),
             (905, [None] + [1.0] * (width - 1))]
    rows += [(1000 + i, [0.5] * width) for i in range(60)]  # ties: equal vectors
    assert run(spark, rows, width, 6, 3, block=block, chunk=chunk) == brute(rows, width, 6, 3)


def test_empty_centroids_stay(spark):
    rows = [(i, [0.25, 0.25]) for i in range(9)] + [(50, [9.0, 9.0])]
    assert run(spark, rows, 2, 4, 2) == brute(rows, 2, 4, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.0, 0.01])]
    assert run(spark, rows, 2, 16, 3) == brute(rows, 2, 16, 3)
    assert run(spark, [(1, None)], 2, 16, 3) == ([], [])


def test_distances_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], 2, 1, 1)


def test_query_matches_brute_force_and_sql(spark):
    import duckdb

    from marquee.llm.queries import REGISTERED
    fn, sql = REGISTERED["op13_dimension_lloyd"]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want, cents = brute([(r.vec_id, [float(x) for x in r.embedding]) for r in rows], 64, 16, 3)
    got = fn(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.cluster: r.centroid_sha256 for r in got} == {
        c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest() for c in {w[1] for w in want}}
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()) == sorted(
        tuple(r[n] for n in names) for r in got)
