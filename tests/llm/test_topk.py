import math

from pyspark.sql import types as T

from marquee.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("rank", T.StringType()), T.StructField("weights", T.StringType())])


def brute(rows, k, every):
    w = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        f = [math.floor(64 * x) for x in v]
        w[i] = min(w.get(i, f), f)
    out = []
    for q in w:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k, every, **kw):
    v = topk.quantise(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(v.where(f"id % {every} = 0"), v, k=k, **kw).collect())


def test_against_brute_force_with_ties_blocks_and_odd_rows(spark):
    import random
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.3, 1.0]) for _ in range(6)], "x", "y") for i in range(300)]
    rows += [(400, None, "x", "y"), (410, [1.0, None], "x", "y"), (420, [float("nan")], "x", "y"),
             (430, [float("inf")], "x", "y"), (None, [1.0], "x", "y"), (440, [], "x", "y"), (450, [2.0, 3.0], "x", "y"),
             (460, [1.0] * 9, "x", "y"), (460, [1.0] * 9, "x", "y"), (460, [0.5] * 9, "x", "y"),
             (470, [1e9] * 9, "x", "y")]
    for kw in ({}, {"block_candidates": 40, "block_queries": 7, "chunk": 3}):
        assert run(spark, rows, 5, 10, **kw) == brute(rows, 5, 10)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0], "x", "y"), (1, [2.0], "x", "y")]
    assert run(spark, rows, 20, 1) == brute(rows, 20, 1)
    assert run(spark, rows[:1], 20, 1) == []
    assert run(spark, [], 20, 1) == []
