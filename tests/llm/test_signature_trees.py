import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import signature_trees as trees
from marquee.llm.queries import op11_signature_join
from test_minhash import brute as linked
from test_minhash import template_texts


def brute(texts, ids, width=3, percent=90):
    return sorted([r[:3] for r in linked(texts, ids, width, percent)], key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in trees.linked_classes(docs, **kw).collect()), key=str)


def mixed_texts(edge_texts, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts, text = list(edge_texts), [word() for _ in range(150)]
    for _ in range(20):  # a chain: far ends differ, neighbours are alike
        texts.append(" ".join(text))
        text = text[4:] + [word() for _ in range(4)]
    texts += ["Same words HERE now", "same words here now", "same  words\there\x0bnow"] * 2
    base = [word() for _ in range(200)]
    for share in (0.01, 0.04):  # copies near and just beyond the threshold
        texts += [" ".join(w if rng.random() > share else word() for w in base) for _ in range(30)]
    for n in (1, 2, 3, 30, 33, 34, 64, 66):  # sizes around the powers of two
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join(base[:-1])]
    return texts


@pytest.mark.parametrize("kw", [{}, {"most_rows": 3, "most_shingles": 300}, {"bits": 4, "most_rows": 2},
                                {"width": 1, "percent": 80, "most_rows": 4}, {"width": 2, "percent": 100}])
def test_against_brute_force(spark, make_docs, edge_texts, kw):
    texts = mixed_texts(edge_texts)
    ids = list(range(len(texts)))
    ids[2] = ids[20] = ids[35] = None
    docs = make_docs(texts, ids, parts=3).withColumn("node", F.lit("x")).withColumn("mark", F.lit(1)).withColumn("_k", F.lit(2))
    assert run(docs, **kw) == brute(texts, ids, kw.get("width", 3), kw.get("percent", 90))


def test_large_groups_of_near_copies_and_of_unlinked_templates(spark, make_docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(own))
    texts += template_texts(150)
    assert run(make_docs(texts, parts=4), most_rows=16) == brute(texts, list(range(len(texts))))


def test_a_very_long_text(spark, make_docs):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10 ** 6)}" for _ in range(60_000)]
    texts = [" ".join(long), " ".join(long[:-100]), " ".join(long[20_000:]), "a b c"]
    assert run(make_docs(texts, parts=2)) == brute(texts, list(range(4)))


def test_the_bound_never_rules_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[:int(len(a) * rng.uniform(0.7, 1))],
                                      rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        truly = 100 * both >= 90 * (len(a) + len(b) - both)
        for exact in (False, True):
            out = ([], [])
            data = [s.tobytes() if exact else trees._bitmap(s, trees._width(len(s))).tobytes() for s in (a, b)]
            order = [0, 1] if len(a) <= len(b) else [1, 0]
            sizes = np.array([len(a), len(b)])[order]
            trees._join([data[i] for i in order], np.zeros(2, np.int64), np.array(order), np.zeros(2, np.int64),
                        np.array(order), sizes, 90, exact, out)
            assert len(out[0]) == 1 if truly else (not exact or not out[0])


def test_the_traversal_prunes_pairs_of_nodes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(400)]
    bits = np.stack([trees._bitmap(s, 512) for s in sets]).view(np.uint64)
    n = np.array([len(s) for s in sets])
    over = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    one = np.zeros(400, dtype=np.int64)
    forest = trees._levels(one, bits, n, over, np.arange(400), one + 3, np.zeros(400, dtype=bool))
    assert [len(t["grp"]) for t in forest] == [400, 50, 7, 1]
    assert sum(len(i) for i, _ in trees._traverse(forest, 90)) == 0
    joined = trees._levels(one, bits, n, over, one, one + 3, np.zeros(400, dtype=bool))
    assert len(trees._possible(joined[-1], np.array([0]), np.array([0]), 90)) == 0  # one component already


def test_empty_table_and_no_links(spark, make_docs):
    assert run(make_docs(["x"]).where(F.lit(False))) == []
    assert run(make_docs(["a b c d", None, "e f g h"])) == [(0, 2, 0), (1, 0, 1), (2, 2, 2)]


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = sorted((tuple(r) for r in op11_signature_join(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([r.text for r in rows], [r.doc_id for r in rows])


def test_sets_that_link_share_a_bucket():
    rng = np.random.default_rng(8)
    for percent in (80, 90, 97, 100):
        for _ in range(300):
            both, more = int(rng.integers(1, 500)), rng.random()
            apart = int(both * (100 - percent) / percent)  # the most that still links
            extra = int(apart * more)
            s = rng.permutation(np.unique(rng.integers(0, 1 << 64, both + apart, dtype=np.uint64)))
            a, b = np.sort(np.append(s[:both], s[both:both + extra])), np.sort(np.append(s[:both], s[both + extra:]))
            assert 100 * both >= percent * (both + apart)
            for bits in (4, 20):
                have = [np.concatenate([trees._contents(x, *c, bits) for c in trees._size_classes(len(x), percent)])
                        for x in (a, b)]
                assert len(np.intersect1d(*have))


def test_sets_that_share_some_shingles_do_not_meet():
    """Common shingles are in no bucket alone, so texts of one vocabulary make no groups."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(common, 300, replace=False), rng.integers(0, 1 << 64, 200, dtype=np.uint64)))
            for _ in range(400)]
    keys = np.concatenate([np.concatenate([trees._contents(s, *c, 20) for c in trees._size_classes(len(s), 90)]) for s in sets])
    _, members = np.unique(keys, return_counts=True)
    assert len(keys) > 20_000 and members[members > 1].sum() < 20


def test_buckets_are_shuffled_once_and_only_texts_of_candidates(spark, make_docs, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40)) for _ in range(60)]
    texts += [t + " one more" for t in texts[:9]]
    texts *= 3  # copies in several tasks
    plans, real, key = {}, trees.written, "spark.sql.autoBroadcastJoinThreshold"

    def written(df, name, *a):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *a)

    monkeypatch.setattr(trees, "written", written)
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert run(make_docs(texts, [*range(150), *[None] * 57], parts=5)) == brute(texts, [*range(150), *[None] * 57])
    finally:
        spark.conf.set(key, before)
    assert plans["met"].count("Exchange hashpartitioning") == 1
    assert plans["dealt"].count("Exchange hashpartitioning") == 0
    assert "BroadcastHashJoin" in plans["exact-links"]  # the bits that pick texts


def test_picked_texts_are_all_that_are_asked_for_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("key"), F.xxhash64("id").alias("mark"))
    picks = lambda d: trees._bits(d).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    asked = rows.limit(500)
    found = trees._picked(rows, picks(asked))
    assert asked.exceptAll(found).count() == 0 and found.count() < 600
    assert trees._picked(rows, picks(rows)).count() == 20_000
