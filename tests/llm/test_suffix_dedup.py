import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from marquee.llm import suffix_dedup
from marquee.llm.queries import op3_suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in op3_suffix_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r, want in zip(rows, brute([r.text for r in rows], 200)):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[:4], r.doc_id


def test_edge_rows_overlaps_and_long_texts(spark, make_docs, edge_texts):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé漢") for _ in range(n))
    shared = [word(rng.randint(3, 60)) for _ in range(6)]
    texts = list(edge_texts) + [word(rng.randint(0, 40)) + "".join(rng.choice(shared) + word(rng.randint(0, 9))
                                                                  for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["z" * 700, word(900), texts[20], "ab" * 40]
    ids = list(range(len(texts)))
    ids[4] = None
    ids[8] = ids[9]  # two equal rows
    for length, q, slice_bytes, group in ((24, 6, 1 << 20, 9), (24, 8, 64, 2), (9, 2, 50, 20_000)):
        got = suffix_dedup.remove_repeats(make_docs(texts, ids, parts=3).withColumn("row", F.col("text")), length=length,
                                          q=q, slice_bytes=slice_bytes, group_runs=group).collect()
        want = {(i, t): w for i, t, w in zip(ids, texts, brute(texts, length))}
        assert len(got) == len(texts)
        for r in got:
            w = want[r.doc_id, r.row]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w[:4]
            # the kept text has the kept bytes, and at most the touched characters besides
            assert r.part == "x" and len(w[4]) <= len(r.kept_text.encode()) <= len(w[4]) + 4 * w[2]
            assert "�" not in r.kept_text


def test_empty_table(spark, make_docs):
    assert suffix_dedup.remove_repeats(make_docs(["x"]).where(F.lit(False))).count() == 0
