import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import packing
from marquee.llm.queries import op2_bestfit_packing, tokenizer_file

WORD = tokenizer_file("word_bpe_49k.json")


def filled(counts, capacity):
    """Sequences of a plan, each as the sorted (offset, length) of its pieces."""
    rows, info = packing.plan(counts, capacity)
    got, seqs = Counter(), defaultdict(list)
    for size, first, n, seq, per, offset in rows:
        assert first == got[size]
        got[size] += n
        for i in range(n):
            seqs[seq + i // per].append((offset + i % per * size, size))
    assert got == Counter({s: c for s, c in counts.items() if c}) and len(seqs) == info["sequences"]
    for v in seqs.values():
        at = 0
        for offset, size in sorted(v):
            assert offset == at
            at += size
        assert at <= capacity
    return len(seqs), info


def fewest(sizes, capacity):
    """Exact number of sequences by branching over sequences (small cases)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                j = rooms.index(room)
                go(i + 1, rooms[:j] + [room - sizes[i]] + rooms[j + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_valid_and_close_to_the_fewest():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([7, 10, 16])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        n, _ = filled(Counter(sizes), capacity)
        assert n <= fewest(sizes, capacity) + 1 and n >= -(-sum(sizes) // capacity)


def test_reduction_alone_is_optimal():
    rng = random.Random(9)
    whole = 0
    for _ in range(600):
        sizes = [rng.randint(3, 12) for _ in range(rng.randint(1, 9))]
        n, info = filled(Counter(sizes), 12)
        if not info["best_fit"]:
            whole += 1
            assert n == fewest(sizes, 12)
    assert whole > 100


def test_large_counts():
    rng = random.Random(2)
    counts = Counter(min(4096, int(rng.lognormvariate(6.3, 1.1)) + 1) for _ in range(100_000)) + Counter({4096: 500})
    n, info = filled(counts, 4096)
    assert n <= -(-sum(s * c for s, c in counts.items()) // 4096) + 3 and info["reduced"] > 500


def check(got, texts, ids, capacity):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD)
    want = []
    for key, text in zip(ids, texts):
        own = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(own), capacity)):
            part = np.array(own[s:s + capacity], "<u4").tobytes()
            want.append((key, p, s, len(part) // 4, zlib.crc32(part)))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(w[3] for w in want) // capacity)


def test_query_over_the_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = op2_bestfit_packing(spark, "/root/testdata/sf0.001").collect()
    n, least = check(got, [r.text for r in rows], [r.doc_id for r in rows], 4096)
    assert n <= least + 1


def test_edge_rows(spark, make_docs, edge_texts):
    ids = [None if i == 3 else 5 if i in (8, 9) else 100 * i for i in range(len(edge_texts))]
    cut = packing.pieces(make_docs(edge_texts, ids, parts=3), WORD, capacity=16)
    got = packing.pack(cut, capacity=16, bucket_rows=9).collect()
    check(got, edge_texts, ids, 16)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack(cut.where(F.lit(False)), capacity=16).count() == 0
    with pytest.raises(ValueError):
        packing.pack(cut, capacity=8)


def test_pieces_of_a_column_with_nulls_and_long_texts(make_docs):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(WORD)
    texts = [None, "", " ", "One two. Three\nfour", "the word " * 30, "naïve É H\u0331", None] * 3
    got = packing.pieces(make_docs(texts, list(range(len(texts))), parts=2), WORD, capacity=16, with_ids=True).collect()
    found = defaultdict(bytes)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(found[r.doc_id]) // 4 and r.length == len(r.ids) // 4 <= 16 and r.ids_crc32 == zlib.crc32(r.ids)
        found[r.doc_id] += r.ids
    assert [found[i] for i in range(len(texts))] == [
        np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


def test_a_batch_asks_the_encoder_for_columns(monkeypatch):
    import pyarrow as pa

    from marquee.llm import words
    asked = []

    class Encoder(words.PartEncoder):
        def encode(self, texts):
            asked.append(len(texts))
            return super().encode(texts)

    monkeypatch.setattr(words, "tokenizers_encoder", lambda path, prefix: Encoder(lambda some: [[7] for _ in some], prefix))
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(["a b c"] * 700)], names=["k", "t"])
    out = pa.Table.from_batches(packing._pieces("x", "", 1, 4096, False)(iter([batch])))
    assert asked == [700] and out["length"].to_pylist() == [4] * 700  # one request a batch, not one every 256 rows
