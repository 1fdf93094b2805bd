import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marquee.llm import bpe
from marquee.llm.queries import op8_byte_bpe, tokenizer_file

RANKS, PATTERN = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def whole():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_query_matches_the_library(spark, whole):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = []
    for r in rows:
        ids = whole(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_chunks_of_any_size_give_the_whole_texts_ids(spark, make_docs, edge_texts, sample_texts, whole):
    rng = random.Random(4)
    letters = [" ", " ", "  ", "\n", "\t", "a", "bc", "é", "12", "!", "'s", "'", "漢", "🙂", "\x85", "\xa0", " ", "\r\n"]
    texts = edge_texts + sample_texts[:40] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
                                              for _ in range(300)]
    texts += ["".join(rng.choice(letters[:8]) for _ in range(60)) + "y" * 90 + " z" * 30]
    ids = list(range(len(texts)))
    ids[5] = None
    for chunk, overlap in ((20, 6), (37, 30), (500, 100)):
        got = bpe.decode(bpe.encode(make_docs(texts, ids, parts=4), RANKS, PATTERN, chunk_chars=chunk,
                                    overlap=overlap), RANKS, PATTERN).collect()
        assert len(got) == len(texts)
        for r in got:
            text = texts[5 if r.key is None else r.key] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == whole(text) and bytes(r.bytes).decode() == text


def test_empty_table(spark, make_docs):
    assert bpe.encode(make_docs(["x"]).where(F.lit(False)), RANKS, PATTERN).count() == 0
