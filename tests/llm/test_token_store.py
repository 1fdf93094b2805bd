import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import token_store, words
from marquee.llm.queries import op7_token_store, tokenizer_file

BYTE = tokenizer_file("byte_bpe_50k.json")


def reference(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


LETTERS = [" ", " ", "\n", "\t", "a", "B", "é", "\u0301", "1", "!", ",", "'s", "'", "İ", "Σ", "\x1c", "\x85", "\xa0",
           "\u2002", "漢", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\r", "\x00", "\u200b", "</w>", "word", "The", "\x01", ". ", "?!"]


@pytest.mark.parametrize("name,prefix", [("byte_bpe_50k.json", " "), ("word_bpe_49k.json", "")])
def test_parts_encode_as_the_whole_text_does(name, prefix, sample_texts, edge_texts):
    import random
    rng = random.Random(3)
    texts = sample_texts + [t or "" for t in edge_texts]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += [" ".join(rng.choice(LETTERS) + "x" * rng.choice([0, 1, 70]) for _ in range(9)) for _ in range(300)]
    texts += ["\n".join("one two, three" for _ in range(rng.randint(1, 4))) for _ in range(20)]
    rng.shuffle(texts)
    whole, plain = reference(tokenizer_file(name)), words.tokenizers_encoder(tokenizer_file(name), prefix)
    encoder = words.PartEncoder(plain.encode_many, prefix, max_bytes=20_000, folds=plain.folds, special=plain.special)
    assert plain.folds == (name == "word_bpe_49k.json") and "<|endoftext|>" in plain.special
    for start in range(0, len(texts), 7):
        some = texts[start:start + 7]
        assert encoder.ids(some) == [np.array(whole(text), "<u4").tobytes() for text in some]


def test_texts_without_spaces_are_not_kept():
    plain = words.tokenizers_encoder(tokenizer_file("byte_bpe_50k.json"), " ")
    encoder = words.PartEncoder(plain.encode_many, " ")
    whole = reference(tokenizer_file("byte_bpe_50k.json"))
    texts = ["".join(chr(0x4E00 + (i * 7919 + j * j) % 20000) for j in range(2000)) + " end" for i in range(40)]
    for i in range(0, 40, 8):
        assert encoder.ids(texts[i:i + 8]) == [np.array(whole(t), "<u4").tobytes() for t in texts[i:i + 8]]
    assert encoder.used < 5000 and len(encoder.first) + len(encoder.later) < 5


@pytest.mark.parametrize("name,prefix", [("byte_bpe_50k.json", " "), ("word_bpe_49k.json", "")])
def test_a_part_is_encoded_once_whatever_slice_it_is_in(name, prefix):
    whole, plain = reference(tokenizer_file(name)), words.tokenizers_encoder(tokenizer_file(name), prefix)
    asked = []
    encoder = words.PartEncoder(lambda some: asked.extend(some) or plain.encode_many(some), prefix, folds=plain.folds,
                                special=plain.special)
    texts = [None, "", "One two. Three", "a  b \n c\n\nd\ne", " é\u0301 H\u0331 naïve Été ", "x<|endoftext|> 12,5 one", " "] * 40
    for _ in range(2):
        for at, ids, ends in encoder.encode(pa.array(texts + ["one TWO three " * 50])):
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])][:len(texts) - at] == [
                whole(t or "") for t in texts[at:at + len(ends) - 1]]
    assert len(asked) == len(set(asked)) < 40


def test_single_words_go_to_the_model():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, path):
            self.real, self.whole_way = Tokenizer.from_file(path), []

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, strings, **more):
            self.whole_way += strings
            return self.real.encode_batch_fast(strings, **more)

    some = [" word", "Word", "wörd", " ÀÖØöøÿßx", " <|endoftext|>", "don't", "2", "日本", " İx", "a b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tokenizer = Counted(tokenizer_file(name))
        made = words._encode_many(tokenizer, ("<|endoftext|>",))(some)
        assert made == [reference(tokenizer_file(name))(s) for s in some]
        assert tokenizer.whole_way == some[4:]


def test_mph_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        hashes = token_store._key_hash(np.arange(n, dtype=np.int64) * 100, np.zeros(n, dtype=np.int32))
        sizes, bits = token_store.mph_build(hashes)
        assert sorted(token_store.mph_slots(hashes, sizes, bits)) == list(range(n))


def brute(texts, ids, end=2):
    encode, out, start = reference(BYTE), [], 0
    for key, text in sorted(zip(ids, texts), key=lambda p: -1 if p[0] is None else p[0]):
        raw = np.array(encode(text) + [end], "<u4").tobytes()
        out.append((key, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = [tuple(r) for r in op7_token_store(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == brute([r.text for r in rows], [r.doc_id for r in rows])


def test_edge_rows_and_fetch(spark, make_docs, edge_texts, folder):
    ids = [None if i == 3 else 5 if i in (8, 9) else 100 * i for i in range(len(edge_texts))]
    docs = make_docs(edge_texts, ids, parts=3)
    path = token_store.write(docs, f"{folder}/{uuid.uuid4().hex}", BYTE, end_id=2, shard_ids=64, group_keys=4)
    got = [(r.key, r.start, r.n, r.crc) for r in token_store.digests(spark, path).collect()]
    assert sorted(got, key=str) == brute(edge_texts, ids)
    asked = spark.createDataFrame([(5, 0), (5, 1), (5, 2), (1000, 0), (77, 0), (0, 0)], "key long, copy int")
    found = {(r.key, r.copy): list(r.ids) for r in token_store.fetch(asked, path).collect()}
    encode = reference(BYTE)
    assert found == {(5, 0): encode("tie") + [2], (5, 1): encode("tie") + [2], (0, 0): [2],
                     (1000, 0): encode(edge_texts[10]) + [2]}


def test_empty_table(spark, make_docs, folder):
    path = token_store.write(make_docs(["x"]).where(F.lit(False)), f"{folder}/{uuid.uuid4().hex}", BYTE, end_id=2)
    assert token_store.digests(spark, path).count() == 0
    assert token_store.lookup(spark.createDataFrame([(1, 0)], "key long, copy int"), path).count() == 0
