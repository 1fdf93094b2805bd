import random
import re
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import runs
from marquee.llm.queries import op12_periodic_runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(s, least):
    out, n = [], len(s)
    for q in range(1, n // 2 + 1):
        j = 0
        while j + q < n:
            if s[j] != s[j + q]:
                j += 1
                continue
            i = j
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                if not any(all(s[x] == s[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(s, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(s) if i not in gone)


def random_words(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 90)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abc") for _ in range(n)]
    if kind == 2:
        return ["a"] * n
    if kind == 3:  # Fibonacci words hold runs in runs
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        return y[:n]
    if kind == 4:
        root = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        return [rng.choice("xy") for _ in range(rng.randrange(5))] + (root * 40)[:n] + [rng.choice("abcd") for _ in range(9)]
    return [f"w{rng.randrange(40)}" for _ in range(n)]


def test_slices_of_documents_against_brute_force():
    rng = random.Random(3)
    for least in (1, 2, 5, 12):
        for _ in range(60):
            docs = [random_words(rng) for _ in range(rng.randrange(1, 9))]
            coded, offsets = [], [0]
            for d, s in enumerate(docs):
                known = {}
                coded += [1000 * d + known.setdefault(w, len(known)) for w in s]
                offsets.append(len(coded))
            found = runs.find_runs(np.array(coded, dtype=np.int64), np.array(offsets), least)
            got = [(int(a), int(b - a), int(q)) for a, b, q in found]
            want = [(a + offsets[d], n, q) for d, s in enumerate(docs) for a, n, q in brute_runs(s, least)]
            assert got == sorted(want, key=lambda r: (r[0], r[2])), docs


def test_texts_edges_and_extra_columns(spark, make_docs, edge_texts):
    rng = random.Random(7)
    texts = list(edge_texts) + [" ".join(random_words(rng)) for _ in range(60)] + ["ab\x0bAb  ab\nab\tx " * 9, "x y " * 40]
    ids = list(range(len(texts)))
    ids[3] = ids[9] = None
    docs = make_docs(texts + texts[-4:], ids + ids[-4:], parts=3).withColumn("runs", F.lit(1)).withColumn("seed", F.lit("s"))
    for words in (100_000, 50):
        got = runs.periodic_runs(docs, slice_words=words).collect()
        want = []
        for i, t in zip(ids + ids[-4:], texts + texts[-4:]):
            s = words_of(t)
            if t and t.startswith("word word"):  # 3,000 equal words
                found = [(0, len(s), 1)]
            else:
                found = brute_runs(s, 12)
            want.append((i, len(s), found, collapse(s, found)))
        assert sorted(((r.key, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(
            want, key=str)


def test_a_very_long_text(spark, make_docs):
    root = [f"w{i * i % 7919}" for i in range(3000)]
    text = " ".join(["start"] + root * 60 + ["end"] + ["again"] * 50_000)
    r = runs.periodic_runs(make_docs([text])).first()
    q = next(q for q in range(1, 3001) if 3000 % q == 0 and root == root[:q] * (3000 // q))
    assert [tuple(x) for x in r.runs if x.length > 1000 and x.period in (1, q)] == [
        (1, 180_000, q), (180_002, 50_000, 1)]
    inner = brute_runs(root[:q] * 3, 12)  # what lies within the root repeats with it
    assert {x.period for x in r.runs} == {1, *(p for _, _, p in inner)}


def test_numbering_in_parts():
    raw = " ".join(f"w{i % 50}" for i in range(4000)).encode() + b"\n "
    whole = runs._numbered(raw, 5)
    parts = runs._numbered(raw, 5, most=37)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]


def test_empty_table(spark, make_docs):
    assert runs.periodic_runs(make_docs(["x"]).where(F.lit(False))).collect() == []


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    planted = 0
    for row in rows:
        s = words_of(row.text)
        h = zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and s:
            g, n = h // 10, len(s)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            s = [w if i < a else s[a + (i - a) % p] for i, w in enumerate(s)]
            planted += 1
        if len(s) > 1500:
            continue
        found = brute_runs(s, 12)
        r = got[row.doc_id]
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapse(s, found).encode()).hexdigest()
    assert planted > 5
