import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import minhash
from marquee.llm.components import components
from marquee.llm.queries import op4_minhash_neardup


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(texts, ids, width, percent=80):
    sets = [shingles(t, width) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    met[j] += 1
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    names = defaultdict(list)
    for i in range(len(texts)):
        names[top(i)].append(ids[i])
    out = []
    for i in range(len(texts)):
        known = [k for k in names[top(i)] if k is not None]
        name = min(known) if known else None
        out.append((ids[i], len(sets[i]), name, ids[i] == name))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **kw).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = sorted((tuple(r) for r in op4_minhash_neardup(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([r.text for r in rows], [r.doc_id for r in rows], 2)


def test_edge_rows_and_chains(spark, make_docs, edge_texts):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts, text = list(edge_texts), [word() for _ in range(80)]
    for _ in range(25):  # a chain: far ends differ, neighbours are alike
        texts.append(" ".join(text))
        text = text[4:] + [word() for _ in range(4)]
    texts += ["Same words HERE now", "same words here now", "same  words\there\x0bnow"]
    ids = list(range(len(texts)))
    ids[2] = ids[20] = None
    base = [word() for _ in range(60)]
    for _ in range(40):  # a group whose members are linked to some of the others only
        texts.append(" ".join(w if rng.random() > 0.11 else word() for w in base))
    ids += range(len(ids), len(texts))
    for width, block in ((1, 60_000), (2, 100), (5, 100)):
        assert run(make_docs(texts, ids, parts=3), width=width, group_rows=2,
                   block_shingles=block) == brute(texts, ids, width)


def template_texts(n):
    rng, base = random.Random(4), "one short text that many pages share but for a single word".split()
    out = []
    for i in range(n):
        at = rng.randrange(1, 11)  # 7 of 15 or 9 of 13 shingles in common: not linked
        out.append(" ".join(base[:at] + [f"x{i}"] + base[at + 1:]))
    return out + [t + " end" for t in out[:50]]  # 11 of 12: linked


def test_template_texts_in_the_production_block(spark, make_docs):
    texts = template_texts(2500)
    assert run(make_docs(texts, parts=3), width=2) == brute(texts, list(range(len(texts))), 2)


def test_cells_are_bounded_by_rows(spark):
    apart = spark.range(5000).selectExpr("id % 3 AS bucket", "id AS h1", "11L AS n", "id AS root")
    cells = minhash._cells(apart, 60_000)
    assert cells.groupBy("a", "b").count().agg(F.max("count")).first()[0] <= 2 * 1025
    alone = cells.where("a = b").select("node").distinct()
    assert alone.count() == 5000


def test_cells_hold_bucket_mates_only(spark):
    rows = [(i // 2, i, 30, i) for i in range(400)] + [(1000 + i, j, 30, j) for i in range(40) for j in (i, 399 - i)]
    apart = spark.createDataFrame(rows, "bucket long, h1 long, n long, root long")
    cells = defaultdict(set)
    for r in minhash._cells(apart, 300).collect():
        cells[r.a, r.b].add(r.node)
    held = {frozenset((x, y)) for nodes in cells.values() for x in nodes for y in nodes}
    assert all(frozenset((a, b)) in held for k, a, *_ in rows for m, b, *_ in rows if k == m)
    asked = sum(len(v) for v in cells.values())
    assert asked <= 400 + 2 * 80


def test_production_block_at_width_2_and_5(spark, make_docs, edge_texts):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base, texts = [word() for _ in range(60)], list(edge_texts)
    texts += [" ".join(w if rng.random() > 0.11 else word() for w in base) for _ in range(40)]
    for width in (2, 5):
        assert run(make_docs(texts, parts=3), width=width, group_rows=2) == brute(texts, list(range(len(texts))), width)


def test_empty_table(spark, make_docs):
    assert run(make_docs(["x"]).where(F.lit(False))) == []


def test_every_coordinate_fills_and_estimates_are_close():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(a[:300]), np.unique(a[100:]), a[:1], a[:0]]
    s = minhash.sketches(sets, 480)
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.09


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}
    top = lambda i: i if parent.setdefault(i, i) == i else top(parent[i])
    for u, v in edges:
        a, b = top(u), top(v)
        parent[max(a, b)] = min(a, b)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: top(n) for n in nodes}
