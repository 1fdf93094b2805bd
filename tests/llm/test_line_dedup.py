import hashlib

from pyspark.sql import functions as F

from marquee.llm import line_dedup
from marquee.llm.queries import op10_line_dedup


def brute(texts, ids):
    """(key, text) -> (kept text, lines, removed); rows alike in both are one document."""
    docs = sorted({(k, t) for k, t in zip(ids, texts)}, key=lambda d: (d[0] is not None, d[0]))
    seen, out = set(), {}
    for k, t in docs:
        lines = (t or "").split("\n")
        filled = [i for i, x in enumerate(lines) if x.translate({ord(c): None for c in " \t\r\x0b\x0c"})]
        gone = set()
        for j in range(len(filled) - 2):
            w = tuple(lines[i] for i in filled[j:j + 3])
            if w in seen:
                gone.update(filled[j:j + 3])
            seen.add(w)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[k, t] = (t if not gone else kept, 0 if t is None else len(lines), len(gone))
    return out


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = brute([r.text for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: r for r in op10_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        text, n, gone = want[r.doc_id, r.text]
        g = got[r.doc_id]
        assert (g.n_lines, g.n_removed, g.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_edge_rows(spark, make_docs, edge_texts):
    texts = edge_texts + ["a\nb\nc", "x\na\n\nb\nc\ny", "p\np\np\np\np\np", "a\nb\nc\nd", "a\nb\nc\nd", "b\nc\nd\n",
                          "q\nr\ns\nq\nr\ns", " a\nb\nc", "a\nb\n"]
    ids = list(range(len(texts)))
    ids[1] = None
    texts += ["x\na\n\nb\nc\ny"]  # the same row again
    ids += [ids[texts.index("x\na\n\nb\nc\ny")]]
    want = brute(texts, ids)
    docs = make_docs(texts, ids, parts=3)
    got = line_dedup.remove_repeats(docs.withColumn("orig", F.col("text"))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, r.orig]
        assert (r.key, r.part, r.lang) == (7, "x", "en")


def test_empty_table(spark, make_docs):
    assert line_dedup.remove_repeats(make_docs(["x"]).where(F.lit(False))).count() == 0
