import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import quality
from marquee.llm.queries import op5_quality_mcd


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(lines), len(covered))


def mcd(x, keep=0.75, steps=5):
    """The estimate in numpy, with the same bins."""
    floor = np.diag(quality.FLOOR)
    middle = lambda v: (np.sort(np.floor(v / 0.005))[(len(v) + 1) // 2 - 1] + 0.5) * 0.005
    m = np.array([middle(c) for c in x.T])
    c = np.diag([(1.4826 * middle(abs(v - k))) ** 2 for v, k in zip(x.T, m)]) + floor
    dist = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    shrunk = keep / quality.chi2_cdf(quality.chi2_quantile(keep, 4), 6)
    for _ in range(steps):
        b = np.floor(np.log1p(dist()) * 200)
        share = np.array([(b < v).sum() for v in b])
        h = x[share < keep * len(x)]
        m, c = h.mean(axis=0), np.cov(h.T, bias=True) * shrunk + floor
    h = x[dist() <= quality.chi2_quantile(0.975, 4)]
    m, c = h.mean(axis=0), np.cov(h.T, bias=True) + floor
    return m, c


def brute(rows, min_rows=50, k=20.0):
    stats = [counts(r[0]) for r in rows]
    failed = [s[0] < 10 or 100 * s[5] > 20 * s[0] for s in stats]
    vec = [(math.log((s[1] + 5 * k) / (s[0] + k)), math.sqrt(s[2] / (s[0] + k)), math.sqrt(s[3] / (s[4] + k / 10)),
            math.sqrt(s[5] / (s[0] + k))) for s in stats]
    fine = Counter((r[1], r[2]) for r, f in zip(rows, failed) if not f)
    small = Counter()
    for (lang, _), n in fine.items():
        small[lang] += n * (n < min_rows)
    cohort = [g if fine[g] >= min_rows else (g[0],) if small[g[0]] >= min_rows else "all"
              for g in ((r[1], r[2]) for r in rows)]
    groups = defaultdict(list)
    for i, c in enumerate(cohort):
        if not failed[i]:
            groups[c].append(vec[i])
    out = []
    for i, c in enumerate(cohort):
        far = False
        if len(groups[c]) >= min_rows and fine[rows[i][1], rows[i][2]]:
            m, cov = mcd(np.array(groups[c]))
            y = np.array(vec[i]) - m
            far = y @ np.linalg.inv(cov) @ y > quality.chi2_quantile(0.9999, 4)
        s = stats[i]
        out.append((s[0], s[1], s[2], s[3], s[5], failed[i], not failed[i] and not far))
    return out


def test_chi_square():
    assert abs(quality.chi2_quantile(0.75, 4) - 5.385269) < 1e-5 and abs(quality.chi2_cdf(5.385269, 4) - 0.75) < 1e-6


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:8] for r in op5_quality_mcd(spark, "/root/testdata/sf0.01").collect()}
    want = brute([(r.text, r.lang, r.source) for r in rows])
    assert [got[r.doc_id] for r in rows] == want
    assert 0.5 < np.mean([w[6] for w in want]) < 1


def test_edge_rows(spark, make_docs, edge_texts):
    texts = edge_texts + ["p q r s t u v " * 2 + "x y z " * 9, "l\nl\n \nl\nm", "%% $$ ## one two three four five six seven"]
    texts += [f"clean text number {i} with some words and a few more of them here" + " again" * (i % 3) for i in range(70)]
    texts += ["### $$$ %%% &&& *** ||| <<< >>> ### $$$ %%% &&& ***"]
    docs = make_docs(texts, parts=3).withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.lit("en")))
    got = {r.doc_id: r for r in quality.quality(docs.withColumn("kept", F.lit("clash"))).collect()}
    rows = [(r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]
    for i, want in enumerate(brute(rows)):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) == want
    assert not got[len(texts) - 1].kept and got[len(texts) - 2].kept


def test_empty_table(spark, make_docs):
    assert quality.quality(make_docs(["x"]).where(F.lit(False))).count() == 0
