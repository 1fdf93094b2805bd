import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import toxicity
from marquee.llm.queries import op6_toxicity


def auc(score, y):
    p, n = score[y == 1], np.sort(score[y == 0])
    return (np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).mean() / 2 / len(n)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = op6_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.9
    hit = out[out.predicted == 1]
    assert hit.toxic.mean() > 0.7 and (out[out.toxic == 1].predicted == 1).mean() > 0.75


def test_score_equals_the_model_applied_row_by_row(spark, make_docs, edge_texts):
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(40))
    texts = [plain() for _ in range(150)] + [plain() + " vexorian " + plain() + " grumbulous" for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)] + [(3, None), (None, 1), (9999, 1), (0, 0)],
                                   "doc_id long, toxic int")
    docs = make_docs(texts + edge_texts, list(range(210)) + [None] + list(range(211, 210 + len(edge_texts))), parts=3)
    docs = docs.withColumn("score", F.lit("clash"))
    model = toxicity.train(docs, labels)
    distance = toxicity.Distance(model.toxic, model.ordinary)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + len(edge_texts) and rows[0].part == "x"
    for r in rows:
        f = np.array([toxicity._features(distance(toxicity.windows(r.text or "")))])
        assert abs(r.score - toxicity._score(f, model.weights)[0]) < 1e-12
    high = {r.doc_id for r in rows if r.score >= 0.3}
    held = [i for i in range(210) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i in high) == (i >= 150) for i in held) >= 0.95 * len(held)


def test_no_labels_and_empty_table(spark, make_docs):
    docs = make_docs(["a b c", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.where(F.lit(False)), model).count() == 0
