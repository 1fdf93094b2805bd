"""The rank-50 and hybrid queries against numpy and plain Python on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import collab as CF
from marquee.operators import content as T
from marquee.plans import collab_queries as Q

D = "/root/testdata/sf0.001"


def dense(rows, center=True):
    """Users, items, their matrix (equal pairs summed) and the users' means."""
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    u, i = {x: n for n, x in enumerate(users)}, {x: n for n, x in enumerate(items)}
    by_user = {}
    for a, _, r in rows:
        by_user.setdefault(a, []).append(r)
    mu = {a: float(np.mean(v)) for a, v in by_user.items()}
    m = np.zeros((len(users), len(items)))
    for a, b, r in rows:
        m[u[a], i[b]] += r - (mu[a] if center else 0)
    return users, items, m, mu


def factors(m, k=50):
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    k = min(k, min(m.shape) - 1)
    return (u[:, :k] * s[:k]) @ vt[:k], vt[:k].T


@pytest.fixture(scope="module")
def world(spark):
    rows = [(r.user_id, r.item_id, float(r.rating)) for r in Q.bridged(spark, D).collect()]
    users, items, m, mu = dense(rows)
    pred, v = factors(m)
    return {"rows": rows, "users": users, "items": items, "pred": pred, "v": v, "mu": mu,
            "mean": float(np.mean([r for _, _, r in rows])),
            "catalog": sorted(r.id for r in Q._catalog_ids(spark, D).distinct().collect()),
            "liked": {(r.request_id, r.item_id) for r in Q.liked_lists(spark, D).collect()},
            "content": {(r.request_id, r.item_id): (r.norm, r.zero_norm) for r in Q._content(spark, D).collect()}}


def rounded(x):
    return np.floor(round(x, 9) * 100 + 0.500001) / 100


def test_predict_rating(spark, world):
    u, i = ({x: n for n, x in enumerate(world[c])} for c in ("users", "items"))
    got = Q.q_predict_rating(spark, D).collect()
    assert len(got) == 25
    for r in got:
        if r.user_id in u and r.item_id in i:
            x = min(max(world["pred"][u[r.user_id], i[r.item_id]] + world["mu"][r.user_id], 0.5), 5.0)
            assert r.reason == "ok" and abs(r.predicted - rounded(x)) < 1e-6 and r.predicted_10 == 2 * r.predicted
        else:
            assert r.predicted is None and r.reason == ("unknown_user" if r.user_id not in u else "unknown_item")


def cf_dense(world):
    """request -> item -> normalised score over the whole catalog, and the raw scores of model items."""
    i = {x: n for n, x in enumerate(world["items"])}
    norm, raw = {}, {}
    for q in sorted({r for r, _ in world["liked"]}):
        own = [i[x] for r, x in world["liked"] if r == q and x in i]
        if not own:
            continue
        f = (5 - world["mean"]) * world["v"][own].sum(axis=0) @ world["v"].T + world["mean"]
        raw[q] = {x: f[i[x]] for x in world["items"] if x in set(world["catalog"])}
        whole = np.array([raw[q].get(x, 0.0) for x in world["catalog"]])
        lo, hi = whole.min(), whole.max()
        norm[q] = dict(zip(world["catalog"], (whole - lo) / (hi - lo) if hi > lo else whole * 0))
    return norm, raw


def test_cf_scores(spark, world):
    norm, raw = cf_dense(world)
    got = Q.q_cf_scores(spark, D).collect()
    assert {(r.request_id, r.item_id) for r in got} == {(q, x) for q in raw for x in raw[q]}
    for r in got:
        assert abs(r.raw - raw[r.request_id][r.item_id]) < 1e-7 and abs(r.norm - norm[r.request_id][r.item_id]) < 1e-7


def blended(world, alpha=0.5, n=20):
    norm, _ = cf_dense(world)
    zero = {q: z for (q, _), (_, z) in world["content"].items()}
    out = {}
    for q in sorted({r for r, _ in world["liked"]}):
        score = {x: (1 - alpha) * world["content"].get((q, x), (zero.get(q, 0.0),))[0] + alpha * norm.get(q, {}).get(x, 0.0)
                 for x in world["catalog"] if (q, x) not in world["liked"]}
        out[q] = sorted(((-round(s, 9), x) for x, s in score.items() if s > 0))[:n]
    return out


def test_hybrid_recommend(spark, world):
    want = blended(world)
    got = {}
    for r in Q.q_hybrid_recommend(spark, D).orderBy("rank").collect():
        got.setdefault(r.request_id, []).append((r.item_id, r.score))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    for q, v in got.items():
        assert np.allclose([s for _, s in v], [-s for s, _ in want[q]], atol=1e-7)
        sure = [x for s, x in want[q] if sum(abs(s - t) < 1e-7 for t, _ in want[q]) == 1][:-1]
        assert set(sure) <= {x for x, _ in v}


@pytest.mark.parametrize("alpha", [-1, 0.3, 1])
def test_hybrid_without_the_product_equals_the_product(spark, world, alpha):
    m = Q.model(spark, D)
    liked = Q.liked_lists(spark, D).unionByName(spark.createDataFrame([(900, 10 ** 9), (901, 3)], "request_id long, item_id long"))
    content, ids = Q._content(spark, D), Q._catalog_ids(spark, D)
    cf = CF.cf_scores(m["items"], liked, ids, m["mu"], m["k"])
    want = CF.hybrid_recommend(content, cf, liked, ids, alpha, 7).collect()
    got = CF.hybrid_topn(content, m["items"], liked, ids, m["mu"], m["k"], alpha, 7, block_items=16, block_requests=4).collect()
    key = lambda r: (r.request_id, r.rank, r.item_id, round(r.score, 8))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_a_block_gives_at_most_n_rows_a_request():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    left = pa.table({"request_id": [1, 2], "q": pa.array([[1.0, 0.5], None], pa.list_(pa.float64())), "lo": [0.0, None],
                     "hi": [4.0, None], "zf": [0.0, 0.0], "zc": [0.1, 0.2], "items": [[3], None], "norms": [[0.9], None],
                     "own": pa.array([[5], []], pa.list_(pa.int64()))})
    right = pa.table({"item_id": list(range(500)), "v": pa.array(rng.random((500, 2)).tolist(), pa.list_(pa.float64()))})
    out = CF._blend(1.0, 0.5, 9)(left, right)
    assert out["request_id"].to_pylist() == [1] * 9 + [2] * 9 and 5 not in out["item_id"].to_pylist()[:9]


def test_hybrid_status(spark, world):
    recs, (norm, _) = blended(world), cf_dense(world)
    index = {r.id for r in Q._content_index(spark, D).collect()} | set(world["items"])
    got = {r.request_id: r for r in Q.q_hybrid_status(spark, D).collect()}
    assert got.keys() == recs.keys()
    for q, r in got.items():
        own = {x for p, x in world["liked"] if p == q}
        content_has = any(n > 0 for (p, _), (n, _) in world["content"].items() if p == q)
        cf_has = any(norm.get(q, {}).get(x, 0) > 0 for x in world["items"])
        assert (r.n_used, r.n_ignored, r.n_recs) == (len(own & index), len(own - index), len(recs[q]))
        assert (r.content_has, r.cf_has) == (content_has, cf_has)
        assert r.status == ("no_seed_covered" if not own & index else "ok" if recs[q] else "no_signal")


def test_explain_recs(spark, world):
    recs = {(r.request_id, r.item_id) for r in Q.q_hybrid_recommend(spark, D).collect()}
    index = {r.id for r in Q._content_index(spark, D).collect()}
    titles = {r.id: r.overview for r in Q.view(spark, D, "doc").select("id", "overview").collect()}
    best = {}
    for r in T.seed_scores(Q.tfidf(spark, D)["weights"], Q.liked_lists(spark, D)).collect():
        if (r.request_id, r.item_id) in recs and r.seed_id in index and r.sim > 0:
            k = (r.request_id, r.item_id)
            best[k] = min(best.get(k, (0, 0, 0)), (-round(r.sim, 9), r.seed_id, r.sim))
    got = {(r.request_id, r.item_id): r for r in Q.q_explain_recs(spark, D).collect()}
    assert got.keys() == best.keys() and got
    for k, r in got.items():
        assert (r.source_id, r.source_title) == (best[k][1], titles[best[k][1]]) and abs(r.sim - best[k][2]) < 6e-4


def test_evaluation_of_the_rank_50_model(spark):
    rows = [(r.user_id, r.item_id, float(r.rating), r.is_test) for r in Q.split(spark, D).collect()]
    train, test = [r[:3] for r in rows if not r[3]], [r[:3] for r in rows if r[3]]
    users, items, m, mu = dense(train)
    pred, _ = factors(m)
    u, i = {x: n for n, x in enumerate(users)}, {x: n for n, x in enumerate(items)}
    served = [r for r in test if r[0] in u and r[1] in i]
    whole = np.clip(pred + np.array([mu[x] for x in users])[:, None], 0.5, 5.0)
    error = np.array([rounded(whole[u[a], i[b]]) - r for a, b, r in served])
    e = Q.q_rating_error_svd(spark, D).first()
    assert e.n == len(served)
    assert abs(e.rmse - np.sqrt((error ** 2).mean())) < 1e-6 and abs(e.mae - np.abs(error).mean()) < 1e-6

    liked, seen = {}, {}
    for a, b, r in served:
        if r >= 4.0:
            liked.setdefault(a, set()).add(b)
    for a, b, _ in train:
        seen.setdefault(a, set()).add(b)
    hits = []
    for a in (x for x, s in liked.items() if len(s) >= 5):
        order = sorted((x for x in items if x not in seen[a]), key=lambda x: (-round(whole[u[a], i[x]], 9), x))[:10]
        hits.append(len(set(order) & liked[a]))
    p = Q.q_precision_at_k_svd(spark, D).first()
    assert (p.n_users, p.total_hits or 0) == (len(hits), sum(hits))
    assert not hits or abs(p.precision - np.mean(hits) / 10) < 1e-9


def test_uncentred_prototype(spark):
    b = Q.bridged(spark, D).where((F.col("rating") > 0) & (F.col("ts") <= F.lit("1998-07-19")))
    b = CF.split_flag(b, ["user_id", "item_id", "ts", "rating"], 42, 5).where("is_test")
    rows = [(r.user_id, r.item_id, float(r.rating)) for r in b.collect()]
    users, items, m, _ = dense(rows, center=False)
    pred, _ = factors(m)
    u, i = {x: n for n, x in enumerate(users)}, {x: n for n, x in enumerate(items)}
    seen = {(a, x) for a, x, _ in rows}
    got = {}
    for r in Q.q_svd_uncentered(spark, D).orderBy("rank").collect():
        assert (r.user_id, r.item_id) not in seen and abs(r.score - pred[u[r.user_id], i[r.item_id]]) < 1e-7
        got.setdefault(r.user_id, []).append(r.score)
    for a in users:
        best = sorted((pred[u[a], i[x]] for x in items if (a, x) not in seen), reverse=True)[:10]
        assert np.allclose(got[a], best, atol=1e-7)


def test_fold_in_below_full_rank(spark):
    """The full-rank query cannot show a wrong truncation; ten factors of the same matrix can."""
    rows = [(r.user_id, r.item_id, float(r.rating)) for r in Q.brand_ratings(spark, D).collect()]
    users, items, m, mu = dense(rows)
    _, v = factors(m, 10)
    entries, _ = CF.rating_matrix(Q.brand_ratings(spark, D), item="item_id")
    svd = CF.truncated_svd(entries, 10, width=14, block=8)
    factor = svd["items"].select(F.col("key").alias("item_id"), F.col("vec").alias("v"))
    likes = Q.brand_likes(spark, D)
    mean = float(np.mean([r for _, _, r in rows]))
    i = {x: n for n, x in enumerate(items)}
    own = {}
    for r in likes.collect():
        own.setdefault(r.request_id, []).append(i[r.item_id])
    got = CF.fold_in_scores(factor, likes, mean, 10).collect()
    assert len(got) == len(own) * len(items)
    for r in got:
        assert abs(r.score - ((5 - mean) * v[own[r.request_id]].sum(axis=0) @ v[i[r.item_id]] + mean)) < 1e-6


def test_genre_svd_similarity(spark):
    rows = Q.view(spark, D, "catalog").select("id", "genres").collect()
    genres = sorted({g for r in rows for g in r.genres})
    ids = [r.id for r in rows]
    onehot = np.array([[float(g in r.genres) for g in genres] for r in rows])
    _, _, vt = np.linalg.svd(onehot, full_matrices=False)
    emb = onehot @ vt[:10].T
    emb /= np.linalg.norm(emb, axis=1, keepdims=True)
    at = {x: n for n, x in enumerate(ids)}
    got = {}
    for r in Q.q_genre_svd_similarity(spark, D).orderBy("rank").collect():
        got.setdefault(r.request_id, []).append((r.neighbor_id, r.sim))
    want = {n: n * 79 for n in range(25) if n * 79 in at}
    assert got.keys() == want.keys()
    for q, seed in want.items():
        sims = emb @ emb[at[seed]]
        best = sorted((-s, x) for s, x in zip(sims, ids) if x != seed)[:5]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in best], atol=1e-7)
        assert all(abs(sims[at[x]] - s) < 1e-7 for x, s in got[q])


def test_models_join_their_ratings_once(spark):
    """What a model hands out of its ratings is read back, not joined again for every use."""
    for part in ("train", "test"):
        plan = Q._eval_model(spark, D)[part]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Relation [") == 1
