import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import collab as CF


def _ratings(spark, users=30, items=12, per=6, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        for i in rng.choice(items, per, replace=False):
            rows.append((u, int(i), float(rng.integers(1, 11)) / 2))
    if dup:
        rows.append(rows[0])  # duplicate (user, item): summed like a sparse constructor
    return rows, spark.createDataFrame(rows, "user_id long, catalog_id long, rating double")


def _dense(rows, users, items):
    by_user = {}
    for u, i, r in rows:
        by_user.setdefault(u, []).append(r)
    a = np.zeros((users, items))
    for u, i, r in rows:
        a[u, i] += r - np.mean(by_user[u])
    return a, {u: np.mean(v) for u, v in by_user.items()}


def test_svd_matches_numpy_when_sketch_covers_rank(spark):
    rows, df = _ratings(spark)
    m, means = CF.rating_matrix(df)
    svd = CF.truncated_svd(m, k=5)
    a, mu = _dense(rows, 30, 12)
    u, s, vt = np.linalg.svd(a)
    assert np.allclose(svd["sigma"], s[:5], atol=1e-8)
    uf, itf = CF.factor_tables(svd, means)
    us = {r["user_id"]: np.array(r["us"]) for r in uf.collect()}
    v = {r["item_id"]: np.array(r["v"]) for r in itf.collect()}
    pred = (u[:, :5] * s[:5]) @ vt[:5]
    assert max(abs(us[x] @ v[y] - pred[x, y]) for x in us for y in v) < 1e-8


def test_predict_clip_and_reasons(spark):
    rows, df = _ratings(spark)
    m, means = CF.rating_matrix(df)
    svd = CF.truncated_svd(m, k=4)
    uf, itf = CF.factor_tables(svd, means)
    req = spark.createDataFrame([(1, 0, 0), (2, 999, 0), (3, 0, 999)], "request_id long, user_id long, item_id long")
    out = {r["request_id"]: r for r in CF.predict_rating(uf, itf, req).collect()}
    assert out[1]["reason"] == "ok" and 0.5 <= out[1]["predicted"] <= 5.0
    assert out[2]["reason"] == "unknown_user" and out[2]["predicted"] is None
    assert out[3]["reason"] == "unknown_item"


def test_fold_in_is_r_v_vt_plus_mu(spark):
    rows, df = _ratings(spark)
    m, means = CF.rating_matrix(df)
    svd = CF.truncated_svd(m, k=4)
    _, itf = CF.factor_tables(svd, means)
    v = {r["item_id"]: np.array(r["v"]) for r in itf.collect()}
    mu = 3.0
    liked = spark.createDataFrame([(7, 1), (7, 3), (7, 3)], "request_id long, item_id long")
    got = {r["item_id"]: r["score"] for r in CF.fold_in_scores(itf, liked, mu, 4).collect()}
    s = (5 - mu) * (v[1] + v[3])
    for i, vec in v.items():
        assert abs(got[i] - (s @ vec + mu)) < 1e-9


def test_recommend_users_excludes_seen(spark):
    rows, df = _ratings(spark)
    m, means = CF.rating_matrix(df)
    svd = CF.truncated_svd(m, k=4)
    uf, itf = CF.factor_tables(svd, means)
    seen = df.select("user_id", F.col("catalog_id").alias("item_id")).distinct()
    recs = CF.recommend_users(uf, itf, df.select("user_id").distinct(), seen, 10)
    bad = recs.join(seen, ["user_id", "item_id"]).count()
    assert bad == 0
    per = recs.groupBy("user_id").count().collect()
    assert all(r["count"] == 6 for r in per)  # 12 items - 6 seen (strict exclusion)


def test_hybrid_never_returns_liked_and_alpha_bounds(spark):
    content = spark.createDataFrame(
        [(1, 10, 1.0, 0.0), (1, 11, 0.5, 0.0), (1, 12, 0.2, 0.0)],
        "request_id long, item_id long, norm double, zero_norm double")
    cf = spark.createDataFrame(
        [(1, 10, 0.1, 0.3), (1, 13, 1.0, 0.3)], "request_id long, item_id long, norm double, zero_norm double")
    liked = spark.createDataFrame([(1, 12)], "request_id long, item_id long")
    cat = spark.range(10, 20).withColumnRenamed("id", "id")
    out = CF.hybrid_recommend(content, cf, liked, cat, 0.5, 20).orderBy("rank").collect()
    ids = [r["item_id"] for r in out]
    assert 12 not in ids
    assert ids[:3] == [10, 13, 11]  # 0.55, 0.5, 0.4
    # items covered by neither engine share (1-a)*0 + a*0.3 = 0.15 and follow by id
    assert ids[3:] == [14, 15, 16, 17, 18, 19]
    only_c = CF.hybrid_recommend(content, cf, liked, cat, -3, 5).orderBy("rank").collect()
    assert [r["item_id"] for r in only_c] == [10, 11]


def test_split_is_partitioning_independent(spark):
    rows, df = _ratings(spark, users=50)
    a = CF.split_flag(df.coalesce(1), ["user_id", "catalog_id", "rating"]).where("is_test").count()
    b = CF.split_flag(df.repartition(8), ["user_id", "catalog_id", "rating"]).where("is_test").count()
    assert a == b


def _planted(spark, spectrum, users=60, items=40, seed=5):
    """A dense matrix with the given singular values."""
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.normal(size=(users, len(spectrum))))[0]
    v = np.linalg.qr(rng.normal(size=(items, len(spectrum))))[0]
    a = (u * spectrum) @ v.T
    rows = [(i, j, float(a[i, j])) for i in range(users) for j in range(items)]
    return a, spark.createDataFrame(rows, "user_id long, item_id long, value double")


@pytest.mark.parametrize("width, whole, spectrum", [
    (12, 10 ** 6, np.linspace(10, 8, 30)), (12, 10 ** 6, 10 * 0.7 ** np.arange(30)),
    (12, 0, 10 * 0.8 ** np.arange(30)), (None, 10 ** 6, np.linspace(10, 8, 30))])
def test_truncated_svd_converges_below_the_rank(spark, width, whole, spectrum):
    for spectrum in (spectrum,):
        a, df = _planted(spark, spectrum)
        svd = CF.truncated_svd(df, k=8, width=width, tol=1e-9, block=16, whole=whole)
        u, s, vt = np.linalg.svd(a)
        best = (u[:, :8] * s[:8]) @ vt[:8]
        uu = {r["key"]: np.array(r["vec"]) for r in svd["users"].collect()}
        vv = {r["key"]: np.array(r["vec"]) for r in svd["items"].collect()}
        got = np.array([[uu[i] * svd["sigma"] @ vv[j] for j in range(40)] for i in range(60)])
        assert np.linalg.norm(got - best) <= 1e-6 * np.linalg.norm(best)
        assert np.allclose(svd["sigma"], s[:8], rtol=1e-8)


def test_hybrid_is_complete_for_each_request(spark):
    """Against a dense blend per request, where other requests cover other items."""
    rng = np.random.default_rng(7)
    cat, alpha, n = list(range(100, 160)), 0.4, 7
    for zc, zf in ((0.1, 0.3), (0.0, 0.0)):
        c = [(r, int(i), float(x), zc) for r in (1, 2, 3) for i, x in zip(rng.choice(cat, 20, False), rng.random(20))]
        f = [(r, int(i), float(x), zf) for r in (1, 2) for i, x in zip(rng.choice(cat, 15, False), rng.random(15))]
        liked = [(r, int(i)) for r in (1, 2, 3) for i in rng.choice(cat, 4, False)]
        schema = "request_id long, item_id long, norm double, zero_norm double"
        out = CF.hybrid_recommend(spark.createDataFrame(c, schema), spark.createDataFrame(f, schema),
                                  spark.createDataFrame(liked, "request_id long, item_id long"),
                                  spark.createDataFrame([(i,) for i in cat], "id long"), alpha, n).collect()
        for r in (1, 2, 3):
            cn = {i: x for q, i, x, _ in c if q == r}
            fn = {i: x for q, i, x, _ in f if q == r}
            zf_r = zf if fn else 0.0
            dense = {i: (1 - alpha) * cn.get(i, zc) + alpha * fn.get(i, zf_r) for i in cat if (r, i) not in liked}
            want = sorted(((-round(x, 9), i) for i, x in dense.items() if x > 0))[:n]
            got = sorted((x["rank"], x["item_id"]) for x in out if x["request_id"] == r)
            assert [i for _, i in got] == [i for _, i in want]


def test_knn_keeps_items_of_one_request_apart(spark):
    from marquee.operators.content import embedding_knn
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 6))
    vec = spark.createDataFrame([(i, v[i].tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    req = spark.createDataFrame([(1, 3), (1, 8), (2, 3)], "request_id long, item_id long")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = embedding_knn(vec, req, 4).collect()
    assert len(got) == 12
    for request, item in ((1, 3), (1, 8), (2, 3)):
        sims = unit @ unit[item]
        want = [i for i in np.argsort(-sims) if i != item][:4]
        assert [r["neighbor_id"] for r in sorted(got, key=lambda r: r["rank"])
                if (r["request_id"], r["item_id"]) == (request, item)] == want


def test_popularity_recs_equal_a_plain_ranking(spark):
    rows, df = _ratings(spark, users=20, items=15, per=6)
    train = df.select("user_id", F.col("catalog_id").alias("item_id"))
    got = CF.popularity_recs(train, train.select("user_id").distinct(), 4).collect()
    count, seen = {}, {}
    for u, i, _ in rows:
        count[i] = count.get(i, 0) + 1
        seen.setdefault(u, set()).add(i)
    order = sorted(count, key=lambda i: (-count[i], i))
    for u in seen:
        want = [i for i in order if i not in seen[u]][:4]
        assert [r["item_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["user_id"] == u] == want


def test_queries_use_the_proved_tolerance(spark, monkeypatch):
    """The planted spectra at the operator's own tolerance, which is what every registered query uses."""
    import inspect


    from marquee.plans import collab_queries as Q

    class Called(Exception):
        pass

    def seen(entries, *args, **kw):
        raise Called(args, kw)

    assert inspect.signature(CF.truncated_svd).parameters["tol"].default <= 1e-9
    monkeypatch.setattr(CF, "truncated_svd", seen)
    monkeypatch.setattr(Q, "_MODELS", {})
    for build in (Q.model, Q.brand_model, Q._eval_model, Q.q_svd_uncentered):
        with pytest.raises(Called) as e:
            build(spark, "/root/testdata/sf0.001")
        args, kw = e.value.args
        assert len(args) == 1 and "tol" not in kw


def test_best_of_a_block_against_a_full_sort():
    """Ties, seen places, an id that comes twice and scores that are no numbers, over several strips."""
    rng = np.random.default_rng(3)
    q, v = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (900, 3)).astype(float)
    v[7, 1] = v[501, 0] = q[5, 2] = np.nan
    off, ids = np.zeros(40), np.sort(rng.integers(0, 880, 900))
    seen = np.nonzero(rng.random((40, 900)) < 0.3)
    row, at, best = CF._best(q, off, seen, ids, v, 6, -3.0, 3.0, wide=128)
    s, free = np.clip(q @ v.T, -3.0, 3.0), np.ones((40, 900), dtype=bool)
    free[seen] = False
    for r in range(40):
        left = np.flatnonzero(free[r])
        want = left[np.lexsort((left, -np.round(s[r, left], 9)))[:6]]
        assert at[row == r].tolist() == want.tolist()
        assert np.array_equal(best[row == r], s[r, want], equal_nan=True)


def test_blocks_of_scores_grow_with_the_tables():
    for rows in (10 ** 5, 10 ** 6, 2 * 10 ** 6):
        assert -(-rows // CF.block_size(rows, 4096, 131072)) <= 16
    assert CF.block_size(10, 4096, 131072) == 4096 and CF.block_size(10 ** 9, 4096, 131072) == 131072


def test_strips_multiply_like_the_matrix(spark):
    """A row longer than a chunk, both sides, and no exchange that carries the strips."""
    import inspect

    import pyarrow as pa

    from marquee.functions import blocks as BL
    rng = np.random.default_rng(1)
    a = np.where(rng.random((6, 90_000)) < 0.01, rng.normal(size=(6, 90_000)), 0.0)
    a[2] = rng.normal(size=90_000)
    x, y = rng.normal(size=(90_000, 3)), rng.normal(size=(6, 3))
    r, c = np.nonzero(a)
    for own, other, m, n, want in ((r, c, x, 6, a @ x), (c, r, y, 90_000, a.T @ y)):
        t = BL._strip(pa.table({"side": pa.array([0] * len(r), pa.int32()), "block": pa.array([0] * len(r), pa.int32()),
                                "own": own, "other": other, "vals": a[r, c]}))
        strip = (*(np.frombuffer(t[k][0].as_py(), np.int32) for k in ("degs", "at", "idx")), np.frombuffer(t["vals"][0].as_py()))
        assert np.allclose(BL._times([strip], m, n), want)
    df = spark.createDataFrame([(i, j, float(i * j % 7 + 1)) for i in range(30) for j in range(20)], "r long, c long, v double")
    made = BL.cells(df, "r", "c", "v", 8)
    factor = made.col_keys.select(F.col("block").alias("key"), F.size("keys").alias("n")).mapInArrow(
        lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array([np.ones((n, 4)).tobytes() for n in b.column(1).to_pylist()],
                    pa.binary())], names=["key", "m"]) for b in bs), "key int, m binary")
    done = BL._sharded(made, factor, 4, ["m"], lambda forward, back, m: [back(forward(m))], 3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert inspect.signature(BL.cells).parameters["whole"].default == BL.WHOLE


def test_a_matrix_lies_once_in_a_task_and_old_tables_go(spark):
    """Strips hold rows only and multiply both ways; the columns of a task are bounded; a cycle's tables are deleted."""
    import glob

    import pyarrow as pa

    from marquee.functions import blocks as BL
    rng = np.random.default_rng(2)
    a = np.where(rng.random((50, 3000)) < 0.2, rng.normal(size=(50, 3000)), 0.0)
    r, c = np.nonzero(a)
    t = BL._strip(pa.table({"side": pa.array([0] * len(r), pa.int32()), "block": pa.array([0] * len(r), pa.int32()),
                            "own": r, "other": c, "vals": a[r, c]}))
    strip = (*(np.frombuffer(t[k][0].as_py(), np.int32) for k in ("degs", "at", "idx")), np.frombuffer(t["vals"][0].as_py()))
    y, most = rng.normal(size=(50, 3)), BL.SCATTER
    try:
        for BL.SCATTER in (7, 1000, most):
            assert np.allclose(BL._back([strip, strip], y, 3000), 2 * a.T @ y)
    finally:
        BL.SCATTER = most
    assert 8 * 125 * 8 * 10 ** 6 / BL.shard_count(12, 125, 10 ** 6, 10 ** 6) <= BL.HELD
    _, df = _planted(spark, 10 * 0.8 ** np.arange(30))
    made = BL.cells(df, "user_id", "item_id", "value", 16)
    assert {r["side"] for r in made.strips.select("side").collect()} == {0}
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/marquee-*/*"))
    CF.truncated_svd(df, k=8, width=12, block=16)
    left = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/marquee-*/*")) - before
    assert sorted(f.rpartition("/")[2] for f in left) == ["item_id-blocks", "items", "user_id-blocks", "users"]


def test_large_singular_values_do_not_slow_the_others(spark, monkeypatch):
    from marquee.functions import blocks as BL
    calls, real = [], BL.filtered
    monkeypatch.setattr(BL, "filtered", lambda *a, **kw: calls.append((a[5], len(kw.get("values", ())))) or real(*a, **kw))
    spectrum = np.concatenate([[30.0, 25.0], np.linspace(10, 9, 28)])
    a, df = _planted(spark, spectrum)
    svd = CF.truncated_svd(df, k=8, width=12, block=16)
    assert np.allclose(svd["sigma"], spectrum[:8], rtol=1e-9)
    assert max(known for _, known in calls) == 2 and max(degree for degree, _ in calls) >= 16


def test_polynomial_as_a_correction_in_single_precision(spark):
    """Against the recurrence in double precision, with and without a known vector; the correction is small, so is its error."""
    from marquee.functions import blocks as BL
    a, df = _planted(spark, np.linspace(10, 2, 30))
    made = BL.cells(df, "user_id", "item_id", "value", 16)
    assert {r["side"] for r in made.thin.select("side").collect()} == {0, 1}
    assert BL._times([(np.array([2, 1], "i4"), np.array([0], "i4"), np.array([1, 0], "i4"), np.array([3.0, 4.0], "f4"))],
                     np.ones((2, 3), "f4"), 1).dtype == np.float32
    keys = {r["block"]: list(r["keys"]) for r in made.col_keys.collect()}
    order = [k for b in sorted(keys) for k in keys[b]]
    a = a[:, order]
    rng = np.random.default_rng(4)
    b = a.T @ a
    vec = np.linalg.eigh(b)[1][:, ::-1]
    x = np.linalg.qr(vec[:, :6] + np.hstack([np.zeros((40, 1)), 1e-3 * rng.normal(size=(40, 5))]))[0]
    theta, turn = np.linalg.eigh(x.T @ b @ x)
    theta, turn = theta[::-1], turn[:, ::-1]
    cuts = np.cumsum([0] + [len(keys[k]) for k in sorted(keys)])
    def flat(m):
        return {k: np.ascontiguousarray(m[lo:hi]).tobytes() for k, lo, hi in zip(sorted(keys), cuts, cuts[1:])}
    m, im = flat(x), flat(b @ x)
    factor = spark.createDataFrame([(k, bytearray(m[k]), bytearray(im[k])) for k in sorted(keys)], "key int, m binary, im binary")
    half, y = theta[-1] / 2, x @ turn
    now, before = y, None
    for step in range(6):
        up = b @ now / half - now
        before, now = now, 2 * up - before if step else up
    want = now / np.cosh(6 * np.arccosh(np.maximum(theta / half - 1, 1)))
    for values, near in (((), True), ((), False), (theta[:1], True)):
        rows = {r["key"]: r for r in BL.filtered(made, factor, 6, turn, half, 6, values=values, theta=theta, near=near).collect()}
        got, image = (np.vstack([np.frombuffer(rows[k][c]).reshape(-1, 6) for k in sorted(keys)]) for c in ("m", "im"))
        first = len(values)
        if first:  # stays, and is taken out of the others
            assert np.allclose(got[:, 0], y[:, 0], atol=1e-12)
        assert np.abs(got[:, first:] - want[:, first:]).max() < 1e-7
        assert np.allclose(image, b @ got, atol=1e-9 if near else 1e-4)


def test_degree_is_what_the_residual_needs():
    assert CF._needed(232.3, 228.6, 5.0) < 30 < CF._needed(232.3, 228.6, 1e5)
    assert CF._needed(1.0, 1.0, 1e5) > 10 ** 5  # no growth, no bound


def test_best_by_single_precision_first():
    """Scores closer than single precision tells apart, vectors of very different length, all limits."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 5)) * 10.0 ** rng.integers(-6, 2, (3000, 1))
    v[1000:2000] = v[:1000] * (1 + 1e-8 * rng.integers(-1, 2, (1000, 1)))
    q, off, ids = rng.normal(size=(20, 5)), rng.normal(size=20), np.arange(3000) * 3
    for lo, hi in ((-np.inf, np.inf), (0.5, 5.0)):
        row, at, best = CF._best(q, off, (np.zeros(0, "i8"), np.zeros(0, "i8")), ids, v, 7, lo, hi, thin=v.astype("f4"))
        s = np.clip(q @ v.T + off[:, None], lo, hi)
        for r in range(20):
            want = np.lexsort((ids, -np.round(s[r], 9)))[:7]
            assert at[row == r].tolist() == want.tolist() and np.allclose(best[row == r], s[r, want], atol=1e-12)
