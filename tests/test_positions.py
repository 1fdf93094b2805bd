import numpy as np
import pandas as pd

from marquee.functions.positions import POS, grouped_quantiles, positions


def _skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    vals = rng.normal(size=n).round(3)
    return pd.DataFrame({"k": keys, "v": vals, "id": np.arange(n)})


def test_positions_are_dense_and_ordered(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf).repartition(7)
    out = positions(df, ["k"], ["v", "id"]).toPandas()
    for k, g in out.groupby("k"):
        g = g.sort_values(POS)
        assert list(g[POS]) == list(range(len(g)))
        exp = pdf[pdf.k == k].sort_values(["v", "id"])["id"].tolist()
        assert g["id"].tolist() == exp


def test_global_positions_same_under_1_and_8_partitions(spark):
    pdf = _skewed(500)
    a = positions(spark.createDataFrame(pdf).coalesce(1), [], ["v", "id"]).toPandas()
    b = positions(spark.createDataFrame(pdf).repartition(8), [], ["v", "id"]).toPandas()
    ma = dict(zip(a.id, a[POS]))
    mb = dict(zip(b.id, b[POS]))
    assert ma == mb and sorted(ma.values()) == list(range(500))


def test_grouped_quantiles_match_numpy(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf).repartition(5)
    q = grouped_quantiles(df, ["k"], "v", [0.25, 0.5, 0.75, 0.9]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        exp = np.quantile(g.v.to_numpy(), [0.25, 0.5, 0.75, 0.9])
        got = q.loc[k, ["q0", "q1", "q2", "q3"]].to_numpy(dtype=float)
        assert np.allclose(got, exp, atol=1e-12)
        assert q.loc[k, "n"] == len(g)


def test_global_median_and_single_value(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "v double")
    r = grouped_quantiles(df, [], "v", [0.5]).first()
    assert r["q0"] == 2.0 and r["n"] == 3
    one = spark.createDataFrame([(5.0,)], "v double")
    assert grouped_quantiles(one, [], "v", [0.1, 0.9]).first()["q1"] == 5.0


def test_same_under_any_plan_settings(spark):
    """Exchange reuse and adaptive plans must not change a position or a quantile."""
    rng = np.random.default_rng(3)
    n = 20_000
    big = 2 ** 53
    rows = [(i, None if i % 7 == 0 else big + i, float(rng.integers(0, 5)) if rng.random() < 0.6 else float(rng.normal()),
             None if i % 11 == 0 else "hot" if i % 3 else "b") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, wide long, v double, k string").repartition(16)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: (p, r[1]) for p, r in enumerate(order)}
    keep = {c: spark.conf.get(c) for c in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        for reuse in ("true", "false"):
            for adaptive in ("true", "false"):
                spark.conf.set("spark.sql.exchange.reuse", reuse)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                out = positions(df, [], ["v", "id"], 16)
                plan = out._jdf.queryExecution().toString()
                assert "MapInPandas" not in plan and "Python" not in plan
                assert {r["id"]: (r[POS], r["wide"]) for r in out.collect()} == want
                q = grouped_quantiles(df, ["k"], "v", [0.1, 0.5, 0.77]).collect()
                assert len(q) == 3
                for r in q:
                    exp = np.quantile([x[2] for x in rows if x[3] == r["k"]], [0.1, 0.5, 0.77])
                    assert np.allclose([r["q0"], r["q1"], r["q2"]], exp, atol=1e-12)
    finally:
        for c, value in keep.items():
            spark.conf.set(c, value)
