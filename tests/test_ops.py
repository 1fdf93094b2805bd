"""Edge cases of cleaning, browse/search, content and linkage operators."""
import math

import numpy as np
from pyspark.sql import functions as F

from marquee.functions.common import try_double, try_long
from marquee.functions.text import split_list, title_norm, vocab_filter
from marquee.operators import analytics as A
from marquee.operators import browse as B
from marquee.operators import clean as C
from marquee.operators import content as T
from marquee.operators import linkage as L


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12.5",), ("nan",), ("abc",), (" 7 ",), (None,), ("12.0",)], "x string")
    got = [r[0] for r in df.select(try_double("x")).collect()]
    assert got == [12.5, None, None, 7.0, None, 12.0]
    ids = [r[0] for r in df.select(try_long("x")).collect()]
    assert ids == [12, None, None, 7, None, 12]


def test_pipe_lists_and_vocab(spark):
    df = spark.createDataFrame([("Drama||Comedy|Drama|Bad",), (None,), ("",)], "g string")
    out = df.select(vocab_filter(split_list("g"), ["Drama", "Comedy"]).alias("v")).collect()
    assert out[0]["v"] == ["Drama", "Comedy", "Drama"] and out[1]["v"] == [] and out[2]["v"] == []


def test_title_norm_and_search_blank_matches_all(spark):
    cat = spark.createDataFrame([(1, "Iron Man"), (2, "The Lord of the Rings"), (3, "Up")], "id long, title string")
    cat = cat.withColumn("title_norm", title_norm("title"))
    q = spark.createDataFrame([(1, "ironman"), (2, "  "), (3, "u"), (4, "lord of the"), (5, "zzz")],
                              "query_id long, q string")
    hits = B.search_title(cat, q).select("query_id", "id").collect()
    got = {}
    for r in hits:
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got[1] == {1} and got[2] == {1, 2, 3} and got[3] == {3} and got[4] == {2} and 5 not in got


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "bca", "cab", "x", "aab"]
    titles = [" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(200)]
    cat = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumn(
        "title_norm", title_norm("title"))
    qs = ["ab", "a", "bcab", "", "abca", "xab", "q"]
    q = spark.createDataFrame(list(enumerate(qs)), "query_id long, q string")
    found = B.search_title(cat, q).select("query_id", "id", "title", "q_norm").collect()
    got = {(r[0], r[1]) for r in found}
    assert len(got) == len(found)
    by_grams = {(r[0], r[1]) for r in B.search_title(cat, q, most_patterns=3).select("query_id", "id").collect()}
    exp = {(qi, i) for qi, s in enumerate(qs) for i, t in enumerate(titles)
           if s.replace(" ", "") in t.replace(" ", "").lower()}
    assert got == exp and by_grams == exp


def test_search_shuffles_hits_only(spark):
    """A gram that every title has: the plan moves no titles, and equal requests are looked up once."""
    cat = spark.range(2000).select("id", F.concat(F.lit("the same title "), F.col("id").cast("string")).alias("title"))
    cat = cat.withColumn("title_norm", title_norm("title")).unionByName(spark.createDataFrame(
        [(9999, None, None)], "id long, title string, title_norm string"))
    q = spark.createDataFrame([(1, "title 1999"), (2, "Title 1999"), (3, None), (4, "nothing")], "query_id long, q string")
    hits = B.search_title(cat, q)
    assert sorted((r.query_id, r.id) for r in hits.collect()) == [(1, 1999), (2, 1999)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "gram" not in plan


def test_paging(spark):
    df = spark.createDataFrame([(i, float(i % 7), i) for i in range(100)],
                               "id long, weighted_score double, load_seq long")
    p = B.browse_pages(df, "popular", 24).orderBy("position").collect()
    assert [r["position"] for r in p] == list(range(1, 101))
    assert p[0]["weighted_score"] == 6.0 and p[-1]["page"] == 5
    assert B.page_meta(df.limit(0), 24).first()["total_pages"] == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (0.5,), (9.99,), (11.0,), (None,)], "vote_average double")
    h = {r["bin"]: r for r in A.rating_histogram(df, 0.5).collect()}
    assert h[19]["n_films"] == 2 and h[0]["n_films"] == 1 and h[1]["n_films"] == 1
    assert h[0]["n_rated"] == 5 and sum(r["n_films"] for r in h.values()) == 4


def test_correlation_zero_variance_is_null(spark):
    df = spark.createDataFrame([(1000.0, 5.0, 1.0, 2.0, 3.0), (2000.0, 5.0, 2.0, 4.0, 3.0)],
                               "budget double, revenue double, profit double, roi double, runtime double")
    r = {(x["var_a"], x["var_b"]): x["r"] for x in A.financial_correlation(df, 0).collect()}
    assert r[("budget", "revenue")] is None and r[("budget", "profit")] == 1.0


def test_dedupe_keep_first_and_upsert(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 2), (2, "c", 1)], "id long, t string, load_seq long")
    got = {r["id"]: r["t"] for r in C.dedupe_keep_first(df, "id").collect()}
    assert got == {1: "b", 2: "c"}
    ex = spark.createDataFrame([("tt1", "u1", 0), ("tt2", "error", 0)], "k string, url string, seq int")
    up = spark.createDataFrame([("tt1", "u9", 1)], "k string, url string, seq int")
    reg = {r["k"]: r["url"] for r in L.upsert_latest(ex, up, "k", "seq").collect()}
    assert reg == {"tt1": "u9", "tt2": "error"}


def test_asset_name_zfill_keeps_long_ids(spark):
    df = spark.createDataFrame([("123",), ("12345678",)], "x string")
    assert [r[0] for r in df.select(L.asset_name("x")).collect()] == ["tt0000123.jpg", "tt12345678.jpg"]


def test_clean_id_list_keeps_first_position(spark):
    df = spark.createDataFrame([(1, ["5", "x", "3", "5", "2.5", " 3 "])], "request_id long, ids array<string>")
    got = sorted((r["item_id"], r["pos"]) for r in L.clean_id_list(df).collect())
    assert got == [(3, 2), (5, 0)]


def test_link_records_first_candidate(spark):
    left = spark.createDataFrame([(1, "The Matrix!", 1999), (2, "Alien", None)], "id long, title string, year int")
    cands = spark.createDataFrame([
        (10, "the matrix", 2001, True, 1), (11, "The  Matrix", 2000, True, 5), (12, "the matrix", 1999, False, 0),
        (13, "alien", 1979, True, 9), (14, "ALIEN", None, True, 3)],
        "cand_id long, title string, year int, has_asset boolean, cand_order long")
    got = {r["id"]: r["cand_id"] for r in L.link_records(left, cands).collect()}
    assert got == {1: 11, 2: 14}


def test_tfidf_weights_and_similarity(spark):
    items = spark.createDataFrame([
        (1, "space ship travel galaxy", "en", ["scifi"]), (2, "space travel stars galaxy", "en", ["scifi"]),
        (3, "love story romance", "en", ["romance"]), (4, "romance love drama", "en", ["romance"]),
        (5, "texte en francais", "fr", ["x"])],
        "id long, overview string, original_language string, genres array<string>")
    items = items.withColumn("keywords", F.array().cast("array<string>")).withColumn(
        "director", F.lit(None).cast("string"))
    t = T.build_tfidf(items, "en", max_df=0.8)
    w = t["weights"].toPandas()
    norms = w.groupby("id").w.apply(lambda s: math.sqrt((s ** 2).sum()))
    assert np.allclose(norms.to_numpy(), 1.0)
    seeds = spark.createDataFrame([(1, 1), (1, 99)], "request_id long, item_id long")
    sim = T.similar_items(t["weights"], seeds, 3).collect()
    assert sim[0]["item_id"] == 2 and all(r["item_id"] != 1 for r in sim)


def test_embedding_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    req = spark.createDataFrame([(i, i) for i in range(0, 60, 7)], "request_id long, item_id long")
    got = T.embedding_knn(df.repartition(4), req, 5, block_items=16, block_requests=3).collect()
    nv = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for i in range(0, 60, 7):
        s = nv @ nv[i]
        s[i] = -np.inf
        exp = list(np.argsort(-s, kind="stable")[:5])
        mine = [r["neighbor_id"] for r in sorted([r for r in got if r["request_id"] == i], key=lambda r: r["rank"])]
        assert mine == exp


def test_genre_onehot_cosine_brute_force(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "c"]), (4, []), (5, ["a", "b", "a"])],
                                  "id long, genres array<string>")
    seeds = spark.createDataFrame([(0, 1)], "request_id long, item_id long")
    got = {r["item_id"]: r["sim"] for r in T.genre_onehot_cosine(items, seeds, 10).collect()}
    assert got == {5: 1.0, 2: 1 / math.sqrt(2), 3: 0.5}
    rng = T.genre_similarity_range(items).first()
    assert rng["min_sim"] == 0.0 and rng["max_sim"] == 1.0


def test_distinct_counts_in_one_shuffle(spark):
    rows = [(1, "a", None), (1, None, "a"), (1, "a", None), (None, "a", "b"), (2, "", None), (2, None, None), (None, "a", "b")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    r = C.duplicate_audit(df).first()
    assert tuple(r) == (7, 2, 5, 2)
    assert tuple(C.duplicate_audit(df.select("id")).first()) == (7, 2, 5, 4)
    assert tuple(C.duplicate_audit(df.where("id > 9")).first()) == (0, 0, 0, 0)
    plan = C.duplicate_audit(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Aggregate") == 2


def test_similarities_shuffle_no_pairs_and_sum_like_the_matrix(spark):
    """Requests that share a seed, one without an id, seeds that are items, an item that only shares with itself."""
    rng = np.random.default_rng(2)
    w = np.where(rng.random((30, 12)) < 0.25, rng.random((30, 12)), 0.0)
    w[4] = 0.0
    w[4, 11], w[5:, 11], w[:4, 11] = 0.7, 0.0, 0.0  # term 11: only document 4
    weights = spark.createDataFrame([(int(i), f"t{t}", float(w[i, t])) for i, t in zip(*np.nonzero(w))], "id long, term string, w double")
    asked = [(1, 0), (1, 4), (1, 7), (2, 7), (2, 7), (3, 4), (None, 7), (5, 99)]
    seeds = spark.createDataFrame(asked, "request_id long, item_id long")
    sims = w @ w.T
    got = T.seed_scores(weights, seeds)
    want = {(r, s, i): sims[s, i] for r, s in set(asked) if s < 30 for i in range(30) if i != s and sims[s, i] > 0}
    rows = {(r.request_id, r.seed_id, r.item_id): r.sim for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-12 for k in want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # nothing meets the pairs afterwards
    top = T.similar_items(weights, seeds, 3).collect()
    for (r, s) in set(asked):
        order = sorted((i for (a, b, i) in want if (a, b) == (r, s)), key=lambda i: (-round(sims[s, i], 9), i))[:3]
        assert [x.item_id for x in sorted(top, key=lambda x: x.rank) if (x.request_id, x.seed_id) == (r, s)] == order
    catalog = spark.createDataFrame([(i,) for i in range(25)], "id long")
    raw = {}
    for (r, s, i), sim in want.items():
        if r is not None and i < 25:
            raw[r, i] = raw.get((r, i), 0.0) + sim
    out = {(x.request_id, x.item_id): x.raw for x in T.content_scores(weights, seeds, catalog).collect()}
    assert out.keys() == raw.keys() and all(abs(out[k] - raw[k]) < 1e-12 for k in raw)


def test_words_are_cut_once_and_seeds_meet_asked_items_only(spark):
    """Kept TF-IDF weights read written tokens; with items, seed_scores gives the same rows for these and no others."""
    from marquee.operators import content as T
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(words[(i * k) % 6] for k in (1, 2, 3, 5)), "en") for i in range(40)] + [(40, None, "en")]
    docs = spark.createDataFrame(rows, "id long, overview string, original_language string").selectExpr(
        "*", "array('x') genres", "cast(array() as array<string>) keywords", "cast(null as string) director")
    kept, lazy = (T.build_tfidf(docs, keep=keep)["weights"] for keep in (True, False))
    assert "regexp_extract_all" in lazy._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in kept._jdf.queryExecution().analyzed().toString()
    flat = lambda df: sorted((*r[:-1], round(r[-1], 9)) for r in df.collect())
    assert flat(kept) == flat(lazy)
    seeds = spark.createDataFrame([(1, 3), (1, 4), (2, 7)], "request_id long, item_id long")
    asked = spark.createDataFrame([(1, 5), (2, 8), (2, 5), (None, 9), (1, 999)], "request_id long, item_id long")
    every = T.seed_scores(kept, seeds)
    some = T.seed_scores(kept, seeds, asked)
    want = [r for r in flat(every.select("request_id", "seed_id", "item_id", "sim")) if r[2] in (5, 8, 9)]
    assert want and flat(some.select("request_id", "seed_id", "item_id", "sim")) == want


def test_similar_items_of_common_and_rare_terms(spark):
    """Terms of most documents go through dense matrices, the others term by term: the same as a plain product; vectors
    are sent about eight times whatever the size of the tables."""
    rng = np.random.default_rng(6)
    w = np.where(rng.random((60, 40)) < np.linspace(0.9, 0.02, 40), rng.random((60, 40)), 0.0)
    w[30:40] = w[:10]  # equal documents: ties by id
    rows = [(i, f"t{j}", float(w[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(w)))]
    weights = spark.createDataFrame(rows, "id long, term string, w double")
    seeds = spark.createDataFrame([(i % 3, i) for i in range(0, 60, 2)], "request_id long, item_id long")
    sims = w @ w.T
    got = T.similar_items(weights, seeds, 5).collect()
    for i in range(0, 60, 2):
        want = [j for j in np.lexsort((np.arange(60), -np.round(sims[i], 9))) if j != i and sims[i, j] > 0][:5]
        mine = sorted((r["rank"], r["item_id"], r["sim"]) for r in got if r["seed_id"] == i)
        assert [j for _, j, _ in mine] == want and np.allclose([s for *_, s in mine], sims[i, want])
    full = {(r["seed_id"], r["item_id"]): r["sim"] for r in T.seed_scores(weights, seeds).collect()}
    assert full.keys() == {(i, j) for i in range(0, 60, 2) for j in range(60) if j != i and sims[i, j] > 0}
    assert all(abs(full[i, j] - sims[i, j]) < 1e-12 for i, j in full)
    for n in (10 ** 5, 2 * 10 ** 5):
        assert -(-n // T._eighth(n, 4096, 32_768)) <= 8
