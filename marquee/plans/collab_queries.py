"""Registered collaborative-filtering, hybrid and evaluation queries
(R1-R15, W4, W5, A29, A30, U1-U4, T9).

Ratings are customers rating parts (``rating`` view), bridged to catalog
ids through ``bridge``. Liked lists and prediction requests come from the
``nation`` table (one request per nation row). The rank-50 queries have no SQL
oracle; pytest checks their operators against numpy. The ``*_full_rank`` queries run
the same operators on ratings of brands: every row of the centred matrix sums to
zero, so with 25 brands and k = 24 the factors give back the matrix itself and
V V^T = I - 1/25, which SQL can state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marquee.functions.common import r6
from marquee.operators import collab as CF
from marquee.operators import content as T
from marquee.plans.content_queries import tfidf
from marquee.plans.fixtures import view, with_views
from marquee.plans.linkage_queries import _FIX_SQL, _V, _bridged
from marquee.plans.registry import register
from marquee.session import written
from marquee.sources.tables import read_table

K = 50
_MODELS: dict = {}


def _cached(spark, key, build):
    """Models of this application, for the input files as they are now."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(key[1])
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stamp = tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen())
                         for s in fs.listStatus(fs_path)))
    k = (spark.sparkContext.applicationId, key, stamp)
    if k not in _MODELS:
        _MODELS[k] = build()
    return _MODELS[k]


def bridged(spark, d):
    return _bridged(spark, d).select("user_id", F.col("catalog_id").alias("item_id"), "rating", "ts")


def model(spark, d):
    """Centred SVD over all bridged ratings (memoised per session and input)."""
    def build():
        b = written(bridged(spark, d), "ratings")  # joined once for the means, the matrix and the mean of all
        m, means = CF.rating_matrix(b, item="item_id")
        svd = CF.truncated_svd(m, K)
        uf, itf = CF.factor_tables(svd, means)
        mu = b.agg(F.avg("rating")).first()[0]
        return {"svd": svd, "users": uf, "items": itf, "mu": float(mu), "k": svd["k"]}
    return _cached(spark, ("svd", d), build)


def liked_lists(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    k = F.col("n_nationkey")
    ids = F.array((k * 61).cast("bigint"), (k * 61 + 5).cast("bigint"), (k * 13 + 1000).cast("bigint"),
                  (k * 61).cast("bigint"))
    return n.select(k.cast("bigint").alias("request_id"), F.explode(ids).alias("item_id")).distinct()


# -------------------------------------------------------- R1 / W4 / A29 / A30
_MU_SQL = ("mu", "SELECT user_id, avg(rating) AS mu, count(*) AS n FROM bridged GROUP BY user_id")


@register("rating_matrix", with_views(_V, *_FIX_SQL, _MU_SQL, final="""
SELECT b.user_id, b.catalog_id AS item_id, round(sum(b.rating - m.mu), 6) AS value
FROM bridged b JOIN mu m USING (user_id) GROUP BY 1, 2"""))
def q_rating_matrix(spark, d):
    m, _ = CF.rating_matrix(bridged(spark, d), item="item_id")
    return m.select("user_id", "item_id", r6("value").alias("value"))


@register("center_ratings", with_views(_V, *_FIX_SQL, _MU_SQL, final="""
SELECT b.user_id, b.catalog_id AS item_id, b.ts, round(b.rating - m.mu, 6) AS centered
FROM bridged b JOIN mu m USING (user_id)"""))
def q_center_ratings(spark, d):
    b = bridged(spark, d)
    means = b.groupBy("user_id").agg(F.avg("rating").alias("mu"))
    return b.join(means, "user_id").select("user_id", "item_id", "ts",
                                           r6(F.col("rating") - F.col("mu")).alias("centered"))


@register("user_means", with_views(_V, *_FIX_SQL, _MU_SQL, final="""
SELECT user_id, round(mu, 6) AS mu, n, round((SELECT avg(rating) FROM bridged), 6) AS global_mean FROM mu"""))
def q_user_means(spark, d):
    b = bridged(spark, d)
    g = b.agg(F.avg("rating").alias("global_mean"))
    means = b.groupBy("user_id").agg(F.avg("rating").alias("mu"), F.count(F.lit(1)).alias("n"))
    out = means.join(F.broadcast(g), how="inner", on=F.lit(True))
    return out.select("user_id", r6("mu").alias("mu"), "n", r6("global_mean").alias("global_mean"))


@register("matrix_status", with_views(_V, *_FIX_SQL, ("e", "SELECT DISTINCT user_id, catalog_id FROM bridged"),
                                      final="""
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT catalog_id) AS n_items, count(*) AS nnz,
       round(1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT catalog_id)), 6) AS sparsity FROM e"""))
def q_matrix_status(spark, d):
    m, _ = CF.rating_matrix(bridged(spark, d), item="item_id")
    return CF.matrix_status(m)


@register("minmax_norm", with_views(["film"], final="""
SELECT id, round(CASE WHEN mx > mn THEN (budget - mn) / (mx - mn) ELSE 0 END, 6) AS norm
FROM film, (SELECT min(budget) AS mn, max(budget) AS mx FROM film)"""))
def q_minmax_norm(spark, d):
    return CF.minmax_norm(view(spark, d, "film"), "budget").select("id", r6("norm").alias("norm"))


# ------------------------------------------------------------ R2 - R6
@register("svd_item_factors")
def q_svd_item_factors(spark, d):
    m = model(spark, d)
    return m["items"].select("item_id", F.size("v").alias("k"),
                             F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@register("svd_user_factors")
def q_svd_user_factors(spark, d):
    m = model(spark, d)
    return m["users"].select("user_id", r6("mu").alias("mu"), F.size("us").alias("k"))


@register("svd_singular_values")
def q_svd_singular_values(spark, d):
    s = model(spark, d)["svd"]["sigma"]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "idx int, sigma double")


def predict_requests(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    k = F.col("n_nationkey")
    return n.select(k.cast("bigint").alias("request_id"), (k * 53).cast("bigint").alias("user_id"),
                    (k * 71).cast("bigint").alias("item_id"))


@register("predict_rating")
def q_predict_rating(spark, d):
    m = model(spark, d)
    return CF.predict_rating(m["users"], m["items"], predict_requests(spark, d))


def rec_users(spark, d):
    return read_table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))


@register("recommend_users")
def q_recommend_users(spark, d):
    m = model(spark, d)
    seen = bridged(spark, d).select("user_id", "item_id").distinct()
    return CF.recommend_users(m["users"], m["items"], rec_users(spark, d), seen, 10)


@register("fold_in_scores")
def q_fold_in_scores(spark, d):
    m = model(spark, d)
    return CF.fold_in_scores(m["items"], liked_lists(spark, d), m["mu"], m["k"])


def _catalog_ids(spark, d):
    return view(spark, d, "catalog").select("id")


def _cf(spark, d):
    m = model(spark, d)
    return CF.cf_scores(m["items"], liked_lists(spark, d), _catalog_ids(spark, d), m["mu"], m["k"])


def _weights(spark, d):
    """TF-IDF weights, for content scores and explanations (memoised per session and input)."""
    return _cached(spark, ("tfidf", d), lambda: tfidf(spark, d, keep=True)["weights"])


def _content(spark, d):
    w = _weights(spark, d)
    return T.content_scores(w, liked_lists(spark, d), _catalog_ids(spark, d))


@register("cf_scores")
def q_cf_scores(spark, d):
    return _cf(spark, d)


# ------------------------------------------- R2 - R5 where SQL can state them
def brand_ratings(spark, d):
    part = read_table(spark, d, "part", "p_partkey", "p_brand")
    return bridged(spark, d).join(part, F.col("item_id") == F.col("p_partkey")).select(
        "user_id", F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint").alias("item_id"), "rating")


def brand_model(spark, d):
    def build():
        b = written(brand_ratings(spark, d), "ratings")
        m, means = CF.rating_matrix(b, item="item_id")
        svd = CF.truncated_svd(m, K)
        uf, itf = CF.factor_tables(svd, means)
        return {"users": uf, "items": itf, "mu": float(b.agg(F.avg("rating")).first()[0]), "k": svd["k"]}
    return _cached(spark, ("brands", d), build)


def brand_likes(spark, d):
    """Each nation (a request) likes the brands that more of its parts have than its brands do on average."""
    part = read_table(spark, d, "part", "p_partkey", "p_brand")
    n = (part.groupBy(F.pmod("p_partkey", F.lit(25)).alias("nk"),
                      F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint").alias("item_id"))
         .agg(F.count(F.lit(1)).alias("n")))
    mean = n.groupBy("nk").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("brands"))
    over = n.join(mean, "nk").where(F.col("n") * F.col("brands") > F.col("total"))
    nation = read_table(spark, d, "nation", "n_nationkey")
    return nation.join(over, F.col("n_nationkey") == F.col("nk")).select(
        F.col("n_nationkey").cast("bigint").alias("request_id"), "item_id")


_BRAND_SQL = [*_FIX_SQL, ("br", """
  SELECT b.user_id, CAST(regexp_extract(p.p_brand, '[0-9]+') AS BIGINT) AS item_id, b.rating
  FROM bridged b JOIN part p ON p.p_partkey = b.catalog_id"""),
    ("um", "SELECT user_id, avg(rating) AS mu FROM br GROUP BY user_id"),
    ("items", "SELECT DISTINCT item_id FROM br"),
    ("e", """SELECT b.user_id, b.item_id, sum(b.rating - m.mu) AS value FROM br b JOIN um m USING (user_id)
             GROUP BY b.user_id, b.item_id""")]


@register("svd_scores_full_rank", with_views(_V, *_BRAND_SQL, final="""
SELECT m.user_id, i.item_id, round(m.mu + coalesce(e.value, 0), 6) AS score
FROM um m CROSS JOIN items i LEFT JOIN e ON e.user_id = m.user_id AND e.item_id = i.item_id"""))
def q_svd_scores_full_rank(spark, d):
    m = brand_model(spark, d)
    s = CF.score_requests(m["items"], m["users"].withColumnRenamed("user_id", "request_id"), "us", "mu")
    return s.select(F.col("request_id").alias("user_id"), "item_id", r6("score").alias("score"))


@register("recommend_users_full_rank", with_views(_V, *_BRAND_SQL, final="""
SELECT user_id, item_id, round(least(greatest(mu, 0.5), 5.0), 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT m.user_id, i.item_id, m.mu, row_number() OVER (PARTITION BY m.user_id ORDER BY i.item_id) AS rank
  FROM um m CROSS JOIN items i
  WHERE (m.user_id, i.item_id) NOT IN (SELECT user_id, item_id FROM br))
WHERE rank <= 10"""))
def q_recommend_users_full_rank(spark, d):
    m = brand_model(spark, d)
    seen = brand_ratings(spark, d).select("user_id", "item_id").distinct()
    r = CF.recommend_users(m["users"], m["items"], rec_users(spark, d), seen, 10)
    return r.select("user_id", "item_id", r6("score").alias("score"), "rank")


_BRAND_LIKES_SQL = [("bn", """
  SELECT p_partkey % 25 AS nk, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS item_id, count(*) AS n
  FROM part GROUP BY 1, 2"""), ("lk", """
  SELECT CAST(n.n_nationkey AS BIGINT) AS request_id, b.item_id FROM nation n JOIN (
    SELECT *, sum(n) OVER (PARTITION BY nk) AS total, count(*) OVER (PARTITION BY nk) AS brands FROM bn) b
  ON b.nk = n.n_nationkey WHERE b.n * b.brands > b.total""")]

_FOLD_IN_SQL = [("g", "SELECT avg(rating) AS mu FROM br"), ("fold", """
  SELECT r.request_id, i.item_id, g.mu + (5.0 - g.mu) * ((l.item_id IS NOT NULL)::INT - r.n / c.n) AS raw
  FROM (SELECT k.request_id, count(*) AS n FROM lk k JOIN items USING (item_id) GROUP BY 1) r
  CROSS JOIN items i CROSS JOIN g CROSS JOIN (SELECT count(*) AS n FROM items) c
  LEFT JOIN lk l ON l.request_id = r.request_id AND l.item_id = i.item_id""")]


@register("fold_in_full_rank", with_views(_V, *_BRAND_SQL, *_BRAND_LIKES_SQL, *_FOLD_IN_SQL, final="""
SELECT request_id, item_id, round(raw, 6) AS score FROM fold"""))
def q_fold_in_full_rank(spark, d):
    m = brand_model(spark, d)
    s = CF.fold_in_scores(m["items"], brand_likes(spark, d), m["mu"], m["k"])
    return s.select("request_id", "item_id", r6("score").alias("score"))


@register("predict_full_rank", with_views(_V, *_BRAND_SQL, ("rq", """
  SELECT CAST(c_custkey AS BIGINT) AS request_id, CAST(c_custkey AS BIGINT) AS user_id,
         CAST(c_custkey % 27 AS BIGINT) AS item_id FROM customer"""), ("p", """
  SELECT r.*, m.mu IS NOT NULL AS has_user, i.item_id IS NOT NULL AS has_item,
         least(greatest(m.mu + coalesce(e.value, 0), 0.5), 5.0) AS x
  FROM rq r LEFT JOIN um m USING (user_id) LEFT JOIN items i ON i.item_id = r.item_id
  LEFT JOIN e ON e.user_id = r.user_id AND e.item_id = r.item_id"""), ("f", """
  SELECT *, CASE WHEN has_user AND has_item THEN floor(round(x, 9) * 100 + 0.500001) / 100 END AS predicted FROM p"""),
    final="""
SELECT request_id, user_id, item_id, predicted, predicted * 2 AS predicted_10,
       CASE WHEN NOT has_user THEN 'unknown_user' WHEN NOT has_item THEN 'unknown_item' ELSE 'ok' END AS reason FROM f"""))
def q_predict_full_rank(spark, d):
    m = brand_model(spark, d)
    c = read_table(spark, d, "customer", "c_custkey")
    requests = c.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("user_id"),
                        F.pmod("c_custkey", F.lit(27)).alias("item_id"))
    return CF.predict_rating(m["users"], m["items"], requests)


# ------------------------------------------------------------ R7 - R9, U1-U4
def _hybrid(spark, d, alpha=0.5, content=None):
    m = model(spark, d)
    return CF.hybrid_topn(_content(spark, d) if content is None else content, m["items"], liked_lists(spark, d),
                          _catalog_ids(spark, d), m["mu"], m["k"], alpha, 20)


def _cf_tops(items, liked, catalog_ids, mu, k):
    """Largest normalised collaborative score of each request, as ``hybrid_status`` reads it."""
    vectors = CF.fold_in_vectors(items, liked, mu, k)
    return CF.cf_ranges(items, vectors, catalog_ids, mu).select("request_id", F.col("top").alias("norm"))


@register("hybrid_recommend")
def q_hybrid_recommend(spark, d):
    return _hybrid(spark, d)


_LIKED_SQL = ("liked", """
  SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS request_id, unnest([CAST(n_nationkey * 61 AS BIGINT),
         CAST(n_nationkey * 61 + 5 AS BIGINT), CAST(n_nationkey * 13 + 1000 AS BIGINT)]) AS item_id
  FROM nation""")


def _hybrid_content_sql():
    from marquee.plans.content_queries import _TFIDF_SQL, _W_SQL
    return [*_TFIDF_SQL, *_W_SQL, _LIKED_SQL, ("ss", """
  SELECT s.request_id, s.item_id AS seed_id, b.id AS item_id, sum(a.w * b.w) AS sim
  FROM liked s JOIN w a ON a.id = s.item_id JOIN w b ON a.term = b.term
  GROUP BY 1, 2, 3 HAVING b.id <> s.item_id"""), ("raw", """
  SELECT request_id, item_id, sum(sim) AS raw FROM ss
  WHERE sim > 0 AND item_id IN (SELECT id FROM catalog) GROUP BY 1, 2"""), ("per", """
  SELECT request_id, CASE WHEN count(*) < (SELECT count(*) FROM catalog) THEN 0.0 ELSE min(raw) END AS lo,
         max(raw) AS hi FROM raw GROUP BY request_id"""), ("cs", """
  SELECT r.request_id, r.item_id, CASE WHEN p.hi > p.lo THEN (r.raw - p.lo) / (p.hi - p.lo) ELSE 0 END AS score
  FROM raw r JOIN per p USING (request_id)""")]


@register("hybrid_content_only", with_views(["doc", "catalog"], *_hybrid_content_sql(), final="""
SELECT request_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM cs WHERE score > 0 AND (request_id, item_id) NOT IN (SELECT request_id, item_id FROM liked))
WHERE rank <= 20"""))
def q_hybrid_content_only(spark, d):
    c = _content(spark, d)
    empty_cf = c.limit(0).select("request_id", "item_id", F.col("norm"), F.col("zero_norm"))
    h = CF.hybrid_recommend(c, empty_cf, liked_lists(spark, d), _catalog_ids(spark, d), 0.0, 20)
    return h.select("request_id", "item_id", r6("score").alias("score"), "rank")


def _content_index(spark, d):
    return view(spark, d, "doc").where(F.col("original_language") == "en").select("id")


def _cf_index(spark, d):
    return bridged(spark, d).select(F.col("item_id").alias("id")).distinct()


_INDEX_SQL = [("ci", "SELECT DISTINCT id FROM doc WHERE original_language = 'en'"),
              ("fi", "SELECT DISTINCT catalog_id AS id FROM bridged")]


@register("seed_coverage", with_views(["doc", *_V], *_FIX_SQL, _LIKED_SQL, *_INDEX_SQL, final="""
SELECT l.request_id, l.item_id, ci.id IS NOT NULL AS in_content, fi.id IS NOT NULL AS in_cf,
       CASE WHEN ci.id IS NOT NULL OR fi.id IS NOT NULL THEN 'used' ELSE 'ignored' END AS status
FROM liked l LEFT JOIN ci ON l.item_id = ci.id LEFT JOIN fi ON l.item_id = fi.id"""))
def q_seed_coverage(spark, d):
    return CF.seed_coverage(liked_lists(spark, d), _content_index(spark, d), _cf_index(spark, d))


@register("engine_coverage", with_views(["doc", *_V], *_FIX_SQL, *_INDEX_SQL, final="""
SELECT (SELECT count(*) FROM ci) AS n_content, (SELECT count(*) FROM fi) AS n_cf,
       (SELECT count(*) FROM (SELECT id FROM ci UNION SELECT id FROM fi)) AS n_union,
       (SELECT count(*) FROM ci JOIN fi USING (id)) AS n_overlap"""))
def q_engine_coverage(spark, d):
    return CF.engine_coverage(_content_index(spark, d), _cf_index(spark, d))


@register("hybrid_status")
def q_hybrid_status(spark, d):
    m, liked = model(spark, d), liked_lists(spark, d)
    content = written(_content(spark, d), "content")
    tops = _cf_tops(m["items"], liked, _catalog_ids(spark, d), m["mu"], m["k"])
    cov = CF.seed_coverage(liked, _content_index(spark, d), _cf_index(spark, d))
    return CF.hybrid_status(cov, content, tops, _hybrid(spark, d, content=content), 0.5)


def _explained(spark, d, recs, liked):
    recs = written(recs.select("request_id", "item_id"), "recs")
    sims = T.seed_scores(_weights(spark, d), liked, recs)  # of recommended items, not of every document
    used = liked.join(_content_index(spark, d).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return CF.explain_recs(recs, sims, used, view(spark, d, "doc").select("id", F.col("overview").alias("title")))


@register("explain_recs")
def q_explain_recs(spark, d):
    return _explained(spark, d, _hybrid(spark, d), liked_lists(spark, d))


# ------------------- R7 - R9 where SQL can state them: brands as collaborative items
def full_rank_likes(spark, d):
    """Brand numbers as liked ids (documents of these numbers are the content side); every second
    request also has an id that no engine covers, every eighth has nothing else."""
    likes = brand_likes(spark, d).where(F.col("request_id") % 8 != 7)
    unknown = read_table(spark, d, "nation", "n_nationkey").where(F.col("n_nationkey") % 2 == 1).select(
        F.col("n_nationkey").cast("bigint").alias("request_id"), (F.col("n_nationkey") + 1_000_000_000).cast("bigint").alias(
            "item_id"))
    return likes.unionByName(unknown)


def _full_rank_hybrid(spark, d, alpha, content=None):
    m, liked = brand_model(spark, d), full_rank_likes(spark, d)
    if content is None:
        content = T.content_scores(_weights(spark, d), liked, _catalog_ids(spark, d))
    return CF.hybrid_topn(content, m["items"], liked, _catalog_ids(spark, d), m["mu"], m["k"], alpha, 20)


def _full_rank_sql(alphas):
    """The dense blend over requests x catalog, for each alpha."""
    likes = ("lk", """
  SELECT * FROM lk0 WHERE request_id % 8 <> 7
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 1000000000 AS BIGINT) FROM nation WHERE n_nationkey % 2 = 1""")
    content = [("liked", "SELECT * FROM lk") if c == _LIKED_SQL else c for c in _hybrid_content_sql()]
    return [*_BRAND_SQL, _BRAND_LIKES_SQL[0], ("lk0", _BRAND_LIKES_SQL[1][1]), likes, *_FOLD_IN_SQL, *content, ("zc", """
  SELECT request_id, CASE WHEN hi > lo THEN (0 - lo) / (hi - lo) ELSE 0 END AS z FROM per"""), ("onshelf", """
  SELECT * FROM fold WHERE item_id IN (SELECT id FROM catalog)"""), ("cends", """
  SELECT request_id, CASE WHEN all_in THEN mn ELSE least(mn, 0) END AS lo, CASE WHEN all_in THEN mx ELSE greatest(mx, 0) END AS hi
  FROM (SELECT request_id, min(raw) AS mn, max(raw) AS mx, count(*) = (SELECT count(*) FROM catalog) AS all_in
        FROM onshelf GROUP BY 1)"""), ("fs", """
  SELECT request_id, item_id, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END AS score FROM onshelf JOIN cends USING (request_id)"""),
        ("zf", "SELECT request_id, CASE WHEN hi > lo THEN (0 - lo) / (hi - lo) ELSE 0 END AS z FROM cends"), ("bl", f"""
  SELECT al.alpha, q.request_id, c.id AS item_id,
         (1 - al.alpha) * coalesce(cs.score, zc.z, 0) + al.alpha * coalesce(fs.score, zf.z, 0) AS score
  FROM (SELECT unnest([{", ".join(f"CAST({a} AS DOUBLE)" for a in alphas)}]) AS alpha) al
  CROSS JOIN (SELECT DISTINCT request_id FROM lk) q CROSS JOIN (SELECT DISTINCT id FROM catalog) c
  LEFT JOIN cs ON cs.request_id = q.request_id AND cs.item_id = c.id LEFT JOIN zc ON zc.request_id = q.request_id
  LEFT JOIN fs ON fs.request_id = q.request_id AND fs.item_id = c.id LEFT JOIN zf ON zf.request_id = q.request_id"""),
        ("recs", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, request_id ORDER BY round(score, 9) DESC, item_id) AS rank
                 FROM bl WHERE score > 0 AND (request_id, item_id) NOT IN (SELECT request_id, item_id FROM lk))
  WHERE rank <= 20""")]


_HV = ["doc", *_V]


@register("hybrid_full_rank", with_views(_HV, *_full_rank_sql([0.4]), final="""
SELECT request_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM recs"""))
def q_hybrid_full_rank(spark, d):
    h = _full_rank_hybrid(spark, d, 0.4)
    return h.select("request_id", "item_id", r6("score").alias("score"), "rank")


@register("hybrid_status_full_rank", with_views(_HV, *_full_rank_sql([0.0, 0.4, 1.0]), _INDEX_SQL[0], ("cov", """
  SELECT request_id, count_if(k) AS n_used, count_if(NOT k) AS n_ignored FROM (
    SELECT request_id, item_id IN (SELECT id FROM ci) OR item_id IN (SELECT item_id FROM items) AS k FROM lk) GROUP BY 1"""),
    ("hints", """
  SELECT a.alpha, v.*, (SELECT count(*) FROM recs r WHERE r.request_id = v.request_id AND r.alpha = a.alpha) AS n_recs,
         coalesce((SELECT max(score) > 0 FROM cs WHERE cs.request_id = v.request_id), false) AS content_has,
         coalesce((SELECT max(score) > 0 FROM fs WHERE fs.request_id = v.request_id), false) AS cf_has
  FROM cov v CROSS JOIN (SELECT DISTINCT alpha FROM bl) a"""), final="""
SELECT alpha, request_id, n_used, n_ignored, n_recs, content_has, cf_has,
       CASE WHEN n_used = 0 THEN 'no_seed_covered' WHEN n_recs > 0 THEN 'ok'
            WHEN alpha >= 1 AND content_has AND NOT cf_has THEN 'move_to_content'
            WHEN alpha <= 0 AND cf_has AND NOT content_has THEN 'move_to_collaborative' ELSE 'no_signal' END AS status
FROM hints"""))
def q_hybrid_status_full_rank(spark, d):
    m, liked = brand_model(spark, d), full_rank_likes(spark, d)
    content = written(T.content_scores(_weights(spark, d), liked, _catalog_ids(spark, d)), "content")
    tops = written(_cf_tops(m["items"], liked, _catalog_ids(spark, d), m["mu"], m["k"]), "tops")
    cov = CF.seed_coverage(liked, _content_index(spark, d), m["items"].select(F.col("item_id").alias("id")))
    out = None
    for alpha in (0.0, 0.4, 1.0):
        s = CF.hybrid_status(cov, content, tops, _full_rank_hybrid(spark, d, alpha, content), alpha)
        s = s.select(F.lit(alpha).alias("alpha"), "*")
        out = s if out is None else out.unionByName(s)
    return out


@register("explain_recs_full_rank", with_views(_HV, *_full_rank_sql([0.4]), _INDEX_SQL[0], ("ex", """
  SELECT s.*, row_number() OVER (PARTITION BY s.request_id, s.item_id ORDER BY round(s.sim, 9) DESC, s.seed_id) AS n
  FROM ss s JOIN recs r ON r.request_id = s.request_id AND r.item_id = s.item_id WHERE s.seed_id IN (SELECT id FROM ci)"""),
    final="""
SELECT ex.request_id, ex.item_id, ex.seed_id AS source_id, round(ex.sim, 3) AS sim, doc.overview AS source_title
FROM ex LEFT JOIN doc ON doc.id = ex.seed_id WHERE n = 1 AND ex.sim > 0"""))
def q_explain_recs_full_rank(spark, d):
    return _explained(spark, d, _full_rank_hybrid(spark, d, 0.4), full_rank_likes(spark, d))


# ------------------------------------------------------------ R11 - R15
def split(spark, d):
    return CF.split_flag(bridged(spark, d), ["user_id", "item_id", "ts", "rating"], 42, 20)


_SPLIT_SQL = [("sp", """
  SELECT user_id, catalog_id AS item_id, rating, ts,
         ('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR) || ':' || CAST(catalog_id AS VARCHAR) || ':'
                 || strftime(ts, '%Y-%m-%d %H:%M:%S') || ':' || CAST(rating AS VARCHAR)), 1, 8))::BIGINT % 100 < 20
           AS is_test
  FROM bridged"""),
    ("train", "SELECT * FROM sp WHERE NOT is_test"), ("test", "SELECT * FROM sp WHERE is_test"),
    ("serv", """SELECT * FROM test WHERE user_id IN (SELECT user_id FROM train)
                AND item_id IN (SELECT item_id FROM train)""")]


@register("split_counts", with_views(_V, *_FIX_SQL, *_SPLIT_SQL, final="""
SELECT is_test, count(*) AS n FROM sp GROUP BY is_test"""))
def q_split_counts(spark, d):
    return split(spark, d).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@register("servable_rate", with_views(_V, *_FIX_SQL, *_SPLIT_SQL, final="""
SELECT (SELECT count(*) FROM test) AS n_test, (SELECT count(*) FROM serv) AS n_servable,
       round((SELECT count(*) FROM serv) / (SELECT count(*) FROM test), 6) AS rate"""))
def q_servable_rate(spark, d):
    s = split(spark, d)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    sv = CF.servable(test, train)
    a = test.agg(F.count(F.lit(1)).alias("n_test"))
    b = sv.agg(F.count(F.lit(1)).alias("n_servable"))
    j = a.join(b, how="inner", on=F.lit(True))
    return j.select("n_test", "n_servable", r6(F.col("n_servable") / F.col("n_test")).alias("rate"))


@register("rating_error", with_views(_V, *_FIX_SQL, *_SPLIT_SQL, ("um", """
  SELECT user_id, avg(rating) AS mu FROM train GROUP BY user_id"""), final="""
SELECT count(*) AS n, round(sqrt(avg((m.mu - s.rating) * (m.mu - s.rating))), 6) AS rmse,
       round(avg(abs(m.mu - s.rating)), 6) AS mae
FROM serv s JOIN um m USING (user_id)"""))
def q_rating_error(spark, d):
    s = split(spark, d)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    um = train.groupBy("user_id").agg(F.avg("rating").alias("predicted"))
    e = CF.rating_error(CF.servable(test, train).join(um, "user_id"))
    return e.select("n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


def _eval_model(spark, d):
    def build():
        s = written(split(spark, d), "split")
        train = s.where(~F.col("is_test"))
        m, means = CF.rating_matrix(train, item="item_id")
        svd = CF.truncated_svd(m, K)
        uf, itf = CF.factor_tables(svd, means)
        return {"users": uf, "items": itf, "train": train, "test": s.where(F.col("is_test"))}
    return _cached(spark, ("eval", d), build)


@register("rating_error_svd")
def q_rating_error_svd(spark, d):
    m = _eval_model(spark, d)
    sv = CF.servable(m["test"], m["train"])
    pairs = sv.select("user_id", "item_id").distinct().withColumn("request_id", F.lit(0).cast("bigint"))
    p = CF.predict_rating(m["users"], m["items"], pairs)
    return CF.rating_error(sv.join(p.select("user_id", "item_id", "predicted"), ["user_id", "item_id"]))


@register("precision_at_k", with_views(_V, *_FIX_SQL, *_SPLIT_SQL,
                                       ("lk", "SELECT DISTINCT user_id, item_id FROM serv WHERE rating >= 4.0"),
                                       ("elig", "SELECT user_id FROM lk GROUP BY user_id HAVING count(*) >= 5"),
                                       ("pop", """SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS pr
                                                  FROM train GROUP BY item_id"""),
                                       ("seen", "SELECT DISTINCT user_id, item_id FROM train"),
                                       ("recs", """
  SELECT user_id, item_id FROM (
    SELECT e.user_id, p.item_id, row_number() OVER (PARTITION BY e.user_id ORDER BY p.pr) AS rk
    FROM elig e CROSS JOIN pop p
    WHERE (e.user_id, p.item_id) NOT IN (SELECT user_id, item_id FROM seen)) WHERE rk <= 10"""),
                                       ("hits", """
  SELECT e.user_id, count(l.item_id) AS hits FROM elig e
  LEFT JOIN (SELECT r.user_id, r.item_id FROM recs r JOIN lk USING (user_id, item_id)) l USING (user_id)
  GROUP BY e.user_id"""), final="""
SELECT count(*) AS n_users, round(avg(hits / 10), 6) AS precision, CAST(sum(hits) AS BIGINT) AS total_hits FROM hits"""))
def q_precision_at_k(spark, d):
    s = split(spark, d)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    sv = CF.servable(test, train)
    users = sv.where(F.col("rating") >= 4.0).select("user_id").distinct()
    recs = CF.popularity_recs(train, users, 10)
    p = CF.precision_at_k(recs, sv, 10)
    return p.select("n_users", r6("precision").alias("precision"), "total_hits")


@register("precision_at_k_svd")
def q_precision_at_k_svd(spark, d):
    m = _eval_model(spark, d)
    sv = CF.servable(m["test"], m["train"])
    users = sv.where(F.col("rating") >= 4.0).select("user_id").distinct()
    seen = m["train"].select("user_id", "item_id").distinct()
    recs = CF.recommend_users(m["users"], m["items"], users, seen, 10)
    return CF.precision_at_k(recs, sv, 10)


@register("random_precision", with_views(_V, *_FIX_SQL, *_SPLIT_SQL,
                                         ("lk", "SELECT DISTINCT user_id, item_id FROM serv WHERE rating >= 4.0"),
                                         ("elig", "SELECT user_id, count(*) AS l FROM lk GROUP BY user_id HAVING count(*) >= 5"),
                                         ("seen", "SELECT user_id, count(DISTINCT item_id) AS s FROM train GROUP BY user_id"),
                                         final="""
SELECT count(*) AS n_users,
       round(avg(e.l / ((SELECT count(DISTINCT item_id) FROM train) - s.s)), 6) AS random_precision
FROM elig e JOIN seen s USING (user_id)"""))
def q_random_precision(spark, d):
    s = split(spark, d)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    r = CF.random_precision(train, CF.servable(test, train))
    return r.select("n_users", r6("random_precision").alias("random_precision"))


# ------------------------------------------------------------ R10 / T9
@register("svd_uncentered")
def q_svd_uncentered(spark, d):
    def build():
        b = bridged(spark, d).where((F.col("rating") > 0) & (F.col("ts") <= F.lit("1998-07-19")))
        b = written(CF.split_flag(b, ["user_id", "item_id", "ts", "rating"], 42, 5).where("is_test").drop("is_test"), "ratings")
        m, means = CF.rating_matrix(b, item="item_id", center=False)
        svd = CF.truncated_svd(m, K)
        uf, itf = CF.factor_tables(svd, means.withColumn("mu", F.lit(0.0)))
        return {"users": uf, "items": itf, "seen": b.select("user_id", "item_id").distinct()}
    mm = _cached(spark, ("uncentered", d), build)
    users = mm["seen"].select("user_id").distinct()
    return CF.recommend_users(mm["users"], mm["items"], users, mm["seen"], 10, lo=-np.inf, hi=np.inf)


@register("genre_svd_similarity")
def q_genre_svd_similarity(spark, d):
    from marquee.operators.content import genre_svd_embeddings
    items = view(spark, d, "catalog")
    emb, _ = genre_svd_embeddings(items, 10)
    n = read_table(spark, d, "nation", "n_nationkey")
    req = n.select(F.col("n_nationkey").cast("long").alias("request_id"),
                   (F.col("n_nationkey") * 79).cast("long").alias("item_id"))
    return T.embedding_knn(emb, req, 5, id_col="id", vec_col="vec").drop("item_id")
