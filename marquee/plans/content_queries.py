"""Registered content-similarity queries.

Items with text are the ``doc`` view (documents); seeds are the labelled
English documents (``labels``), grouped into four requests by label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.common import r6, rounded
from marquee.operators import content as T
from marquee.plans.fixtures import view, with_views
from marquee.plans.registry import register
from marquee.sources.tables import read_table

_sw = T.english_stop_words()
_sw_sql = ", ".join("'" + w.replace("'", "''") + "'" for w in _sw)
_PAT_SQL = r"[\p{L}\p{N}_]{2,}"


def tfidf(spark, d, max_features=20000, keep=False):
    return T.build_tfidf(view(spark, d, "doc"), "en", max_features=max_features, keep=keep)


def seed_requests(spark, d):
    """(request_id, item_id): labelled English documents; request = label pair."""
    lab = read_table(spark, d, "labels", "doc_id", "quality", "toxic")
    en = read_table(spark, d, "documents", "doc_id", "lang").where(F.col("lang") == "en")
    j = lab.join(en, "doc_id", "left_semi")
    return j.select((F.col("quality") * 2 + F.col("toxic")).cast("bigint").alias("request_id"),
                    F.col("doc_id").alias("item_id"))


def per_seed_requests(spark, d):
    """One request per labelled English document with quality 1."""
    lab = read_table(spark, d, "labels", "doc_id", "quality")
    en = read_table(spark, d, "documents", "doc_id", "lang").where(F.col("lang") == "en")
    j = lab.where(F.col("quality") == 1).join(en, "doc_id", "left_semi")
    return j.select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("item_id"))


_TFIDF_SQL = [
    ("d", """
  SELECT id, coalesce(overview, '') || ' ' || repeat(array_to_string(genres, ' ') || ' ', 3) || ' '
         || repeat(array_to_string(keywords, ' ') || ' ', 2) || ' '
         || repeat(coalesce(replace(lower(trim(string_split(coalesce(director, ''), '|')[1])), ' ', '_'), '')
                   || ' ', 5) AS doc
  FROM doc WHERE original_language = 'en'"""),
    ("tok", f"SELECT id, unnest(regexp_extract_all(lower(doc), '{_PAT_SQL}')) AS term FROM d"),
    ("tf", f"SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({_sw_sql}) GROUP BY id, term"),
    ("nd", "SELECT count(*) AS n FROM d"),
    ("st", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term"),
]


def _vocab_sql(limit):
    return ("vocab", f"""
  SELECT term, df, cf, CAST(row_number() OVER (ORDER BY cf DESC, term) AS INTEGER) AS rank
  FROM st, nd WHERE df >= 2 AND df <= n * 0.8 ORDER BY cf DESC, term LIMIT {limit}""")


_W_SQL = [
    _vocab_sql(20000),
    ("w0", """SELECT tf.id, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w0
              FROM tf JOIN vocab v ON tf.term = v.term, nd"""),
    ("w", "SELECT id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY id)) AS w FROM w0"),
]

_SEEDS_SQL = [
    ("seeds", """SELECT CAST(quality * 2 + toxic AS BIGINT) AS request_id, doc_id AS item_id FROM labels
                 WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"""),
    ("pseeds", """SELECT doc_id AS request_id, doc_id AS item_id FROM labels
                  WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"""),
]


def _scores_sql(seeds):
    return ("ss", f"""
  SELECT s.request_id, s.item_id AS seed_id, b.id AS item_id, sum(a.w * b.w) AS sim
  FROM (SELECT DISTINCT request_id, item_id FROM {seeds}) s
  JOIN w a ON a.id = s.item_id JOIN w b ON a.term = b.term
  GROUP BY 1, 2, 3 HAVING b.id <> s.item_id""")


@register("weighted_document", with_views(["doc"], _TFIDF_SQL[0], final="SELECT id, doc FROM d"))
def q_weighted_document(spark, d):
    return tfidf(spark, d)["docs"]


@register("empty_doc_rate", with_views(["doc"], _TFIDF_SQL[0], final="""
SELECT count(*) AS n_docs, count_if(trim(doc) = '') AS n_empty,
       round(CASE WHEN count(*) > 0 THEN count_if(trim(doc) = '') * 100.0 / count(*) ELSE 0 END, 6) AS pct_empty,
       count_if(trim(doc) = '') * 100.0 > count(*) * 5.0 AS warn
FROM d"""))
def q_empty_doc_rate(spark, d):
    return rounded(T.empty_doc_rate(tfidf(spark, d)["docs"]))


@register("tfidf_tokens", with_views(["doc"], *_TFIDF_SQL, final="SELECT id, term, tf FROM tf"))
def q_tfidf_tokens(spark, d):
    return tfidf(spark, d)["tokens"]


@register("tfidf_vocab", with_views(["doc"], *_TFIDF_SQL, _vocab_sql(20000), final="SELECT * FROM vocab"))
def q_tfidf_vocab(spark, d):
    return tfidf(spark, d)["vocab"]


@register("tfidf_vocab_5k", with_views(["doc"], *_TFIDF_SQL, _vocab_sql(5000), final="SELECT * FROM vocab"))
def q_tfidf_vocab_5k(spark, d):
    return tfidf(spark, d, 5000)["vocab"]


@register("tfidf_weights", with_views(["doc"], *_TFIDF_SQL, *_W_SQL,
                                      final="SELECT id, term, round(w, 6) AS w FROM w"))
def q_tfidf_weights(spark, d):
    w = tfidf(spark, d)["weights"]
    return w.select("id", "term", r6("w").alias("w"))


@register("seed_scores", with_views(["doc"], *_TFIDF_SQL, *_W_SQL, *_SEEDS_SQL, _scores_sql("pseeds"),
                                    final="SELECT request_id, seed_id, item_id, round(sim, 6) AS sim FROM ss"))
def q_seed_scores(spark, d):
    s = T.seed_scores(tfidf(spark, d)["weights"], per_seed_requests(spark, d))
    return s.select("request_id", "seed_id", "item_id", r6("sim").alias("sim"))


@register("similar_items", with_views(["doc"], *_TFIDF_SQL, *_W_SQL, *_SEEDS_SQL, _scores_sql("pseeds"),
                                      final="""
SELECT request_id, seed_id, item_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, seed_id ORDER BY round(sim, 9) DESC, item_id) AS rank
  FROM ss WHERE sim > 0) WHERE rank <= 10"""))
def q_similar_items(spark, d):
    s = T.similar_items(tfidf(spark, d)["weights"], per_seed_requests(spark, d), 10)
    return s.select("request_id", "seed_id", "item_id", r6("sim").alias("sim"), "rank")


@register("content_scores", with_views(["doc"], *_TFIDF_SQL, *_W_SQL, *_SEEDS_SQL, _scores_sql("seeds"),
                                       ("raw", """
  SELECT request_id, item_id, sum(sim) AS raw FROM ss WHERE sim > 0 AND item_id IN (SELECT id FROM doc)
  GROUP BY 1, 2"""), ("per", """
  SELECT request_id, CASE WHEN count(*) < (SELECT count(*) FROM doc) THEN 0.0 ELSE min(raw) END AS lo,
         max(raw) AS hi FROM raw GROUP BY request_id"""), final="""
SELECT r.request_id, r.item_id, round(r.raw, 6) AS raw,
       round(CASE WHEN p.hi > p.lo THEN (r.raw - p.lo) / (p.hi - p.lo) ELSE 0 END, 6) AS norm
FROM raw r JOIN per p USING (request_id)"""))
def q_content_scores(spark, d):
    c = T.content_scores(tfidf(spark, d)["weights"], seed_requests(spark, d),
                         view(spark, d, "doc").select("id"))
    return c.select("request_id", "item_id", r6("raw").alias("raw"), r6("norm").alias("norm"))


@register("embedding_knn", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS request_id, b.vec_id AS neighbor_id, list_cosine_similarity(a.e, b.e) AS sim
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT request_id, neighbor_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(sim, 9) DESC, neighbor_id) AS rank
  FROM p) WHERE rank <= 5""")
def q_embedding_knn(spark, d):
    v = view(spark, d, "vec")
    req = v.select(F.col("vec_id").alias("request_id"), F.col("vec_id").alias("item_id"))
    k = T.embedding_knn(v, req, 5)
    return k.select("request_id", "neighbor_id", r6("sim").alias("sim"), "rank")


def genre_seeds(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    return n.select(F.col("n_nationkey").cast("bigint").alias("request_id"),
                    (F.col("n_nationkey") * 79).cast("bigint").alias("item_id"))


@register("genre_onehot_cosine", with_views(["catalog"], ("it", """
  SELECT id, list_sort(list_distinct(genres)) AS gset FROM catalog"""), ("s", """
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey * 79 AS BIGINT) AS seed_id FROM nation"""),
    ("p", """
  SELECT s.request_id, s.seed_id, b.id AS item_id,
         len(list_intersect(a.gset, b.gset)) / sqrt(len(a.gset) * len(b.gset)) AS sim
  FROM s JOIN it a ON a.id = s.seed_id JOIN it b ON b.id <> s.seed_id
  WHERE len(list_intersect(a.gset, b.gset)) > 0"""), final="""
SELECT request_id, seed_id, item_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, seed_id ORDER BY sim DESC, item_id) AS rank FROM p)
WHERE rank <= 10"""))
def q_genre_onehot_cosine(spark, d):
    g = T.genre_onehot_cosine(view(spark, d, "catalog"), genre_seeds(spark, d), 10)
    return g.select("request_id", "seed_id", "item_id", r6("sim").alias("sim"), "rank")


@register("genre_similarity_range", with_views(["catalog"], ("it", """
  SELECT id, list_sort(list_distinct(genres)) AS gset FROM catalog"""), ("p", """
  SELECT len(list_intersect(a.gset, b.gset)) / sqrt(len(a.gset) * len(b.gset)) AS sim
  FROM it a JOIN it b ON a.id < b.id"""), final="""
SELECT round(min(sim), 6) AS min_sim, round(max(sim), 6) AS max_sim,
       (SELECT count(DISTINCT gset) FROM it) AS n_sets FROM p"""))
def q_genre_similarity_range(spark, d):
    return rounded(T.genre_similarity_range(view(spark, d, "catalog")))


@register("director_token", with_views(["film"], final="""
SELECT id, coalesce(replace(lower(trim(string_split(coalesce(director, ''), '|')[1])), ' ', '_'), '') AS token
FROM film"""))
def q_director_token(spark, d):
    from marquee.functions.text import director_token
    return view(spark, d, "film").select("id", director_token("director").alias("token"))
