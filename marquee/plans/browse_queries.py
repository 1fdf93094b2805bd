"""Registered browse queries (O1-O7, P23, P24, S10) over the cleaned film
catalog. Search and lookup requests are derived from the ``nation`` table
(one request per nation row), so they are data, not literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.common import r6
from marquee.operators import browse as B
from marquee.plans.cleaning_queries import CATALOG_CTES, clean_film_catalog
from marquee.plans.fixtures import with_views
from marquee.plans.registry import register
from marquee.sources.tables import read_table

PER_PAGE = 24


def _cat(spark, d, scored=False):
    return clean_film_catalog(spark, d, scored)


def search_requests(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    q = F.when(F.col("n_nationkey") == 0, F.lit(" ")).otherwise(
        F.concat(F.lit("#"), (F.col("n_nationkey") * 41).cast("string")))
    return n.select(F.col("n_nationkey").cast("bigint").alias("query_id"), q.alias("q"))


def lookup_requests(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey")
    return n.select(F.col("n_nationkey").cast("bigint").alias("request_id"),
                    (F.col("n_nationkey") * 997).cast("bigint").alias("item_id"))


_SEARCH_SQL = [
    ("q", """SELECT CAST(n_nationkey AS BIGINT) AS query_id,
              CASE WHEN n_nationkey = 0 THEN ' ' ELSE '#' || CAST(n_nationkey * 41 AS VARCHAR) END AS q
       FROM nation"""),
    ("qn", "SELECT query_id, regexp_replace(lower(q), '[^a-z0-9]', '', 'g') AS q_norm FROM q"),
    ("hits", """SELECT qn.query_id, qn.q_norm, c.* FROM qn JOIN cat c ON contains(c.title_norm, qn.q_norm)"""),
]


def _pages_sql(order):
    return f"""
SELECT id, load_seq, position, CAST(floor((position - 1) / {PER_PAGE}) + 1 AS BIGINT) AS page FROM (
  SELECT id, load_seq, row_number() OVER (ORDER BY {order}, id, load_seq) AS position FROM cat)"""


@register("browse_popular", with_views(["dirty_film"], *CATALOG_CTES,
                                       final=_pages_sql("weighted_score DESC NULLS LAST")))
def q_browse_popular(spark, d):
    return B.browse_pages(_cat(spark, d, scored=True), "popular", PER_PAGE).select("id", "load_seq", "position", "page")


@register("browse_rate", with_views(["dirty_film"], *CATALOG_CTES,
                                    final=_pages_sql("vote_average DESC NULLS LAST")))
def q_browse_rate(spark, d):
    return B.browse_pages(_cat(spark, d), "rate", PER_PAGE).select("id", "load_seq", "position", "page")


@register("browse_date", with_views(["dirty_film"], *CATALOG_CTES,
                                    final=_pages_sql("release_year DESC NULLS LAST")))
def q_browse_date(spark, d):
    return B.browse_pages(_cat(spark, d), "date", PER_PAGE).select("id", "load_seq", "position", "page")


@register("browse_normal", with_views(["dirty_film"], *CATALOG_CTES,
                                      final=_pages_sql("load_seq")))
def q_browse_normal(spark, d):
    return B.browse_pages(_cat(spark, d), "normal", PER_PAGE).select("id", "load_seq", "position", "page")


@register("browse_page", with_views(["dirty_film"], *CATALOG_CTES, final="""
SELECT id, load_seq, title FROM cat
ORDER BY weighted_score DESC NULLS LAST, id, load_seq LIMIT 24 OFFSET 48"""))
def q_browse_page(spark, d):
    return B.browse_page(_cat(spark, d, scored=True), "popular", 3, PER_PAGE).select("id", "load_seq", "title")


@register("browse_genre", with_views(["dirty_film"], *CATALOG_CTES, final="""
SELECT id, load_seq FROM cat WHERE list_contains(genres_list, 'HIGH')"""))
def q_browse_genre(spark, d):
    return B.category_filter(_cat(spark, d), "HIGH").select("id", "load_seq")


@register("browse_page_meta", with_views(["dirty_film"], *CATALOG_CTES, final=f"""
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / {PER_PAGE})) AS BIGINT) AS total_pages
FROM cat WHERE list_contains(genres_list, 'HIGH')"""))
def q_browse_page_meta(spark, d):
    return B.page_meta(B.category_filter(_cat(spark, d), "HIGH"), PER_PAGE)


@register("search_title", with_views(["dirty_film"], *CATALOG_CTES, *_SEARCH_SQL, final="""
SELECT query_id, q_norm, id, load_seq, title FROM hits"""))
def q_search_title(spark, d):
    hits = B.search_title(_cat(spark, d), search_requests(spark, d), ("id", "load_seq"))
    return hits.select("query_id", "q_norm", "id", "load_seq", "title")


@register("suggest_titles", with_views(["dirty_film"], *CATALOG_CTES, *_SEARCH_SQL, final="""
SELECT query_id, id, load_seq, title, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY load_seq, id) AS rank FROM hits)
WHERE rank <= 5"""))
def q_suggest_titles(spark, d):
    s = B.suggest_titles(_cat(spark, d), search_requests(spark, d), 5, "normal", ("id", "load_seq"))
    return s.select("query_id", "id", "load_seq", "title", "rank")


def _full(spark, d):
    """The catalog with every column the payloads can carry, made of its own ones."""
    i = F.col("id")
    return _cat(spark, d).select(
        "*", F.when(i % 5 > 0, F.concat(F.lit("About "), "title")).alias("overview"),
        F.when(i % 3 > 0, F.array("title_norm", F.lit("film"))).alias("keywords_list"),
        F.when(i % 4 > 0, F.array("title")).alias("top_cast_list"),
        F.element_at(F.split("title", " "), 1).alias("director"),
        F.when(F.col("budget") > 0, F.col("revenue") / F.col("budget")).alias("roi"),
        (F.col("revenue") - F.col("budget")).alias("profit"), (F.col("vote_count") * 1.5).alias("popularity"),
        F.when(i % 2 == 0, F.lit("en")).otherwise(F.lit("fr")).alias("original_language"),
        F.col("primary_genre").alias("countries"), F.concat(F.lit("/p/"), i.cast("string")).alias("poster_url"))


_FULL_SQL = ("payload", """
  SELECT *, CASE WHEN id % 5 > 0 THEN 'About ' || title END AS overview,
         CASE WHEN id % 3 > 0 THEN [title_norm, 'film'] END AS keywords_list,
         CASE WHEN id % 4 > 0 THEN [title] END AS top_cast_list, string_split(title, ' ')[1] AS director,
         CASE WHEN budget > 0 THEN revenue / budget END AS roi, revenue - budget AS profit,
         vote_count * 1.5 AS popularity, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END AS original_language,
         primary_genre AS countries, '/p/' || CAST(id AS VARCHAR) AS poster_url FROM cat""")


@register("list_projection", with_views(["dirty_film"], *CATALOG_CTES, _FULL_SQL, final="""
SELECT id, title, release_year, primary_genre, round(vote_average, 6) AS vote_average, poster_url FROM payload"""))
def q_list_projection(spark, d):
    p = B.list_projection(_full(spark, d))
    return p.withColumn("vote_average", r6("vote_average"))


_NUMBERS = ("vote_average", "vote_count", "runtime", "budget", "revenue", "profit", "roi", "popularity")
_LISTS = ("genres", "keywords", "top_cast")


@register("detail_projection", with_views(["dirty_film"], *CATALOG_CTES, _FULL_SQL, final=f"""
SELECT id, title, release_year, release_decade, primary_genre, coalesce(overview, '') AS overview, director,
       original_language, countries, poster_url,
       {", ".join(f"array_to_string(coalesce({c}_list, []), ',') AS {c}" for c in _LISTS)},
       {", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS)}
FROM payload"""))
def q_detail_projection(spark, d):
    p = B.detail_projection(_full(spark, d))
    return p.select(*[r6(c).alias(c) if c in _NUMBERS else F.array_join(c, ",").alias(c) if c in _LISTS else F.col(c)
                      for c in p.columns])


@register("lookup_item", with_views(["dirty_film"], *CATALOG_CTES, ("r", """
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey * 997 AS BIGINT) AS item_id
  FROM nation"""), final="""
SELECT r.request_id, r.item_id, c.load_seq, c.title, c.load_seq IS NOT NULL AS found
FROM r LEFT JOIN cat c ON r.item_id = c.id"""))
def q_lookup_item(spark, d):
    out = B.lookup_items(_cat(spark, d), lookup_requests(spark, d))
    return out.select("request_id", "item_id", "load_seq", "title", "found")


@register("category_dim", with_views(["dirty_film"], *CATALOG_CTES, final="""
SELECT DISTINCT unnest(genres_list) AS genre FROM cat"""))
def q_category_dim(spark, d):
    return B.category_dim(_cat(spark, d))
