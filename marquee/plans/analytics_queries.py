"""Registered analytics queries (A1-A20, A26, A33) over the ``film`` view.

Parameters are chosen for the input data (see FIXTURES.md): yearly buckets
(``Y``), top-3 genres, a 1000-film floor per bucket, a 20 000 budget floor
and a 4-vote floor keep some groups and drop others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.common import r6, rounded
from marquee.operators import analytics as A
from marquee.plans.fixtures import view, with_views
from marquee.plans.registry import register
from marquee.sources.tables import read_table

Y = 1            # bucket width in years (decades collapse to two on this data)
TOP = 3
MIN_FILMS = 1000
MIN_BUDGET = 20000
MIN_VOTES = 4
FIXED_GENRES = ("URGENT", "HIGH", "LOW")


def _film(spark, d):
    return view(spark, d, "film")


def _dec(y=Y):
    return f"CAST(floor(release_year / {y}) * {y} AS INTEGER)"


def _top_sql(src="film", n=TOP, name="top"):
    return (name, f"""
  SELECT primary_genre AS genre, count(*) AS n,
         CAST(row_number() OVER (ORDER BY count(*) DESC, primary_genre) AS INTEGER) AS genre_rank
  FROM {src} WHERE primary_genre IS NOT NULL
  GROUP BY primary_genre ORDER BY n DESC, genre LIMIT {n}""")


def _matrix_ctes(min_films, y=Y, n=TOP):
    return [
        _top_sql(n=n),
        ("cnt", f"""
  SELECT {_dec(y)} AS decade, primary_genre AS genre, count(*) AS n
  FROM film WHERE release_year IS NOT NULL AND primary_genre IN (SELECT genre FROM top)
  GROUP BY 1, 2"""),
        ("dec", f"SELECT decade, sum(n) AS total FROM cnt GROUP BY decade HAVING sum(n) >= {min_films}"),
        ("matrix", """
  SELECT d.decade, t.genre, t.genre_rank, CAST(coalesce(c.n, 0) AS BIGINT) AS n_films,
         CAST(d.total AS BIGINT) AS decade_total,
         CASE WHEN d.total > 0 THEN coalesce(c.n, 0) / d.total ELSE 0 END AS share
  FROM dec d CROSS JOIN top t LEFT JOIN cnt c ON c.decade = d.decade AND c.genre = t.genre"""),
    ]


# ------------------------------------------------------------------ trends
@register("production_trend", with_views(["film"], final=f"""
SELECT {_dec(10)} AS decade, count(*) AS n_films FROM film
WHERE release_year IS NOT NULL GROUP BY 1"""))
def q_production_trend(spark, d):
    return rounded(A.production_trend(_film(spark, d), 10))


@register("production_trend_yearly", with_views(["film"], final=f"""
SELECT {_dec()} AS decade, count(*) AS n_films FROM film
WHERE release_year IS NOT NULL GROUP BY 1"""))
def q_production_trend_yearly(spark, d):
    return rounded(A.production_trend(_film(spark, d), Y))


@register("top_categories", with_views(["film"], _top_sql(n=4),
                                       final="SELECT genre AS primary_genre, n AS n_films, genre_rank AS rank FROM top"))
def q_top_categories(spark, d):
    return rounded(A.top_categories(_film(spark, d), "primary_genre", 4))


@register("genre_counts", with_views(["film"], *_matrix_ctes(0),
                                     final="SELECT decade, genre, genre_rank, n_films, decade_total FROM matrix"))
def q_genre_counts(spark, d):
    return rounded(A.genre_counts(_film(spark, d), TOP, Y))


@register("genre_evolution", with_views(["film"], *_matrix_ctes(MIN_FILMS), final="SELECT * REPLACE (round(share, 6) AS share) FROM matrix"))
def q_genre_evolution(spark, d):
    return rounded(A.genre_evolution(_film(spark, d), TOP, MIN_FILMS, Y))


@register("genre_evolution_decade", with_views(["film"], *_matrix_ctes(50, y=10, n=8),
                                               final="SELECT * REPLACE (round(share, 6) AS share) FROM matrix"))
def q_genre_evolution_decade(spark, d):
    return rounded(A.genre_evolution(_film(spark, d), 8, 50, 10))


@register("genre_heatmap", with_views(["film"], *_matrix_ctes(MIN_FILMS), final="""
SELECT decade, genre, genre_rank, round(share, 6) AS share, decade_total AS sample_size,
       decade_total < 1300 AS small_sample FROM matrix"""))
def q_genre_heatmap(spark, d):
    return rounded(A.genre_heatmap(_film(spark, d), TOP, Y, MIN_FILMS, small_sample=1300))


_fixed_values = ", ".join(f"('{g}')" for g in FIXED_GENRES)
_fixed_in = ", ".join(f"'{g}'" for g in FIXED_GENRES)


@register("crosstab_fixed", with_views(["film"], ("cnt", f"""
  SELECT {_dec()} AS decade, primary_genre AS genre, count(*) AS n FROM film
  WHERE release_year IS NOT NULL AND primary_genre IN ({_fixed_in}) GROUP BY 1, 2"""),
    ("dec", "SELECT decade, sum(n) AS total FROM cnt GROUP BY decade"),
    ("g", f"SELECT * FROM (VALUES {_fixed_values}) t(genre)"),
    final="""
SELECT CAST(d.decade AS VARCHAR) || 's' AS decade_label, d.decade, g.genre,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_films, round(coalesce(c.n, 0) / d.total, 6) AS share
FROM dec d CROSS JOIN g LEFT JOIN cnt c ON c.decade = d.decade AND c.genre = g.genre"""))
def q_crosstab_fixed(spark, d):
    return rounded(A.crosstab_fixed(_film(spark, d), FIXED_GENRES, Y))


# -------------------------------------------------------------- financials
_FIN = ("fin", f"SELECT * FROM film WHERE budget >= {MIN_BUDGET} AND revenue > 0")


@register("budget_revenue_fit", with_views(["film"], _FIN, ("f", """
  SELECT count(*) AS n_movies,
         regr_slope(log10(revenue), log10(budget)) AS slope,
         regr_intercept(log10(revenue), log10(budget)) AS intercept,
         min(log10(budget)) AS x_min, max(log10(budget)) AS x_max,
         median(revenue / budget) AS median_ratio
  FROM fin"""), final="""
SELECT n_movies, least(n_movies, 4000) AS n_plotted, round(median_ratio, 6) AS median_ratio,
       round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(pow(10, x_min), 6) AS line_x0, round(pow(10, x_max), 6) AS line_x1,
       round(pow(10, slope * x_min + intercept), 6) AS line_y0,
       round(pow(10, slope * x_max + intercept), 6) AS line_y1
FROM f"""))
def q_budget_revenue_fit(spark, d):
    return rounded(A.budget_revenue_fit(_film(spark, d), MIN_BUDGET, 4000))


@register("scatter_sample", with_views(["film"], _FIN, final="""
SELECT id, round(budget, 6) AS budget, round(revenue, 6) AS revenue FROM fin
ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 4000"""))
def q_scatter_sample(spark, d):
    s = A.scatter_sample(_film(spark, d), MIN_BUDGET, 4000, 42)
    return s.select("id", r6("budget").alias("budget"), r6("revenue").alias("revenue"))


@register("budget_revenue_linear", with_views(["film"], final="""
SELECT count(*) AS n_movies, round(regr_slope(revenue, budget), 6) AS slope,
       round(regr_intercept(revenue, budget), 6) AS intercept
FROM film WHERE budget IS NOT NULL AND revenue IS NOT NULL AND budget <> 0 AND revenue <> 0"""))
def q_budget_revenue_linear(spark, d):
    return rounded(A.budget_revenue_linear(_film(spark, d)))


def _box_sql(src_cte, value):
    return [
        _top_sql(src="sub", n=TOP),
        ("box", f"""
  SELECT primary_genre AS genre, count({value}) AS n,
         quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS med,
         quantile_cont({value}, 0.75) AS q3
  FROM sub WHERE primary_genre IN (SELECT genre FROM top) GROUP BY 1"""),
    ], """
SELECT genre, CAST(row_number() OVER (ORDER BY med DESC, genre) AS INTEGER) AS genre_order, n,
       round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       CAST(sum(n) OVER () AS BIGINT) AS n_movies
FROM box"""


_ROI_SUB = ("sub", f"""
  SELECT * FROM film WHERE budget >= {MIN_BUDGET} AND revenue > 0
    AND roi IS NOT NULL AND roi >= 1.0 AND roi < 50.0""")
_roi_ctes, _box_final = _box_sql("sub", "roi")


@register("roi_by_genre", with_views(["film"], _ROI_SUB, *_roi_ctes, final=_box_final))
def q_roi_by_genre(spark, d):
    return rounded(A.roi_by_genre(_film(spark, d), TOP, 50.0, 1.0, MIN_BUDGET))


@register("roi_points", with_views(["film"], _ROI_SUB, _top_sql(src="sub", n=TOP), final="""
SELECT primary_genre AS genre, id, round(roi, 6) AS roi FROM sub
WHERE primary_genre IN (SELECT genre FROM top)"""))
def q_roi_points(spark, d):
    return rounded(A.roi_points(_film(spark, d), TOP, 50.0, 1.0, MIN_BUDGET))


@register("roi_by_genre_fixed", with_views(["film"], ("sub", f"""
  SELECT * FROM film WHERE budget IS NOT NULL AND revenue IS NOT NULL AND budget <> 0
    AND revenue <> 0 AND roi < 50.0 AND primary_genre IN ({_fixed_in})"""), ("box", """
  SELECT primary_genre AS genre, count(roi) AS n, quantile_cont(roi, 0.25) AS q1,
         quantile_cont(roi, 0.5) AS med, quantile_cont(roi, 0.75) AS q3
  FROM sub GROUP BY 1"""), final=_box_final))
def q_roi_by_genre_fixed(spark, d):
    return rounded(A.roi_by_genre_fixed(_film(spark, d), FIXED_GENRES, 50.0))


# ---------------------------------------------------------------- audience
@register("rating_histogram", with_views(["film"], ("bins", "SELECT CAST(range AS INTEGER) AS bin FROM range(20)"), ("cnt", """
  SELECT CAST(least(floor((vote_average - 0.0) / 0.5), 19) AS INTEGER) AS bin, count(*) AS n
  FROM film WHERE vote_average IS NOT NULL AND vote_average >= 0.0 AND vote_average <= 10.0
  GROUP BY 1"""), final="""
SELECT b.bin, round(0.0 + b.bin * 0.5, 6) AS bin_lo, round(0.0 + (b.bin + 1) * 0.5, 6) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_films,
       (SELECT count(*) FROM film WHERE vote_average IS NOT NULL) AS n_rated
FROM bins b LEFT JOIN cnt c ON b.bin = c.bin"""))
def q_rating_histogram(spark, d):
    return rounded(A.rating_histogram(_film(spark, d), 0.5))


@register("rating_summary", with_views(["film"], final="""
SELECT count(vote_average) AS n_rated, round(median(vote_average), 6) AS median,
       round(avg(vote_average), 6) AS mean FROM film"""))
def q_rating_summary(spark, d):
    return rounded(A.rating_summary(_film(spark, d)))


@register("rating_trend", with_views(["film"], final=f"""
SELECT {_dec()} AS decade, round(avg(vote_average), 6) AS avg_rating, count(*) AS n_films
FROM film WHERE vote_count >= {MIN_VOTES} AND release_year IS NOT NULL
GROUP BY 1 HAVING count(*) >= 20"""))
def q_rating_trend(spark, d):
    return rounded(A.rating_trend(_film(spark, d), MIN_VOTES, 20, Y))


_RATE_SUB = ("sub", f"SELECT * FROM film WHERE vote_count >= {MIN_VOTES} AND primary_genre IS NOT NULL")
_rate_ctes, _ = _box_sql("sub", "vote_average")


@register("rating_by_genre", with_views(["film"], _RATE_SUB, *_rate_ctes, final=_box_final))
def q_rating_by_genre(spark, d):
    return rounded(A.rating_by_genre(_film(spark, d), TOP, MIN_VOTES))


def _corr_sql(src, pairwise):
    parts = []
    for a in A.FIN_VARS:
        for b in A.FIN_VARS:
            if pairwise:
                xa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
                xb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
            else:
                xa, xb = a, b
            parts.append(
                f"SELECT '{a}' AS var_a, '{b}' AS var_b, "
                f"round(covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0), 6) AS r, "
                f"count({xa}) AS n_pair FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("financial_correlation", with_views(["film"], _FIN, final=_corr_sql("fin", True)))
def q_financial_correlation(spark, d):
    return rounded(A.financial_correlation(_film(spark, d), MIN_BUDGET))


_nn = " AND ".join(f"{c} IS NOT NULL" for c in A.FIN_VARS)


@register("financial_correlation_listwise", with_views(
    ["film"], ("lw", f"SELECT * FROM film WHERE budget <> 0 AND revenue <> 0 AND {_nn}"),
    final=_corr_sql("lw", False)))
def q_financial_correlation_listwise(spark, d):
    return rounded(A.financial_correlation_listwise(_film(spark, d)))


@register("kpi_summary", with_views(["film"], _FIN, ("g", """
  SELECT primary_genre, count(*) AS n FROM film WHERE primary_genre IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, primary_genre LIMIT 1"""), final="""
SELECT (SELECT count(*) FROM film) AS total_movies,
       round(coalesce((SELECT avg(vote_average) FROM film), 0), 6) AS avg_rating,
       coalesce((SELECT primary_genre FROM g), '—') AS top_genre,
       CAST(coalesce((SELECT n FROM g), 0) AS BIGINT) AS top_count,
       round(coalesce((SELECT median(roi) FROM fin), 0), 6) AS median_roi,
       (SELECT count(*) FROM fin) AS disclosed_count"""))
def q_kpi_summary(spark, d):
    return rounded(A.kpi_summary(_film(spark, d), MIN_BUDGET))


@register("language_counts", """
SELECT lang, count(*) AS n_docs,
       CAST(row_number() OVER (ORDER BY count(*) DESC, lang) AS INTEGER) AS rank
FROM documents GROUP BY lang ORDER BY n_docs DESC, lang LIMIT 10""")
def q_language_counts(spark, d):
    return rounded(A.language_counts(read_table(spark, d, "documents", "lang"), "lang", 10))


# ---------------------------------------------------------------- insights
@register("insight_share_growth", with_views(["film"], *_matrix_ctes(MIN_FILMS), final="""
SELECT * FROM (
  SELECT genre, decade, lag(decade) OVER w AS prev_decade, round(lag(share) OVER w, 6) AS prev_share, round(share, 6) AS share,
         round(share - lag(share) OVER w, 6) AS delta,
         round((share - lag(share) OVER w) / nullif(lag(share) OVER w, 0), 6) AS growth
  FROM matrix WINDOW w AS (PARTITION BY genre ORDER BY decade))
WHERE prev_decade IS NOT NULL"""))
def q_insight_share_growth(spark, d):
    return rounded(A.insight_share_growth(_film(spark, d), TOP, MIN_FILMS, Y))


@register("insight_leaders", with_views(["film"], *_matrix_ctes(MIN_FILMS), final="""
SELECT 'decade_leader' AS kind, CAST(decade AS VARCHAR) AS key, genre AS value, round(max_share, 6) AS share
FROM (SELECT decade, genre, max(share) OVER (PARTITION BY decade) AS max_share,
             row_number() OVER (PARTITION BY decade ORDER BY n_films DESC, genre_rank) AS rn
      FROM matrix) WHERE rn = 1
UNION ALL
SELECT 'genre_peak', genre, CAST(decade AS VARCHAR), round(max_share, 6)
FROM (SELECT genre, decade, max(share) OVER (PARTITION BY genre) AS max_share,
             row_number() OVER (PARTITION BY genre ORDER BY share DESC, decade) AS rn
      FROM matrix) WHERE rn = 1"""))
def q_insight_leaders(spark, d):
    return rounded(A.insight_leaders(_film(spark, d), TOP, MIN_FILMS, Y))



@register("insight_peak_bin", with_views(["film"], ("h", """
  SELECT least(CAST(floor(vote_average / 0.5) AS INTEGER), 19) AS bin, count(*) AS n
  FROM film WHERE vote_average BETWEEN 0 AND 10 GROUP BY 1"""), final="""
SELECT bin, bin * 0.5::DOUBLE AS bin_lo, (bin + 1) * 0.5::DOUBLE AS bin_hi, CAST(n AS BIGINT) AS n_films,
       round(n / (SELECT sum(n) FROM h), 6) AS share
FROM h ORDER BY n DESC, bin LIMIT 1"""))
def q_insight_peak_bin(spark, d):
    return rounded(A.insight_peak_bin(_film(spark, d), 0.5))
