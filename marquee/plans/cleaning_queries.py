"""Registered cleaning queries (P1-P15, P20-P22, W3, A21-A25) over
``dirty_film`` (string-typed, deliberately damaged films) and ``rating``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.common import r6, rounded
from marquee.functions.text import split_list, title_link_norm, title_norm, vocab_filter
from marquee.operators import clean as C
from marquee.plans.fixtures import view, with_views
from marquee.plans.registry import register

VOCAB = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW",
         "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
ETL = dict(released="F", cutoff="2001-08-01", min_votes=4)
_vocab_sql = ", ".join(f"'{v}'" for v in VOCAB)


def _dirty(spark, d):
    return view(spark, d, "dirty_film")


def _sane(spark, d):
    df = C.clean_coerce(C.clean_required(_dirty(spark, d)))
    return C.sanity_filter(df)


def _dbl(c):
    x = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


_REQ = ("req", "SELECT * FROM dirty_film WHERE id IS NOT NULL AND title IS NOT NULL")
_COERCED = ("coerced", f"""
  SELECT CAST(trunc({_dbl('id')}) AS BIGINT) AS id, title, release_date,
         {_dbl('release_year')} AS release_year, {_dbl('vote_count')} AS vote_count,
         {_dbl('vote_average')} AS vote_average, {_dbl('runtime')} AS runtime,
         {_dbl('budget')} AS budget, {_dbl('revenue')} AS revenue,
         primary_genre, genres_parsed, status, load_seq
  FROM req WHERE {_dbl('id')} IS NOT NULL""")
_SANE = ("sane", r"""
  SELECT * FROM coerced
  WHERE (vote_average IS NULL OR vote_average BETWEEN 0 AND 10)
    AND (release_year IS NULL OR release_year BETWEEN 1874 AND 2017)
    AND NOT contains(coalesce(title, ''), '�')
    AND NOT regexp_matches(coalesce(title, ''), '^[\d./\s]+$')""")
_CLEAN = [_REQ, _COERCED, _SANE]
_SPLIT = "list_filter(string_split(coalesce(genres_parsed, ''), '|'), lambda x: x <> '')"


_WS = """round(coalesce(vote_count, 0) / (coalesce(vote_count, 0) + m) * coalesce(vote_average, c)
             + m / (coalesce(vote_count, 0) + m) * c, 9)"""
# the cleaned catalog as one CTE chain (weighted score rounded to 9 places for ordering)
CATALOG_CTES = [*_CLEAN, ("sc", """
  SELECT avg(vote_average) AS c, quantile_cont(vote_count, 0.9) AS m FROM sane WHERE vote_count > 0"""),
    ("cat", f"""
  SELECT id, load_seq, title, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_norm,
         CAST(release_year AS INTEGER) AS release_year,
         CAST(floor(release_year / 1) * 1 AS INTEGER) AS release_decade,
         vote_average, vote_count, runtime, budget, revenue,
         CASE WHEN primary_genre IN ({_vocab_sql}) THEN primary_genre END AS primary_genre,
         list_filter({_SPLIT}, lambda g: g IN ({_vocab_sql})) AS genres_list,
         {_WS} AS weighted_score
  FROM sane, sc""")]


def clean_film_catalog(spark, d, scored=True):
    """The cleaned film catalog used by the browse queries."""
    df = C.clean_catalog(_dirty(spark, d), VOCAB, bucket_years=1, scored=scored)
    if scored:
        df = df.withColumn("weighted_score", F.round("weighted_score", 9))
    return df.withColumn("release_year", F.col("release_year").cast("int"))


@register("drop_empty_columns", with_views(["dirty_film"], final="SELECT * FROM dirty_film"))
def q_drop_empty_columns(spark, d):
    df = _dirty(spark, d).withColumn("countries", F.lit(None).cast("string"))
    return C.drop_empty_columns(df)


@register("clean_required", with_views(["dirty_film"], _REQ,
                                       final="SELECT id, load_seq, title FROM req"))
def q_clean_required(spark, d):
    return C.clean_required(_dirty(spark, d)).select("id", "load_seq", "title")


@register("clean_coerce", with_views(["dirty_film"], _REQ, _COERCED, final="""
SELECT id, load_seq, release_year, vote_count, round(vote_average, 6) AS vote_average,
       round(runtime, 6) AS runtime, round(budget, 6) AS budget, round(revenue, 6) AS revenue
FROM coerced"""))
def q_clean_coerce(spark, d):
    df = C.clean_coerce(C.clean_required(_dirty(spark, d)))
    return df.select("id", "load_seq", "release_year", "vote_count",
                     *[r6(c).alias(c) for c in ("vote_average", "runtime", "budget", "revenue")])


@register("decade_bucket", with_views(["dirty_film"], _REQ, _COERCED, final="""
SELECT id, load_seq, CAST(floor(release_year / 10) * 10 AS INTEGER) AS release_decade,
       CAST(floor(release_year / 1) * 1 AS INTEGER) AS release_bucket1
FROM coerced"""))
def q_decade_bucket(spark, d):
    df = C.clean_coerce(C.clean_required(_dirty(spark, d)))
    df = C.decade_bucket(df, 10)
    df = C.decade_bucket(df, 1, out="release_bucket1")
    return df.select("id", "load_seq", "release_decade", "release_bucket1")


@register("sanity_filter", with_views(["dirty_film"], *_CLEAN,
                                      final="SELECT id, load_seq, title FROM sane"))
def q_sanity_filter(spark, d):
    return _sane(spark, d).select("id", "load_seq", "title")


@register("sanity_drop_count", with_views(["dirty_film"], _REQ, _COERCED, ("f", r"""
  SELECT (vote_average IS NULL OR vote_average BETWEEN 0 AND 10) AS r_ok,
         (release_year IS NULL OR release_year BETWEEN 1874 AND 2017) AS y_ok,
         NOT contains(coalesce(title, ''), '�')
           AND NOT regexp_matches(coalesce(title, ''), '^[\d./\s]+$') AS t_ok
  FROM coerced"""), final="""
SELECT count(*) AS rows_before, count_if(NOT r_ok) AS bad_rating,
       count_if(r_ok AND NOT y_ok) AS bad_year, count_if(r_ok AND y_ok AND NOT t_ok) AS bad_title,
       count_if(r_ok AND y_ok AND t_ok) AS rows_after
FROM f"""))
def q_sanity_drop_count(spark, d):
    return C.sanity_drop_count(C.clean_coerce(C.clean_required(_dirty(spark, d))))


@register("title_norm", with_views(["dirty_film"], *_CLEAN, final="""
SELECT id, load_seq, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_norm FROM sane"""))
def q_title_norm(spark, d):
    return _sane(spark, d).select("id", "load_seq", title_norm("title").alias("title_norm"))


@register("title_link_norm", with_views(["film"], final=r"""
SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\pL\pN_\s]', '', 'g'), '\s+', ' ', 'g'))
       AS title_link_norm
FROM film"""))
def q_title_link_norm(spark, d):
    return view(spark, d, "film").select("id", title_link_norm("title").alias("title_link_norm"))




@register("split_list", with_views(["dirty_film"], final=f"""
SELECT id, load_seq, array_to_string({_SPLIT}, ',') AS genres, CAST(len({_SPLIT}) AS INTEGER) AS n_genres
FROM dirty_film"""))
def q_split_list(spark, d):
    arr = split_list("genres_parsed")
    return _dirty(spark, d).select("id", "load_seq", F.array_join(arr, ",").alias("genres"),
                                   F.size(arr).alias("n_genres"))


@register("vocab_filter", with_views(["dirty_film"], final=f"""
SELECT id, load_seq,
       array_to_string(list_filter({_SPLIT}, lambda g: g IN ({_vocab_sql})), ',') AS genres,
       CASE WHEN primary_genre IN ({_vocab_sql}) THEN primary_genre END AS primary_genre
FROM dirty_film"""))
def q_vocab_filter(spark, d):
    df = C.with_lists(_dirty(spark, d), VOCAB)
    return df.select("id", "load_seq", F.array_join("genres_list", ",").alias("genres"),
                     "primary_genre")


@register("zero_to_null", with_views(["dirty_film"], _REQ, _COERCED, final="""
SELECT id, load_seq, round(nullif(budget, 0), 6) AS budget, round(nullif(revenue, 0), 6) AS revenue,
       round(nullif(runtime, 0), 6) AS runtime
FROM coerced"""))
def q_zero_to_null(spark, d):
    df = C.zero_to_null(C.clean_coerce(C.clean_required(_dirty(spark, d))))
    return df.select("id", "load_seq", *[r6(c).alias(c) for c in ("budget", "revenue", "runtime")])


@register("derive_financials", with_views(["dirty_film"], _REQ, _COERCED, final=f"""
SELECT id, load_seq, round(nullif(revenue, 0) / nullif(budget, 0), 6) AS roi,
       round(nullif(revenue, 0) - nullif(budget, 0), 6) AS profit,
       list_filter({_SPLIT}, lambda g: g IN ({_vocab_sql}))[1] AS primary_genre
FROM coerced"""))
def q_derive_financials(spark, d):
    df = C.with_lists(C.zero_to_null(C.clean_coerce(C.clean_required(_dirty(spark, d)))), VOCAB)
    df = C.derive_financials(df)
    return df.select("id", "load_seq", r6("roi_derived").alias("roi"),
                     r6("profit_derived").alias("profit"),
                     F.col("primary_genre_derived").alias("primary_genre"))


_ETL_CTES = [
    ("firsts", "SELECT id, min(load_seq) AS load_seq FROM dirty_film GROUP BY id"),
    ("flags", f"""
  SELECT d.*, CAST(try_strptime(d.release_date, '%Y-%m-%d') AS DATE) AS dp,
         f.load_seq IS NOT NULL AS is_first, {_dbl('d.vote_count')} AS vc
  FROM dirty_film d LEFT JOIN firsts f ON d.id = f.id AND d.load_seq = f.load_seq"""),
    ("steps", """
  SELECT *, CASE WHEN NOT is_first THEN 1 WHEN coalesce(status, '') <> 'F' THEN 2
                 WHEN dp IS NULL THEN 3 WHEN dp >= DATE '2001-08-01' THEN 4
                 WHEN coalesce(vc, 0) < 4 THEN 5 END AS step
  FROM flags"""),
]


@register("etl_catalog", with_views(["dirty_film"], *_ETL_CTES, ("kept", f"""
  SELECT CAST(trunc({_dbl('id')}) AS BIGINT) AS id, title, dp AS release_date,
         CAST(year(dp) AS INTEGER) AS release_year,
         CAST(floor(year(dp) / 10) * 10 AS INTEGER) AS release_decade,
         {_SPLIT}[1] AS primary_genre,
         nullif({_dbl('budget')}, 0) AS budget, nullif({_dbl('revenue')}, 0) AS revenue,
         nullif({_dbl('runtime')}, 0) AS runtime, {_dbl('vote_average')} AS vote_average,
         CAST(trunc({_dbl('vote_count')}) AS BIGINT) AS vote_count
  FROM steps WHERE step IS NULL"""), final="""
SELECT id, title, release_date, release_year, release_decade, primary_genre,
       round(budget, 6) AS budget, round(revenue, 6) AS revenue, round(runtime, 6) AS runtime,
       round(revenue / budget, 6) AS roi, round(revenue - budget, 6) AS profit,
       round(vote_average, 6) AS vote_average, vote_count
FROM kept"""))
def q_etl_catalog(spark, d):
    df = C.etl_catalog(_dirty(spark, d), **ETL)
    return df.select(*[r6(c).alias(c) if c in ("budget", "revenue", "runtime", "roi", "profit",
                                              "vote_average") else F.col(c) for c in df.columns])


@register("etl_funnel", with_views(["dirty_film"], *_ETL_CTES, final="""
SELECT s.step_no, s.step,
       (SELECT count(*) FROM steps) - (SELECT count(*) FROM steps WHERE step < s.step_no) AS rows_before,
       (SELECT count(*) FROM steps WHERE step = s.step_no) AS dropped,
       (SELECT count(*) FROM steps) - (SELECT count(*) FROM steps WHERE step <= s.step_no) AS rows_after
FROM (VALUES (1, 'duplicate_id'), (2, 'not_released'), (3, 'invalid_date'), (4, 'after_cutoff'),
             (5, 'few_votes')) s(step_no, step)"""))
def q_etl_funnel(spark, d):
    return C.etl_funnel(_dirty(spark, d), **ETL)


@register("clean_ratings", with_views(["rating"], final="""
SELECT DISTINCT user_id, item_id, rating, ts, CAST(year(ts) AS INTEGER) AS rating_year
FROM rating WHERE rating BETWEEN 0.5 AND 5.0"""))
def q_clean_ratings(spark, d):
    r = view(spark, d, "rating").select("user_id", "item_id", "rating", "ts")
    return C.clean_ratings(r)


@register("weighted_score", with_views(["dirty_film"], *_CLEAN, ("sc", """
  SELECT avg(vote_average) AS c, quantile_cont(vote_count, 0.9) AS m FROM sane WHERE vote_count > 0"""),
    final="""
SELECT id, load_seq,
       round(coalesce(vote_count, 0) / (coalesce(vote_count, 0) + m) * coalesce(vote_average, c)
             + m / (coalesce(vote_count, 0) + m) * c, 6) AS weighted_score
FROM sane, sc"""))
def q_weighted_score(spark, d):
    return C.weighted_score(_sane(spark, d)).select("id", "load_seq",
                                                    r6("weighted_score").alias("weighted_score"))


@register("clean_catalog", with_views(["dirty_film"], *_CLEAN, ("sc", """
  SELECT avg(vote_average) AS c, quantile_cont(vote_count, 0.9) AS m FROM sane WHERE vote_count > 0"""),
    final=f"""
SELECT id, load_seq, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_norm,
       CAST(floor(release_year / 1) * 1 AS INTEGER) AS release_decade,
       CASE WHEN primary_genre IN ({_vocab_sql}) THEN primary_genre END AS primary_genre,
       array_to_string(list_filter({_SPLIT}, lambda g: g IN ({_vocab_sql})), ',') AS genres,
       round(coalesce(vote_count, 0) / (coalesce(vote_count, 0) + m) * coalesce(vote_average, c)
             + m / (coalesce(vote_count, 0) + m) * c, 6) AS weighted_score
FROM sane, sc"""))
def q_clean_catalog(spark, d):
    df = C.clean_catalog(_dirty(spark, d), VOCAB, bucket_years=1)
    return df.select("id", "load_seq", "title_norm", "release_decade", "primary_genre",
                     F.array_join("genres_list", ",").alias("genres"),
                     r6("weighted_score").alias("weighted_score"))


@register("dedupe_keep_first", with_views(["dirty_film"], final="""
SELECT id, load_seq, title FROM (
  SELECT id, load_seq, title, row_number() OVER (PARTITION BY id ORDER BY load_seq) AS rn
  FROM dirty_film) WHERE rn = 1"""))
def q_dedupe_keep_first(spark, d):
    return C.dedupe_keep_first(_dirty(spark, d), "id", "load_seq").select("id", "load_seq", "title")


_DIRTY_COLS = ("id", "title", "release_date", "release_year", "primary_genre", "genres_parsed",
               "status", "budget", "revenue", "vote_average", "vote_count", "runtime", "load_seq")


@register("missing_profile", with_views(["dirty_film"], final="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count_if({c} IS NULL) AS n_missing, "
    f"round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS pct FROM dirty_film"
    for c in _DIRTY_COLS)))
def q_missing_profile(spark, d):
    return rounded(C.missing_profile(_dirty(spark, d), _DIRTY_COLS))


@register("zero_profile", with_views(["dirty_film"], final="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count_if({_dbl(c)} = 0) AS n_zero, "
    f"round(count_if({_dbl(c)} = 0) * 100.0 / count(*), 6) AS pct FROM dirty_film"
    for c in ("budget", "revenue", "runtime"))))
def q_zero_profile(spark, d):
    return rounded(C.zero_profile(_dirty(spark, d), ("budget", "revenue", "runtime")))


_DESC = ("budget", "revenue", "runtime", "vote_average", "vote_count")


@register("numeric_describe", with_views(["film"], final="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM film"
    for c in _DESC)))
def q_numeric_describe(spark, d):
    return rounded(C.numeric_describe(view(spark, d, "film"), _DESC))


_AUDIT_COLS = [c for c in _DIRTY_COLS if c != "load_seq"]


@register("duplicate_audit", with_views(["dirty_film"], final=f"""
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_keys, count(*) - count(DISTINCT id) AS repeated_keys,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_AUDIT_COLS)} FROM dirty_film))
         AS repeated_rows
FROM dirty_film"""))
def q_duplicate_audit(spark, d):
    return C.duplicate_audit(_dirty(spark, d).select(*_AUDIT_COLS), "id")


@register("overview_stats", with_views(["rating"], ("r", """
  SELECT DISTINCT user_id, item_id, rating, ts FROM rating WHERE rating BETWEEN 0.5 AND 5.0"""),
    final="""
SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts,
       CAST(min(year(ts)) AS INTEGER) AS first_year, CAST(max(year(ts)) AS INTEGER) AS last_year,
       count(DISTINCT CAST(floor(year(ts) / 10) * 10 AS INTEGER)) AS n_decades
FROM r"""))
def q_overview_stats(spark, d):
    r = C.clean_ratings(view(spark, d, "rating").select("user_id", "item_id", "rating", "ts"))
    return C.overview_stats(r)

