"""Trend, financial and audience analytics over a film catalog.

Input: a catalog frame with ``id, release_year, primary_genre, budget,
revenue, roi, profit, runtime, vote_average, vote_count``. Every operator
returns a long-form DataFrame (one row per chart cell) instead of a dict.

Quantiles are exact (linear interpolation) and computed with the distributed
range-sort in ``marquee.functions.positions``, so a genre holding most of the
rows never lands in one task. Top-N category lists are the only values pulled
to the driver (at most ``top_n`` strings).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import bucket, col, pearson
from marquee.functions.positions import grouped_quantiles

FIN_VARS = ("budget", "revenue", "profit", "roi", "runtime")


# ------------------------------------------------------------------ helpers
def top_categories(df: DataFrame, col: str = "primary_genre", n: int = 8) -> DataFrame:
    """The ``n`` most frequent non-null values of ``col``: (value, n_films, rank).

    Ties: count desc, then value asc. ``orderBy().limit()`` plans as a
    distributed top-k (TakeOrderedAndProject), never a full sort.
    """
    counts = (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("n_films")))
    top = counts.orderBy(F.desc("n_films"), F.asc(col)).limit(n)
    # the rank window runs over at most n rows
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("n_films"), F.asc(col))))


def top_list(df: DataFrame, col: str, n: int) -> list:
    return [r[0] for r in top_categories(df, col, n).orderBy("rank").select(col).collect()]


def financial_subset(df: DataFrame, min_budget: float = 1000) -> DataFrame:
    """Budget >= min_budget and revenue > 0 (null fails both)."""
    return df.where((F.col("budget") >= min_budget) & (F.col("revenue") > 0))


def _explode_cells(wide: DataFrame, keep: Sequence[str], genres: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(g).alias("genre"), F.lit(i + 1).alias("genre_rank"),
                 F.col(f"_g{i}").alias("n_films"))
        for i, g in enumerate(genres)
    ])
    return wide.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


# ------------------------------------------------------------------- trends
def production_trend(df: DataFrame, bucket_years: int = 10) -> DataFrame:
    """A1: films per decade, null decade dropped."""
    return (df.where(F.col("release_year").isNotNull())
            .groupBy(bucket("release_year", bucket_years).alias("decade"))
            .agg(F.count(F.lit(1)).alias("n_films"))
            .orderBy("decade"))


def genre_matrix(df: DataFrame, top_n: int = 8, bucket_years: int = 10,
                 min_films: int = 0, genre_col: str = "primary_genre") -> DataFrame:
    """A3/A4: decade x top-N genre counts (zero-filled) and shares.

    Top-N is chosen on all rows, before null decades are dropped. Shares are
    within the top-N only; decades whose top-N total is below ``min_films``
    are dropped. One aggregation pass counts every genre with conditional
    counts, so zero cells need no grid join.
    """
    genres = top_list(df, genre_col, top_n)
    if not genres:
        return df.sparkSession.createDataFrame(
            [], "decade int, genre string, genre_rank int, n_films bigint, "
                "decade_total bigint, share double")
    g = F.col(genre_col)
    wide = (df.where(F.col("release_year").isNotNull() & g.isin(genres))
            .groupBy(bucket("release_year", bucket_years).alias("decade"))
            .agg(*[F.count_if(g == v).alias(f"_g{i}") for i, v in enumerate(genres)]))
    total = sum((F.col(f"_g{i}") for i in range(len(genres))), F.lit(0))
    wide = wide.withColumn("decade_total", total.cast("bigint")).where(
        F.col("decade_total") >= min_films)
    long = _explode_cells(wide, ["decade", "decade_total"], genres)
    share = F.when(F.col("decade_total") > 0, F.col("n_films") / F.col("decade_total")) \
        .otherwise(F.lit(0.0))
    return long.select("decade", "genre", "genre_rank", "n_films", "decade_total",
                       col(share).alias("share"))


def genre_counts(df, top_n=8, bucket_years=10):
    return genre_matrix(df, top_n, bucket_years, 0).drop("share")


def genre_evolution(df, top_n=8, min_films=50, bucket_years=10):
    return genre_matrix(df, top_n, bucket_years, min_films)


def genre_heatmap(df, top_n=8, bucket_years=10, min_films=50, small_sample=10):
    """A5: shares plus per-decade sample size and a small-sample flag."""
    m = genre_matrix(df, top_n, bucket_years, min_films)
    return m.select("decade", "genre", "genre_rank", "share",
                    F.col("decade_total").alias("sample_size"),
                    (F.col("decade_total") < small_sample).alias("small_sample"))


def crosstab_fixed(df: DataFrame, genres: Sequence[str], bucket_years: int = 10) -> DataFrame:
    """Fixed genre list, every decade that has one of them; counts and
    row shares, decade labelled like ``1990s``."""
    g = F.col("primary_genre")
    wide = (df.where(F.col("release_year").isNotNull() & g.isin(list(genres)))
            .groupBy(bucket("release_year", bucket_years).alias("decade"))
            .agg(*[F.count_if(g == v).alias(f"_g{i}") for i, v in enumerate(genres)]))
    total = sum((F.col(f"_g{i}") for i in range(len(genres))), F.lit(0))
    wide = wide.withColumn("decade_total", total.cast("bigint"))
    long = _explode_cells(wide, ["decade", "decade_total"], genres)
    return long.select(
        F.concat(F.col("decade").cast("string"), F.lit("s")).alias("decade_label"),
        "decade", "genre", "n_films",
        col(F.col("n_films") / F.col("decade_total")).alias("share"))


# --------------------------------------------------------------- financials
def budget_revenue_fit(df: DataFrame, min_budget: float = 1000, max_points: int = 4000) -> DataFrame:
    """Median revenue per budget dollar and the log10-log10 OLS line
    on the full financial subset (end points at the min and max budget)."""
    fin = financial_subset(df, min_budget)
    lb, lr = F.log10("budget"), F.log10("revenue")
    fit = fin.agg(
        F.count(F.lit(1)).alias("n_movies"),
        F.regr_slope(lr, lb).alias("slope"),
        F.regr_intercept(lr, lb).alias("intercept"),
        F.min(lb).alias("x_min"), F.max(lb).alias("x_max"),
    )
    med = grouped_quantiles(fin.select((F.col("revenue") / F.col("budget")).alias("ratio")),
                            [], "ratio", [0.5], ["median_ratio"])
    # both sides are single-row aggregates: zip them with an equi-join on a constant
    out = fit.withColumn("_k", F.lit(1)).join(
        med.select("median_ratio").withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    line = lambda x: F.pow(F.lit(10.0), F.col("slope") * x + F.col("intercept"))
    return out.select(
        "n_movies",
        F.least(F.col("n_movies"), F.lit(max_points)).alias("n_plotted"),
        col("median_ratio").alias("median_ratio"),
        col("slope").alias("slope"), col("intercept").alias("intercept"),
        col(F.pow(F.lit(10.0), F.col("x_min"))).alias("line_x0"),
        col(F.pow(F.lit(10.0), F.col("x_max"))).alias("line_x1"),
        col(line(F.col("x_min"))).alias("line_y0"),
        col(line(F.col("x_max"))).alias("line_y1"),
    )


def scatter_sample(df: DataFrame, min_budget: float = 1000, max_points: int = 4000,
                   seed: int = 42) -> DataFrame:
    """A10: at most ``max_points`` rows of the financial subset, chosen by a
    seeded hash of the id (stable under any partitioning; distributed top-k)."""
    fin = financial_subset(df, min_budget)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return (fin.select("id", "budget", "revenue", key.alias("_h"))
            .orderBy("_h", "id").limit(max_points).drop("_h"))


def budget_revenue_linear(df: DataFrame) -> DataFrame:
    """Raw-scale OLS revenue ~ budget over rows with both non-zero."""
    sub = df.where(F.col("budget").isNotNull() & F.col("revenue").isNotNull()
                   & (F.col("budget") != 0) & (F.col("revenue") != 0))
    return sub.agg(F.count(F.lit(1)).alias("n_movies"),
                   col(F.regr_slope("revenue", "budget")).alias("slope"),
                   col(F.regr_intercept("revenue", "budget")).alias("intercept"))


def _box(sub: DataFrame, value: str, genres_df: DataFrame) -> DataFrame:
    q = grouped_quantiles(sub, ["primary_genre"], value, [0.25, 0.5, 0.75],
                          ["q1", "median", "q3"])
    q = q.join(genres_df.select("primary_genre"), "primary_genre", "right")
    w = Window.orderBy(F.desc("median"), F.asc("primary_genre"))  # <= top_n rows
    return q.select(
        F.col("primary_genre").alias("genre"),
        F.row_number().over(w).alias("genre_order"),
        F.col("n").alias("n"),
        col("q1").alias("q1"), col("median").alias("median"), col("q3").alias("q3"),
        F.sum("n").over(Window.partitionBy(F.lit(1))).alias("n_movies"),
    )


def roi_subset(df, top_n=8, roi_cap=50.0, roi_min=1.0, min_budget=1000):
    fin = financial_subset(df, min_budget)
    fin = fin.where(F.col("roi").isNotNull() & (F.col("roi") >= roi_min)
                    & (F.col("roi") < roi_cap))
    top = top_categories(fin, "primary_genre", top_n)
    return fin.join(F.broadcast(top.select("primary_genre")), "primary_genre", "left_semi"), top


def roi_by_genre(df: DataFrame, top_n: int = 8, roi_cap: float = 50.0,
                 roi_min: float = 1.0, min_budget: float = 1000) -> DataFrame:
    """ROI box statistics per top genre (top-N picked after filtering),
    genres ordered by median desc."""
    sub, top = roi_subset(df, top_n, roi_cap, roi_min, min_budget)
    return _box(sub, "roi", top)


def roi_points(df, top_n=8, roi_cap=50.0, roi_min=1.0, min_budget=1000):
    """A12 raw values: (genre, id, roi) for every kept film."""
    sub, _ = roi_subset(df, top_n, roi_cap, roi_min, min_budget)
    return sub.select(F.col("primary_genre").alias("genre"), "id", col("roi").alias("roi"))


def roi_by_genre_fixed(df, genres: Sequence[str], roi_cap=50.0):
    """Financial rows (both non-zero) with roi < cap, fixed genres."""
    sub = df.where(F.col("budget").isNotNull() & F.col("revenue").isNotNull()
                   & (F.col("budget") != 0) & (F.col("revenue") != 0)
                   & (F.col("roi") < roi_cap) & F.col("primary_genre").isin(list(genres)))
    gdf = sub.sparkSession.createDataFrame([(g,) for g in genres], "primary_genre string")
    return _box(sub, "roi", gdf).where(F.col("n").isNotNull())


# ----------------------------------------------------------------- audience
def rating_histogram(df: DataFrame, bin_width: float = 0.5, lo: float = 0.0,
                     hi: float = 10.0) -> DataFrame:
    """Equal-width bins on [lo, hi], left-closed, last bin closed at hi;
    values outside are not counted in bins but are counted in ``n_rated``."""
    nbins = int(round((hi - lo) / bin_width))
    x = F.col("vote_average")
    idx = F.least(F.floor((x - lo) / bin_width), F.lit(nbins - 1)).cast("int")
    rated = df.where(x.isNotNull())
    counts = (rated.where((x >= lo) & (x <= hi)).groupBy(idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n_films")))
    spark = df.sparkSession
    bins = spark.range(nbins).select(F.col("id").cast("int").alias("bin"))
    n_rated = rated.agg(F.count(F.lit(1)).alias("n_rated"))
    out = (bins.join(counts, "bin", "left")
           .join(n_rated.withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k"), "left"))
    return out.select(
        "bin",
        col(F.lit(lo) + F.col("bin") * bin_width).alias("bin_lo"),
        col(F.lit(lo) + (F.col("bin") + 1) * bin_width).alias("bin_hi"),
        F.coalesce("n_films", F.lit(0)).cast("bigint").alias("n_films"),
        "n_rated")


def rating_summary(df: DataFrame) -> DataFrame:
    """Median and mean of the non-null ratings."""
    med = grouped_quantiles(df, [], "vote_average", [0.5], ["median"])
    mean = df.agg(F.avg("vote_average").alias("mean"))
    out = med.withColumn("_k", F.lit(1)).join(mean.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.select(F.col("n").alias("n_rated"), col("median").alias("median"),
                      col("mean").alias("mean"))


def rating_trend(df: DataFrame, min_votes: int = 10, min_films: int = 20,
                 bucket_years: int = 10) -> DataFrame:
    """Mean rating per decade over films with enough votes."""
    sub = df.where((F.col("vote_count") >= min_votes) & F.col("release_year").isNotNull())
    return (sub.groupBy(bucket("release_year", bucket_years).alias("decade"))
            .agg(col(F.avg("vote_average")).alias("avg_rating"),
                 F.count(F.lit(1)).alias("n_films"))
            .where(F.col("n_films") >= min_films))


def rating_by_genre(df: DataFrame, top_n: int = 8, min_votes: int = 10) -> DataFrame:
    """Rating box statistics per top genre (votes >= min_votes)."""
    sub = df.where((F.col("vote_count") >= min_votes) & F.col("primary_genre").isNotNull())
    top = top_categories(sub, "primary_genre", top_n)
    sub = sub.join(F.broadcast(top.select("primary_genre")), "primary_genre", "left_semi")
    return _box(sub, "vote_average", top)


def _corr_long(sub: DataFrame, cols: Sequence[str], pairwise: bool) -> DataFrame:
    aggs = []
    for a in cols:
        for b in cols:
            ca, cb = F.col(a), F.col(b)
            if pairwise:
                both = ca.isNotNull() & cb.isNotNull()
                ca, cb = F.when(both, ca), F.when(both, cb)
            aggs.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                                 col(pearson(ca, cb)).alias("r"),
                                 F.count(ca).alias("n_pair")).alias(f"{a}__{b}"))
    one = sub.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"{a}__{b}") for a in cols for b in cols]))
                      .alias("c")).select("c.*")


def financial_correlation(df: DataFrame, min_budget: float = 1000,
                          cols: Sequence[str] = FIN_VARS) -> DataFrame:
    """Pearson matrix, pairwise-complete rows, on the financial subset."""
    return _corr_long(financial_subset(df, min_budget), cols, pairwise=True)


def financial_correlation_listwise(df: DataFrame, cols: Sequence[str] = FIN_VARS) -> DataFrame:
    """Pearson matrix on rows complete in every column (both non-zero
    financials, as in the older analysis)."""
    sub = df.where((F.col("budget") != 0) & (F.col("revenue") != 0)).dropna(subset=list(cols))
    return _corr_long(sub, cols, pairwise=False)


def kpi_summary(df: DataFrame, min_budget: float = 1000) -> DataFrame:
    """One row of dashboard KPIs."""
    base = df.agg(F.count(F.lit(1)).alias("total_movies"),
                  F.avg("vote_average").alias("avg_rating"))
    counts = (df.where(F.col("primary_genre").isNotNull()).groupBy("primary_genre")
              .agg(F.count(F.lit(1)).alias("n")))
    top = counts.agg(
        F.min_by("primary_genre", F.struct(-F.col("n"), F.col("primary_genre"))).alias("top_genre"),
        F.max("n").alias("top_count"))
    fin = financial_subset(df, min_budget)
    med = grouped_quantiles(fin, [], "roi", [0.5], ["median_roi"])
    disclosed = fin.agg(F.count(F.lit(1)).alias("disclosed_count"))
    k = lambda d: d.withColumn("_k", F.lit(1))  # noqa: E731  one-row frames, zipped
    out = (k(base).join(k(top), "_k", "left").join(k(med.select("median_roi")), "_k", "left")
           .join(k(disclosed), "_k", "left"))
    return out.select(
        "total_movies",
        col(F.coalesce("avg_rating", F.lit(0.0))).alias("avg_rating"),
        F.coalesce("top_genre", F.lit("—")).alias("top_genre"),
        F.coalesce("top_count", F.lit(0)).cast("bigint").alias("top_count"),
        col(F.coalesce("median_roi", F.lit(0.0))).alias("median_roi"),
        "disclosed_count")


def language_counts(docs: DataFrame, col: str = "lang", n: int = 10) -> DataFrame:
    """Top-k category counts (document languages)."""
    return top_categories(docs, col, n).select(
        F.col(col).alias("lang"), F.col("n_films").alias("n_docs"), "rank")


# ----------------------------------------------------------------- insights
def insight_share_growth(df, top_n=8, min_films=50, bucket_years=10):
    """Share change of each top genre between consecutive kept decades."""
    m = genre_matrix(df, top_n, bucket_years, min_films)
    w = Window.partitionBy("genre").orderBy("decade")  # one row per decade per genre
    prev = F.lag("share").over(w)
    return m.select("genre", "decade", F.lag("decade").over(w).alias("prev_decade"),
                    prev.alias("prev_share"), "share",
                    col(F.col("share") - prev).alias("delta"),
                    col(F.try_divide(F.col("share") - prev, prev)).alias("growth")
                    ).where(F.col("prev_decade").isNotNull())


def insight_leaders(df, top_n=8, min_films=50, bucket_years=10):
    """Leading genre per decade (max share, ties by rank) and each genre's
    peak decade."""
    m = genre_matrix(df, top_n, bucket_years, min_films)
    lead = m.groupBy("decade").agg(
        F.min_by("genre", F.struct(-F.col("n_films"), F.col("genre_rank"))).alias("leader"),
        F.max("share").alias("leader_share"))
    peak = m.groupBy("genre").agg(
        F.min_by("decade", F.struct(-F.col("share"), F.col("decade"))).alias("peak_decade"),
        F.max("share").alias("peak_share"))
    return (lead.select(F.lit("decade_leader").alias("kind"), F.col("decade").cast("string").alias("key"),
                        F.col("leader").alias("value"), F.col("leader_share").alias("share"))
            .unionByName(peak.select(F.lit("genre_peak").alias("kind"), F.col("genre").alias("key"),
                                     F.col("peak_decade").cast("string").alias("value"),
                                     F.col("peak_share").alias("share"))))


def insight_peak_bin(df: DataFrame, bin_width: float = 0.5, lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """The fullest bin of the rating histogram (ties: the lower one) and its share."""
    h = rating_histogram(df, bin_width, lo, hi)
    total = h.agg(F.sum("n_films").alias("_t")).withColumn("_k", F.lit(1))
    peak = h.orderBy(F.desc("n_films"), F.asc("bin")).limit(1).withColumn("_k", F.lit(1))
    return peak.join(total, "_k").select("bin", "bin_lo", "bin_hi", "n_films",
                                         F.try_divide(F.col("n_films"), F.col("_t")).alias("share"))
