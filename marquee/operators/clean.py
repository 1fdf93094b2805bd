"""Cleaning, typing and derived columns for catalogs and rating logs.

Every step is a plain column expression or a keyed aggregate, so the whole
cleaning job is one narrow pass per stage plus at most one shuffle for the
keep-first / last-wins dedupes. Keep-first uses ``min_by(struct, seq)`` per
key: partial aggregation means a key repeated in a third of all rows still
combines map-side, unlike a ``row_number()`` window partitioned by that key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import bucket, col, try_double, try_long
from marquee.functions.positions import grouped_quantiles
from marquee.functions.text import split_list, title_norm, vocab_filter

# The 20 canonical genres of the studied catalog (data_loader).
CANONICAL_GENRES = (
    "Action", "Adventure", "Animation", "Comedy", "Crime", "Documentary",
    "Drama", "Family", "Fantasy", "Foreign", "History", "Horror", "Music",
    "Mystery", "Romance", "Science Fiction", "TV Movie", "Thriller", "War",
    "Western",
)

NUMERIC_COLUMNS = ("vote_average", "runtime", "budget", "revenue", "profit", "roi", "popularity")


# ------------------------------------------------------------- P1 - P5
def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no non-null value (one aggregate pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def clean_required(df: DataFrame, subset: Sequence[str] = ("id", "title")) -> DataFrame:
    """Drop rows missing any required column."""
    return df.dropna(subset=list(subset))


def clean_coerce(df: DataFrame, numeric: Iterable[str] = NUMERIC_COLUMNS,
                 integer: Iterable[str] = ("release_year", "vote_count"),
                 id_col: str = "id") -> DataFrame:
    """Lenient numbers (junk and NaN -> null), integer id through double,
    rows whose id does not parse are dropped."""
    out = df.withColumn(id_col, try_long(id_col)).where(F.col(id_col).isNotNull())
    for c in integer:
        if c in df.columns:
            out = out.withColumn(c, try_double(c))
    for c in numeric:
        if c in df.columns:
            out = out.withColumn(c, try_double(c))
    return out


def decade_bucket(df: DataFrame, years: int = 10, year_col: str = "release_year",
                  out: str = "release_decade") -> DataFrame:
    """P5: recompute the bucket from the year (never trust a stored one)."""
    return df.withColumn(out, bucket(year_col, years))


# ------------------------------------------------------------- P6 - P8
def sanity_flags(df: DataFrame, rating_range=(0.0, 10.0), year_range=(1874, 2017)) -> DataFrame:
    v, y, t = F.col("vote_average"), F.col("release_year"), F.col("title").cast("string")
    return df.select(
        "*",
        (v.isNull() | v.between(*rating_range)).alias("_rating_ok"),
        (y.isNull() | y.between(*year_range)).alias("_year_ok"),
        (~F.coalesce(t, F.lit("")).contains("�")
         & ~F.coalesce(t, F.lit("")).rlike(r"^[\d./\s]+$")).alias("_title_ok"),
    )


def sanity_filter(df: DataFrame, **kw) -> DataFrame:
    """Keep rows whose rating, year and title look sane (null passes)."""
    f = sanity_flags(df, **kw)
    return f.where("_rating_ok AND _year_ok AND _title_ok").drop(
        "_rating_ok", "_year_ok", "_title_ok")


def sanity_drop_count(df: DataFrame, **kw) -> DataFrame:
    """P8 counter: rows before, dropped per rule (first failing), kept."""
    f = sanity_flags(df, **kw)
    return f.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~F.col("_rating_ok")).alias("bad_rating"),
        F.count_if(F.col("_rating_ok") & ~F.col("_year_ok")).alias("bad_year"),
        F.count_if(F.col("_rating_ok") & F.col("_year_ok") & ~F.col("_title_ok")).alias("bad_title"),
        F.count_if(F.col("_rating_ok") & F.col("_year_ok") & F.col("_title_ok")).alias("rows_after"),
    )


# ------------------------------------------------------------ P11 - P15
def zero_to_null(df: DataFrame, cols: Iterable[str] = ("budget", "revenue", "runtime")) -> DataFrame:
    """0 means 'undisclosed' for these columns."""
    for c in cols:
        df = df.withColumn(c, F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)))
    return df


def derive_financials(df: DataFrame) -> DataFrame:
    """Roi, profit and primary genre (first listed genre)."""
    return df.select(
        "*",
        F.try_divide(F.col("revenue"), F.col("budget")).alias("roi_derived"),
        (F.col("revenue") - F.col("budget")).alias("profit_derived"),
        F.get(F.col("genres_list"), 0).alias("primary_genre_derived"),
    )


def with_lists(df: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Split pipe lists, keep vocabulary genres (order and repeats
    kept), null out an out-of-vocabulary primary genre."""
    out = df.withColumn("genres_list", vocab_filter(split_list("genres_parsed"), vocab))
    if "keywords_parsed" in df.columns:
        out = out.withColumn("keywords_list", split_list("keywords_parsed"))
    if "top_cast" in df.columns:
        out = out.withColumn("top_cast_list", split_list("top_cast"))
    return out.withColumn(
        "primary_genre", F.when(F.col("primary_genre").isin(list(vocab)), F.col("primary_genre")))


# ----------------------------------------------------------------- P22
def weighted_score(df: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Bayesian score ``v/(v+m)*R + m/(v+m)*C`` over the rated rows
    (vote_count > 0): C = mean rating, m = exact ``quantile`` of vote counts.
    Missing votes count as 0, a missing rating as C.

    C and m are two scalars from one-row aggregates, attached with a
    broadcast join on a constant key (no shuffle of the catalog).
    """
    rated = df.where(F.col("vote_count") > 0)
    c = rated.agg(F.avg("vote_average").alias("_C"))
    m = grouped_quantiles(rated, [], "vote_count", [quantile], ["_m"]).select("_m")
    scal = c.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k", "left")
    out = df.withColumn("_k", F.lit(1)).join(F.broadcast(scal), "_k", "left").drop("_k")
    v = F.coalesce(F.col("vote_count").cast("double"), F.lit(0.0))
    r = F.coalesce(F.col("vote_average"), F.col("_C"))
    ws = v / (v + F.col("_m")) * r + F.col("_m") / (v + F.col("_m")) * F.col("_C")
    return out.withColumn("weighted_score", ws).drop("_C", "_m")


# ------------------------------------------------------ W3 / dedupes
def dedupe_keep_first(df: DataFrame, key: str | Sequence[str], seq: str = "load_seq") -> DataFrame:
    """One row per key, the one loaded first (smallest ``seq``)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.col(seq)).alias("_r"))
            .select(*keys, "_r.*"))


def keep_latest(df: DataFrame, key: str | Sequence[str], seq: str) -> DataFrame:
    """Last-wins per key (largest ``seq``)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.col(seq)).alias("_r"))
            .select(*keys, "_r.*"))


# ---------------------------------------------------- catalog cleaning
def clean_catalog(raw: DataFrame, vocab: Sequence[str] = CANONICAL_GENRES,
                  bucket_years: int = 10, scored: bool = True) -> DataFrame:
    """The catalog loader: required columns, typing, decade, sanity filter,
    search title, genre lists and, unless nobody asks for it, the weighted score (which
    takes scans of its own). Input columns are strings."""
    df = clean_required(raw, ("id", "title"))
    df = clean_coerce(df)
    df = decade_bucket(df, bucket_years)
    df = sanity_filter(df)
    df = df.withColumn("title_norm", title_norm("title"))
    df = with_lists(df, vocab)
    return weighted_score(df) if scored else df


# -------------------------------------------------- ETL stages
ETL_STEPS = ("duplicate_id", "not_released", "invalid_date", "after_cutoff", "few_votes")


def etl_flags(raw: DataFrame, key: str = "id", seq: str = "load_seq",
              released: str = "F", cutoff: str = "2017-08-01", min_votes: int = 10) -> DataFrame:
    """Per row: parsed date and the first ETL step that rejects it (null = kept)."""
    firsts = raw.groupBy(key).agg(F.min(seq).alias(seq)).withColumn("_first", F.lit(True))
    f = raw.join(firsts, [key, seq], "left")
    d = F.try_to_date(F.col("release_date"), "yyyy-MM-dd")
    votes = try_double("vote_count")
    step = (F.when(F.col("_first").isNull(), F.lit(1))
            .when(F.coalesce(F.col("status"), F.lit("")) != released, F.lit(2))
            .when(d.isNull(), F.lit(3))
            .when(d >= F.to_date(F.lit(cutoff)), F.lit(4))
            .when(F.coalesce(votes, F.lit(0.0)) < min_votes, F.lit(5)))
    return f.withColumn("release_date_parsed", d).withColumn("_step", step).drop("_first")


def etl_catalog(raw: DataFrame, **kw) -> DataFrame:
    """P16-P19 + W3 + P14/P15: keep-first ids, released, valid date before the
    cut-off, enough votes; zeros -> null; roi, profit, year and decade."""
    f = etl_flags(raw, **kw).where(F.col("_step").isNull()).drop("_step")
    budget, revenue, runtime = (F.nullif(try_double(c), F.lit(0.0)) for c in
                                ("budget", "revenue", "runtime"))
    d = F.col("release_date_parsed")
    return f.select(
        try_long("id").alias("id"), "title", d.alias("release_date"),
        F.year(d).alias("release_year"), bucket(F.year(d), 10).alias("release_decade"),
        F.get(split_list("genres_parsed"), 0).alias("primary_genre"),
        budget.alias("budget"), revenue.alias("revenue"), runtime.alias("runtime"),
        F.try_divide(revenue, budget).alias("roi"), (revenue - budget).alias("profit"),
        try_double("vote_average").alias("vote_average"),
        try_long("vote_count").alias("vote_count"),
    )


def etl_funnel(raw: DataFrame, **kw) -> DataFrame:
    """Rows before/after each ETL step, from one pass (first failing
    step per row) instead of one count per step."""
    f = etl_flags(raw, **kw)
    agg = f.agg(F.count(F.lit(1)).alias("_total"),
                *[F.count_if(F.col("_step") == i + 1).alias(f"_d{i}") for i in range(len(ETL_STEPS))])
    rows = []
    for i, name in enumerate(ETL_STEPS):
        before = F.col("_total") - sum((F.col(f"_d{j}") for j in range(i)), F.lit(0))
        rows.append(F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"),
                             before.alias("rows_before"), F.col(f"_d{i}").alias("dropped"),
                             (before - F.col(f"_d{i}")).alias("rows_after")))
    return agg.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


# ------------------------------------------------------ ratings (P20/21)
def epoch_to_timestamp(df: DataFrame, epoch: str = "timestamp") -> DataFrame:
    """P20: epoch seconds (lenient; junk is null) to ``ts`` and ``rating_year`` (session time zone)."""
    ts = F.timestamp_seconds(try_double(epoch))
    return df.withColumn("ts", ts).withColumn("rating_year", F.year("ts"))


def clean_ratings(ratings: DataFrame, lo: float = 0.5, hi: float = 5.0) -> DataFrame:
    """Exact duplicates dropped, rating in [lo, hi], timestamp and
    rating year derived (session time zone UTC)."""
    r = ratings.dropDuplicates(["user_id", "item_id", "rating", "ts"])
    r = r.where(F.col("rating").between(lo, hi))
    ts = F.col("ts")
    return r.select("*", F.year(ts).alias("rating_year"))


# --------------------------------------------------- profiles
def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, most missing first."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
                      for i, c in enumerate(cols)])
    return one.select("_n", F.explode(cells).alias("c")).select(
        "c.column", "c.n_missing",
        col(F.when(F.col("_n") > 0, F.col("c.n_missing") * 100.0 / F.col("_n"))).alias("pct"))


def zero_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zeros counted as implicit missing values."""
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(try_double(c) == 0).alias(f"_z{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("n_zero"))
                      for i, c in enumerate(cols)])
    return one.select("_n", F.explode(cells).alias("c")).select(
        "c.column", "c.n_zero",
        col(F.when(F.col("_n") > 0, F.col("c.n_zero") * 100.0 / F.col("_n"))).alias("pct"))


def numeric_describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("c")).select("c.*").where(F.col("value").isNotNull())
    basic = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = grouped_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    out = basic.join(q.drop("n"), "column")
    return out.select("column", "count", *[col(c).alias(c) for c in
                                           ("mean", "std", "min", "p25", "p50", "p75", "max")])


def distinct_counts(df: DataFrame, sets: dict[str, Sequence[Column | str]],
                    carried: Sequence[Column] = ()) -> tuple[DataFrame, list[Column]]:
    """Several distinct counts by one two-level aggregate: every row sends a number and a 128-bit hash per
    set of columns, equal ones are combined before the shuffle, and only hashes are shuffled.

    Returns the first level (``kind``: place of the set; ``a``, ``b``: its hash, null where a set of
    one column is null; ``times``; ``carried`` aggregates, which belong to ``kind`` 0) and the columns of the second: one distinct
    count per set, named by it.
    """
    marks = []
    for i, columns in enumerate(sets.values()):
        cols = [col(c) for c in columns]
        values = [*cols, *[c.isNull() for c in cols]]  # a hash skips nulls
        known = cols[0].isNotNull() if len(cols) == 1 else F.lit(True)
        marks.append(F.struct(F.lit(i).alias("kind"), F.when(known, F.xxhash64(*values)).alias("a"),
                              F.when(known, F.xxhash64(F.lit(i + 1), *values)).alias("b")))
    rows = df.select("*", F.explode(F.array(*marks)).alias("_mark"))
    level = rows.groupBy("_mark.kind", "_mark.a", "_mark.b").agg(F.count(F.lit(1)).alias("times"), *carried)
    return level, [F.count(F.when(F.col("kind") == i, F.col("a"))).alias(name) for i, name in enumerate(sets)]


def duplicate_audit(df: DataFrame, key: str = "id") -> DataFrame:
    """Repeated keys and fully repeated rows."""
    level, counts = distinct_counts(df, {"n_keys": [f"`{key}`"], "n_distinct": [f"`{c}`" for c in df.columns]})
    total = level.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("times"))), F.lit(0)).alias("n_rows"), *counts)
    # a table of one column: a null row is a row
    distinct = F.col("n_distinct")
    if len(df.columns) == 1:
        total = total.join(level.where("kind = 1 AND a IS NULL").agg(F.count(F.lit(1)).alias("_none")), how="inner", on=F.lit(True))
        distinct = distinct + F.col("_none")
    return total.select("n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("repeated_keys"),
                        (F.col("n_rows") - distinct).alias("repeated_rows"))


def overview_stats(ratings: DataFrame) -> DataFrame:
    """Distinct users and items, time span, year span, distinct decades."""
    ts = F.col("ts")
    level, counts = distinct_counts(
        ratings, {"n_users": ["user_id"], "n_items": ["item_id"], "n_decades": [bucket(F.year(ts), 10)]},
        [F.min(ts).alias("first"), F.max(ts).alias("last")])
    total = level.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("times"))), F.lit(0)).alias("n_ratings"), *counts,
                      F.min("first").alias("first"), F.max("last").alias("last"))
    return total.select(
        "n_ratings", "n_users", "n_items", F.col("first").cast("string").alias("first_ts"),
        F.col("last").cast("string").alias("last_ts"), F.year("first").alias("first_year"), F.year("last").alias("last_year"),
        "n_decades")


def presence_counts(df: DataFrame) -> DataFrame:
    """Rows, rows with both financials > 0, rows with an asset (each
    counter only when its columns exist)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if "budget" in df.columns and "revenue" in df.columns:
        aggs.append(F.count_if((F.col("budget") > 0) & (F.col("revenue") > 0)).alias("n_financial"))
    if "poster_url" in df.columns:
        aggs.append(F.count_if(F.col("poster_url").isNotNull()).alias("n_with_asset"))
    return df.agg(*aggs)

