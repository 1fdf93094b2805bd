"""Browse, search, sort, paging and lookups over a cleaned catalog.

Requests are tables: lookups ``(request_id, item_id)``, searches
``(query_id, q)``; every result carries the request id and "top k" is per
request. Per-request top-k uses ``row_number() <= k`` which Spark plans with
a partial WindowGroupLimit before the shuffle, so even a request matching the
whole catalog ships only k rows per input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.positions import POS, positions
from marquee.functions.text import title_norm

# mode -> (sort column, descending)
SORT_MODES = {
    "normal": ("load_seq", False),
    "popular": ("weighted_score", True),
    "rate": ("vote_average", True),
    "date": ("release_year", True),
}


def sort_order(mode: str = "normal", descending: bool = False,
               tie=("id", "load_seq")) -> list[Column]:
    """O1: sort keys of a browse mode, then the unique tie-break columns."""
    if mode not in SORT_MODES:
        raise ValueError(f"unknown sort mode {mode}")
    name, desc = SORT_MODES[mode]
    if descending and mode == "normal":
        desc = True
    keys = [F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last()]
    return keys + [F.col(t).asc() for t in tie]


def category_filter(df: DataFrame, genre: str | None) -> DataFrame:
    """O3: keep items whose genre list contains ``genre``; 'all'/'' = no filter."""
    if genre is None or genre == "" or genre.lower() == "all":
        return df
    return df.where(F.array_contains("genres_list", genre))


def _page_size(per_page) -> int:
    if int(per_page) < 1:
        raise ValueError("a page has at least one row")
    return int(per_page)


def browse_page(df: DataFrame, mode: str = "popular", page: int = 1, per_page: int = 24) -> DataFrame:
    """One page: sort and ``offset``/``limit`` (a bounded top-k)."""
    page, per_page = max(1, int(page)), _page_size(per_page)
    return df.orderBy(*sort_order(mode)).offset((page - 1) * per_page).limit(per_page)


def browse_pages(df: DataFrame, mode: str = "popular", per_page: int = 24) -> DataFrame:
    """O2 for every row: position in the browse order and page number.

    Positions come from written range partitions plus per-partition offsets
    (``marquee.functions.positions``), never a global single-task window; the
    result can be written partitioned by page.
    """
    per_page = _page_size(per_page)
    ranked = positions(df, [], sort_order(mode))
    return ranked.withColumn("position", F.col(POS) + 1).drop(POS).withColumn(
        "page", (F.floor((F.col("position") - 1) / per_page) + 1).cast("bigint"))


def page_meta(df: DataFrame, per_page: int = 24) -> DataFrame:
    """O2 counters: total rows and ``max(1, ceil(total / per_page))`` pages."""
    per_page = _page_size(per_page)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
        .alias("total_pages"))


# --------------------------------------------------------------- search
def _grams(s: Column, n: int) -> Column:
    """Distinct substrings of length ``n`` of ``s`` (empty when shorter)."""
    idx = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(0)))
    return F.array_distinct(F.transform(idx, lambda i: F.substring(s, i, n)))


def title_gram_index(catalog: DataFrame, keys=("id",), col: str = "title_norm") -> DataFrame:
    """(keys, gram): every distinct 1-, 2- and 3-gram of the search title,
    plus the empty gram that blank queries join on. ``keys`` identify a row."""
    s = F.col(col)
    grams = F.concat(F.array(F.lit("")), _grams(s, 1), _grams(s, 2), _grams(s, 3))
    return catalog.select(*keys, F.explode(F.array_distinct(grams)).alias("gram"))


def query_grams(queries: DataFrame) -> DataFrame:
    """(query_id, q_norm, gram, n_grams) -- 3-grams of the normalised query;
    a 1-2 character query is its own gram, a blank query the empty gram."""
    qn = title_norm("q")
    g = F.when(F.length(qn) >= 3, _grams(qn, 3)).otherwise(F.array(qn))
    base = queries.select("query_id", qn.alias("q_norm"), g.alias("_g"))
    return base.select("query_id", "q_norm", F.size("_g").alias("n_grams"),
                       F.explode("_g").alias("gram"))


def _containing(patterns: list[str]):
    """Which of the patterns a title contains (one pass over it, by an Aho-Corasick automaton)."""
    blank = {p for p in patterns if not p}

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for p in patterns:
            if p:
                automaton.add_word(p, p)
        some = len(automaton) > 0
        if some:
            automaton.make_automaton()
        for titles in batches:
            yield pd.Series([None if t is None else list(blank.union(p for _, p in automaton.iter(t)) if some else blank)
                             for t in titles], dtype=object)

    return find


def search_title(catalog: DataFrame, queries: DataFrame, keys=("id",), most_patterns: int = 100_000,
                 most_chars: int = 4_000_000) -> DataFrame:
    """Forgiving substring search of every query against ``title_norm``. A blank query
    matches every item; a null title nothing.

    The requests are the index: their distinct strings, if there are at most ``most_patterns`` of
    at most ``most_chars`` characters together, become an automaton that every title is passed through where it is
    read, so only hits are shuffled. Beyond that, titles and requests meet on shared 3-grams
    (``search_by_grams``).
    """
    asked = queries.select("query_id", title_norm("q").alias("q_norm")).where(F.col("q_norm").isNotNull())
    distinct = asked.select("q_norm").distinct()
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("q_norm")).alias("chars")).first()
    if size["n"] > most_patterns or (size["chars"] or 0) > most_chars:
        return search_by_grams(catalog, queries, keys)
    # checked above; not deterministic, so that the planner does not run it twice
    find = _containing([r["q_norm"] for r in distinct.collect()]).asNondeterministic()
    hits = (catalog.withColumn("_found", find("title_norm")).where(F.size("_found") > 0)
            .withColumn("q_norm", F.explode("_found")).drop("_found"))
    return hits.join(asked, "q_norm")


def search_by_grams(catalog: DataFrame, queries: DataFrame, keys=("id",)) -> DataFrame:
    """``search_title`` for any number of requests: an n-gram inverted index turns the substring
    test into an equi-join. Items sharing all of a query's 3-grams are candidates, then the exact
    ``contains`` check confirms them.
    """
    keys = list(keys)
    qg = query_grams(queries)
    idx = title_gram_index(catalog, keys)
    cand = (qg.join(idx, "gram")
            .groupBy("query_id", "q_norm", *keys, "n_grams")
            .agg(F.count(F.lit(1)).alias("_hit"))
            .where(F.col("_hit") == F.col("n_grams")))
    hits = cand.join(catalog, keys).where(F.col("title_norm").contains(F.col("q_norm")))
    return hits.drop("_hit", "n_grams")


def suggest_titles(catalog: DataFrame, queries: DataFrame, k: int = 5,
                   mode: str = "normal", keys=("id",)) -> DataFrame:
    """The first ``k`` search hits per query in browse order."""
    hits = search_title(catalog, queries, keys)
    w = Window.partitionBy("query_id").orderBy(*sort_order(mode))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --------------------------------------------------- projections, lookups
def list_projection(df: DataFrame) -> DataFrame:
    """The slim list payload."""
    return df.select(
        F.col("id").cast("bigint").alias("id"), "title",
        F.col("release_year").cast("int").alias("release_year"),
        "primary_genre", F.col("vote_average").cast("double").alias("vote_average"),
        (F.col("poster_url") if "poster_url" in df.columns
         else F.lit(None).cast("string")).alias("poster_url"))


def detail_projection(df: DataFrame) -> DataFrame:
    """The 21-field detail payload, null-safe (missing columns -> null,
    missing lists -> [], missing overview -> '')."""
    have = set(df.columns)

    def pick(name, src=None, default=None):
        src = src or name
        if src in have:
            return F.col(src).alias(name)
        return (default if default is not None else F.lit(None)).alias(name)

    empty = F.array().cast("array<string>")
    return df.select(
        F.col("id").cast("bigint").alias("id"), pick("title"),
        F.col("release_year").cast("int").alias("release_year"),
        F.col("release_decade").cast("int").alias("release_decade") if "release_decade" in have
        else F.lit(None).cast("int").alias("release_decade"),
        pick("primary_genre"),
        F.coalesce(F.col("genres_list"), empty).alias("genres") if "genres_list" in have
        else empty.alias("genres"),
        F.coalesce(F.col("keywords_list"), empty).alias("keywords") if "keywords_list" in have
        else empty.alias("keywords"),
        F.coalesce(F.col("overview"), F.lit("")).alias("overview") if "overview" in have
        else F.lit("").alias("overview"),
        pick("vote_average"), pick("vote_count"), pick("director"),
        F.coalesce(F.col("top_cast_list"), empty).alias("top_cast") if "top_cast_list" in have
        else empty.alias("top_cast"),
        *[pick(c) for c in ("runtime", "budget", "revenue", "profit", "roi", "popularity",
                            "original_language", "countries", "poster_url")],
    )


def lookup_items(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Point lookups as a left join from the request table, so a miss
    stays visible as a row with ``found = false``."""
    cat = catalog.withColumn("_found", F.lit(True))
    out = requests.join(cat, requests.item_id == cat.id, "left")
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def category_dim(df: DataFrame, col: str = "genres_list") -> DataFrame:
    """Sorted distinct categories."""
    return (df.select(F.explode(col).alias("genre")).distinct().orderBy("genre"))
