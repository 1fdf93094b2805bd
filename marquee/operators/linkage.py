"""Id bridges, enrichment, work lists, record linkage, keyed registries and
user profiles.

All joins are equi-joins on keys; the one range predicate (record linkage's
year tolerance) is rewritten as equi-joins on pre-aggregated
``(title, year)`` keys, so a title shared by a third of all rows never turns
into a pair explosion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import try_double
from marquee.functions.positions import POS, positions
from marquee.functions.text import title_link_norm


# ------------------------------------------------------------ J1 - J4
def bridge_ratings(ratings: DataFrame, links: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """J1+J2: ratings keyed by external item id -> catalog id; links without
    a catalog id are dropped first, then only ids present in the catalog stay
    (a semi join: the id set is never collected)."""
    lk = links.where(F.col("catalog_id").isNotNull()).select("item_id", "catalog_id")
    r = ratings.join(lk, "item_id")
    return r.join(catalog_ids.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi")


def bridge_with_attrs(bridged: DataFrame, catalog: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bridged ratings with catalog attributes (inner)."""
    return bridged.join(catalog.select(F.col("id").alias("catalog_id"), *cols), "catalog_id")


def map_ids(df: DataFrame, mapping: DataFrame, key: str, value: str, seq: str,
            keep_unmapped: bool = True) -> DataFrame:
    """Dictionary lookup; the dictionary keeps the last entry per key
    (``max_by`` on load order). ``keep_unmapped`` = map (left join, null when
    absent); otherwise map + dropna (inner join)."""
    d = mapping.groupBy(key).agg(F.max_by(F.col(value), F.col(seq)).alias(value))
    return df.join(d, key, "left" if keep_unmapped else "inner")


# ------------------------------------------------------------ J5 / P34
def asset_name(ext_id) -> F.Column:
    """``tt`` + id zero-padded to 7 digits (longer ids unchanged) + ``.jpg``."""
    x = F.trim(F.col(ext_id) if isinstance(ext_id, str) else ext_id)
    return F.concat(F.lit("tt"), F.when(F.length(x) < 7, F.lpad(x, 7, "0")).otherwise(x),
                    F.lit(".jpg"))


def asset_urls(catalog: DataFrame, links: DataFrame, listing: DataFrame,
               prefix: str = "/static/posters") -> DataFrame:
    """Catalog left-joined to the asset URL of its link, when the asset
    file exists (semi join with the listing); the last matching link wins."""
    lk = (links.where(F.col("catalog_id").isNotNull() & F.col("ext_id").isNotNull())
          .select("catalog_id", asset_name("ext_id").alias("file"), "link_seq"))
    present = lk.join(listing.select("file"), "file", "left_semi")
    best = present.groupBy("catalog_id").agg(F.max_by("file", "link_seq").alias("file"))
    url = best.select(F.col("catalog_id").alias("id"),
                      F.concat(F.lit(prefix + "/"), F.col("file")).alias("poster_url"))
    return catalog.join(url, "id", "left")


# ---------------------------------------------------------------- J6
def pending_work(wanted: DataFrame, links: DataFrame, done: DataFrame) -> DataFrame:
    """Per wanted item its work status: ``no_map`` (no external id),
    ``done`` (asset exists) or ``todo``; keys must start with ``tt`` after
    trimming (P33)."""
    lk = links.where(F.col("catalog_id").isNotNull()).select(
        F.col("catalog_id").alias("id"), asset_name("ext_id").alias("file"))
    lk = lk.groupBy("id").agg(F.max("file").alias("file"))
    dn = (done.select(F.trim("file").alias("file")).where(F.col("file").startswith("tt"))
          .distinct().withColumn("_done", F.lit(True)))
    w = wanted.select("id").distinct().join(lk, "id", "left").join(dn, "file", "left")
    status = (F.when(F.col("file").isNull(), F.lit("no_map"))
              .when(F.col("_done"), F.lit("done")).otherwise(F.lit("todo")))
    return w.select("id", "file", status.alias("status"))


def pending_counters(work: DataFrame) -> DataFrame:
    """J6 counters: in scope, per status."""
    return work.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- J7
def link_records(left: DataFrame, cands: DataFrame, tolerance: int = 1) -> DataFrame:
    """For each left record (id, title, year) the first candidate (by
    ``cand_order``) with an equal linkage-normalised title, a year within
    ``tolerance`` (or either year null) and an asset.

    Candidates are first reduced to the best one per (title, year) and per
    title, then looked up with equi-joins at year-1, year, year+1.
    """
    c = (cands.where(F.col("has_asset"))
         .select(title_link_norm("title").alias("nt"), F.col("year").cast("int").alias("cy"),
                 "cand_id", "cand_order"))
    best = lambda g: F.min_by(F.struct("cand_order", "cand_id"), F.col("cand_order"))
    by_year = c.where(F.col("cy").isNotNull()).groupBy("nt", "cy").agg(best(None).alias("b"))
    by_title_null = c.where(F.col("cy").isNull()).groupBy("nt").agg(best(None).alias("bn"))
    by_title_any = c.groupBy("nt").agg(best(None).alias("ba"))

    l = left.select("id", title_link_norm("title").alias("nt"), F.col("year").cast("int").alias("ly"))
    offs = F.array(*[F.lit(d) for d in range(-tolerance, tolerance + 1)])
    known = l.where(F.col("ly").isNotNull()).select("id", "nt", F.explode(offs).alias("_d"), "ly") \
        .withColumn("cy", F.col("ly") + F.col("_d"))
    hit_year = known.join(by_year, ["nt", "cy"]).select("id", "nt", "b")
    with_null = l.where(F.col("ly").isNotNull()).join(by_title_null, "nt").select(
        "id", "nt", F.col("bn").alias("b"))
    unknown = l.where(F.col("ly").isNull()).join(by_title_any, "nt").select(
        "id", "nt", F.col("ba").alias("b"))
    allc = hit_year.unionByName(with_null).unionByName(unknown)
    pick = allc.groupBy("id").agg(F.min("b").alias("b"))
    return pick.select("id", F.col("b.cand_id").alias("cand_id"), F.col("b.cand_order").alias("cand_order"))


# ---------------------------------------------------------------- J8
def merge_sources(movies: DataFrame, credits: DataFrame, keywords: DataFrame,
                  key: str = "id") -> DataFrame:
    """Movies + credits + keywords on id; each side deduplicated first
    (keep first by its sequence column ``seq``), then two left joins."""
    def first(df):
        others = [c for c in df.columns if c not in (key, "seq")]
        return df.groupBy(key).agg(F.min_by(F.struct(*others), "seq").alias("_r")).select(key, "_r.*")
    return first(movies).join(first(credits), key, "left").join(first(keywords), key, "left")


# ---------------------------------------------------------------- P30
def clean_id_list(lists: DataFrame, list_col: str = "ids") -> DataFrame:
    """(request_id, [raw ids]) -> (request_id, item_id, pos): integer
    parse through double, junk dropped, duplicates keep their first position."""
    ex = lists.select("request_id", F.posexplode(list_col).alias("pos", "raw"))
    ex = ex.withColumn("v", try_double("raw")).where(
        F.col("v").isNotNull() & (F.col("v") == F.floor("v")))
    return (ex.groupBy("request_id", F.col("v").cast("bigint").alias("item_id"))
            .agg(F.min("pos").alias("pos")))


# ---------------------------------------------------------------- P32
def page_meta_extract(pages: DataFrame, prop: str = "og:image") -> DataFrame:
    """Content of ``<meta property=prop content=...>`` else 'error'."""
    pat = r'<meta[^>]+property=["\']' + prop.replace(".", r"\.") + r'["\'][^>]*content=["\']([^"\']+)["\']'
    v = F.regexp_extract("html", pat, 1)
    return pages.select("page_id", F.when(v == "", F.lit("error")).otherwise(v).alias("value"))


def page_title_extract(pages: DataFrame) -> DataFrame:
    """P32 variant: the ``<title>`` text, else 'error'."""
    v = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.select("page_id", F.when(v == "", F.lit("error")).otherwise(v).alias("value"))


# ------------------------------------------------------- S8 / S9 / A28
def upsert_latest(existing: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """INSERT OR REPLACE -- union, then the row with the largest ``seq``
    per key (``max_by``: map-side partial aggregation, skew-safe)."""
    u = existing.unionByName(updates)
    others = [c for c in u.columns if c not in (key,)]
    return u.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r")).select(key, "_r.*")


def delete_by_key(registry: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Delete rows whose key is listed (anti join)."""
    return registry.join(keys.select(key), key, "left_anti")


def delete_errors(registry: DataFrame, col: str = "poster_url") -> DataFrame:
    """Delete failed entries."""
    return registry.where(F.col(col) != "error")


def registry_counts(registry: DataFrame, col: str = "poster_url") -> DataFrame:
    """Entries and failed entries."""
    return registry.agg(F.count(F.lit(1)).alias("n_entries"),
                        F.count_if(F.col(col) == "error").alias("n_errors"))


# ----------------------------------------------------------- S12 / W6
def item_index_map(ids: DataFrame, id_col: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index of the sorted distinct ids (distributed
    range sort + partition offsets, no single-partition window)."""
    d = ids.select(id_col, *extra).dropDuplicates([id_col])
    return positions(d, [], [id_col]).withColumnRenamed(POS, "idx")


# ------------------------------------------------------ A27 / W1 / W2
def profile_shares(bridged: DataFrame, min_ratings: int = 50, user: str = "user_id",
                   genres: str = "genres") -> DataFrame:
    """Each rating counts for every genre of its item; share = genre
    count / the user's rating rows; users with >= min_ratings rows."""
    totals = bridged.groupBy(user).agg(F.count(F.lit(1)).alias("total")).where(
        F.col("total") >= min_ratings)
    ex = (bridged.join(totals.select(user), user, "left_semi")
          .select(user, F.explode(genres).alias("genre"))
          .where(F.col("genre").isNotNull() & (F.col("genre") != "")))
    counts = ex.groupBy(user, "genre").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, user).withColumn("share", F.col("n") / F.col("total"))


def profile_top_category(shares: DataFrame, user: str = "user_id") -> DataFrame:
    """Each user's top genre (share desc, genre asc). The window groups
    are one user's genres (bounded by the vocabulary)."""
    w = Window.partitionBy(user).orderBy(F.desc("share"), F.asc("genre"))
    return shares.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def profile_top_per_group(top: DataFrame, k: int = 3, user: str = "user_id") -> DataFrame:
    """The k users with the largest share per top genre."""
    w = Window.partitionBy("genre").orderBy(F.desc("share"), F.asc(user))
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
