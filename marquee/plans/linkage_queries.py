"""Registered join / linkage / registry / profile queries (J1-J8, P30-P35,
S8, S9, S12, S13, A27, A28, W1, W2, W6).

Fixture derivations (identical on both sides): links are the ``bridge`` view
plus a second, later link source for parts of size <= 10; the asset listing
is the files of parts that appear in returned line items; the poster
registry starts from every linked part and takes updates for 'Brand#1'.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.common import r6
from marquee.operators import clean as C
from marquee.operators import linkage as L
from marquee.plans.fixtures import view, with_views
from marquee.plans.registry import register
from marquee.sources.tables import read_table


def _asset_sql(x):
    return f"'tt' || CASE WHEN length(trim({x})) < 7 THEN lpad(trim({x}), 7, '0') ELSE trim({x}) END || '.jpg'"


# ------------------------------------------------------------ fixtures
def clean_ratings(spark, d):
    return C.clean_ratings(view(spark, d, "rating").select("user_id", "item_id", "rating", "ts"))


def links(spark, d):
    b = view(spark, d, "bridge")
    part = read_table(spark, d, "part", "p_partkey", "p_size")
    second = (b.join(part, b.item_id == part.p_partkey).where(F.col("p_size") <= 10)
              .select("item_id", "catalog_id",
                      (F.col("item_id") * 7 + 3).cast("string").alias("ext_id"),
                      (F.col("item_id") + 1_000_000).alias("link_seq")))
    return b.withColumn("link_seq", F.col("item_id")).unionByName(second)


def listing(spark, d):
    li = read_table(spark, d, "lineitem", "l_partkey", "l_returnflag")
    returned = li.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("catalog_id"))
    lk = links(spark, d).join(returned, "catalog_id", "left_semi")
    return lk.select(L.asset_name("ext_id").alias("file")).distinct()


def registry(spark, d):
    b = view(spark, d, "bridge")
    part = read_table(spark, d, "part", "p_partkey", "p_type", "p_brand")
    j = b.join(part, b.item_id == part.p_partkey)
    existing = j.select(L.asset_name("ext_id").alias("imdb_id"),
                        F.when(F.col("p_type") == "ECONOMY", F.lit("error"))
                        .otherwise(F.concat(F.lit("/p/"), F.col("ext_id"))).alias("poster_url"),
                        F.lit(0).alias("seq"))
    updates = j.where(F.col("p_brand") == "Brand#1").select(
        L.asset_name("ext_id").alias("imdb_id"),
        F.concat(F.lit("/p2/"), F.col("ext_id")).alias("poster_url"), F.lit(1).alias("seq"))
    return existing, updates


_FIX_SQL = [
    ("cr", "SELECT DISTINCT user_id, item_id, rating, ts FROM rating WHERE rating BETWEEN 0.5 AND 5.0"),
    ("links", """
  SELECT item_id, catalog_id, ext_id, item_id AS link_seq FROM bridge
  UNION ALL
  SELECT b.item_id, b.catalog_id, CAST(b.item_id * 7 + 3 AS VARCHAR), b.item_id + 1000000
  FROM bridge b JOIN part p ON b.item_id = p.p_partkey WHERE p.p_size <= 10"""),
    ("listing", f"""
  SELECT DISTINCT {_asset_sql('ext_id')} AS file FROM links
  WHERE catalog_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"""),
    ("bridged", """
  SELECT r.user_id, b.catalog_id, r.rating, r.ts FROM cr r JOIN bridge b ON r.item_id = b.item_id
  WHERE b.catalog_id IS NOT NULL AND b.catalog_id IN (SELECT id FROM catalog)"""),
    ("reg0", f"""
  SELECT {_asset_sql('b.ext_id')} AS imdb_id,
         CASE WHEN p.p_type = 'ECONOMY' THEN 'error' ELSE '/p/' || b.ext_id END AS poster_url, 0 AS seq
  FROM bridge b JOIN part p ON b.item_id = p.p_partkey"""),
    ("reg1", f"""
  SELECT {_asset_sql('b.ext_id')} AS imdb_id, '/p2/' || b.ext_id AS poster_url, 1 AS seq
  FROM bridge b JOIN part p ON b.item_id = p.p_partkey WHERE p.p_brand = 'Brand#1'"""),
]
_V = ["bridge", "catalog", "rating"]


def _bridged(spark, d):
    return L.bridge_ratings(clean_ratings(spark, d), view(spark, d, "bridge"), view(spark, d, "catalog"))


# ------------------------------------------------------------- J1 - J4
@register("bridge_ratings", with_views(_V, *_FIX_SQL, final="SELECT user_id, catalog_id, rating, ts FROM bridged"))
def q_bridge_ratings(spark, d):
    return _bridged(spark, d).select("user_id", "catalog_id", "rating", "ts")


@register("bridge_with_attrs", with_views(_V, *_FIX_SQL, final="""
SELECT b.user_id, b.catalog_id, b.rating, c.title, array_to_string(c.genres, ',') AS genres
FROM bridged b JOIN catalog c ON b.catalog_id = c.id"""))
def q_bridge_with_attrs(spark, d):
    j = L.bridge_with_attrs(_bridged(spark, d), view(spark, d, "catalog"), ["title", "genres"])
    return j.select("user_id", "catalog_id", "rating", "title", F.array_join("genres", ",").alias("genres"))


def _mapping(spark, d):
    lk = links(spark, d)
    part = read_table(spark, d, "part", "p_partkey", "p_size")
    return lk.join(part, lk.item_id == part.p_partkey).where(F.col("p_size") <= 30)


_MAP_SQL = ("mapping", """
  SELECT item_id, arg_max(ext_id, link_seq) AS ext_id FROM links l JOIN part p ON l.item_id = p.p_partkey
  WHERE p.p_size <= 30 GROUP BY item_id""")


@register("map_ids", with_views(_V, *_FIX_SQL, _MAP_SQL, final="""
SELECT r.user_id, r.item_id, m.ext_id FROM cr r LEFT JOIN mapping m ON r.item_id = m.item_id"""))
def q_map_ids(spark, d):
    out = L.map_ids(clean_ratings(spark, d), _mapping(spark, d), "item_id", "ext_id", "link_seq", True)
    return out.select("user_id", "item_id", "ext_id")


@register("map_ids_inner", with_views(_V, *_FIX_SQL, _MAP_SQL, final="""
SELECT r.user_id, r.item_id, m.ext_id FROM cr r JOIN mapping m ON r.item_id = m.item_id"""))
def q_map_ids_inner(spark, d):
    out = L.map_ids(clean_ratings(spark, d), _mapping(spark, d), "item_id", "ext_id", "link_seq", False)
    return out.select("user_id", "item_id", "ext_id")


# ------------------------------------------------------------ J5 / P34
_URL_SQL = ("urls", f"""
  SELECT catalog_id AS id, '/static/posters/' || arg_max(file, link_seq) AS poster_url FROM (
    SELECT catalog_id, {_asset_sql('ext_id')} AS file, link_seq FROM links
    WHERE catalog_id IS NOT NULL AND ext_id IS NOT NULL)
  WHERE file IN (SELECT file FROM listing) GROUP BY catalog_id""")


def _with_assets(spark, d):
    return L.asset_urls(view(spark, d, "catalog"), links(spark, d), listing(spark, d))


@register("asset_url", with_views(_V, *_FIX_SQL, _URL_SQL, final="""
SELECT c.id, u.poster_url FROM catalog c LEFT JOIN urls u ON c.id = u.id"""))
def q_asset_url(spark, d):
    return _with_assets(spark, d).select("id", "poster_url")


@register("asset_presence", with_views(_V, *_FIX_SQL, _URL_SQL, final="""
SELECT count(*) AS n_rows, count(u.poster_url) AS n_with_asset
FROM catalog c LEFT JOIN urls u ON c.id = u.id"""))
def q_asset_presence(spark, d):
    return C.presence_counts(_with_assets(spark, d).select("id", "poster_url"))


@register("financial_presence", with_views(["film"], final="""
SELECT count(*) AS n_rows, count_if(budget > 0 AND revenue > 0) AS n_financial FROM film"""))
def q_financial_presence(spark, d):
    return C.presence_counts(view(spark, d, "film").select("budget", "revenue"))


# ------------------------------------------------------------------ J6
_WORK_SQL = ("work", f"""
  SELECT w.id, lk.file,
         CASE WHEN lk.file IS NULL THEN 'no_map' WHEN dn.file IS NOT NULL THEN 'done' ELSE 'todo' END AS status
  FROM (SELECT DISTINCT id FROM catalog) w
  LEFT JOIN (SELECT catalog_id AS id, max({_asset_sql('ext_id')}) AS file FROM links
             WHERE catalog_id IS NOT NULL GROUP BY catalog_id) lk ON w.id = lk.id
  LEFT JOIN (SELECT DISTINCT trim(file) AS file FROM listing WHERE starts_with(trim(file), 'tt')) dn
    ON lk.file = dn.file""")


def _work(spark, d):
    return L.pending_work(view(spark, d, "catalog"), links(spark, d), listing(spark, d))


@register("pending_work", with_views(_V, *_FIX_SQL, _WORK_SQL, final="SELECT id, file, status FROM work"))
def q_pending_work(spark, d):
    return _work(spark, d)


@register("pending_counters", with_views(_V, *_FIX_SQL, _WORK_SQL, final="""
SELECT status, count(*) AS n FROM work GROUP BY status"""))
def q_pending_counters(spark, d):
    return L.pending_counters(_work(spark, d))


# ------------------------------------------------------------------ J7
def _link_inputs(spark, d):
    f = view(spark, d, "film")
    left = f.select("id", "title", F.when(F.col("id") % 13 == 0, F.lit(None))
                    .otherwise(F.col("release_year")).alias("year"))
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    cands = j.select(
        F.col("o_orderkey").alias("cand_id"),
        F.concat(F.col("c_name"), F.lit(" #"), ((F.col("o_orderkey") + 1) % 977).cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None))
        .otherwise(F.year("o_orderdate") + F.col("o_orderkey") % 3 - 1).alias("year"),
        (F.col("o_orderstatus") != "P").alias("has_asset"),
        F.col("o_orderkey").alias("cand_order"))
    return left, cands


_NT = r"trim(regexp_replace(regexp_replace(lower({t}), '[^\pL\pN_\s]', '', 'g'), '\s+', ' ', 'g'))"


@register("link_records", with_views(["film"], ("l", f"""
  SELECT id, {_NT.format(t='title')} AS nt,
         CASE WHEN id % 13 = 0 THEN NULL ELSE release_year END AS ly FROM film"""), ("c", f"""
  SELECT o.o_orderkey AS cand_id,
         {_NT.format(t="c.c_name || ' #' || CAST((o.o_orderkey + 1) % 977 AS VARCHAR)")} AS nt,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(year(o.o_orderdate) + o.o_orderkey % 3 - 1 AS INTEGER) END AS cy,
         o.o_orderstatus <> 'P' AS has_asset, o.o_orderkey AS cand_order
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""), final="""
SELECT id, cand_id, cand_order FROM (
  SELECT l.id, c.cand_id, c.cand_order,
         row_number() OVER (PARTITION BY l.id ORDER BY c.cand_order, c.cand_id) AS rn
  FROM l JOIN c ON l.nt = c.nt AND (l.ly IS NULL OR c.cy IS NULL OR abs(l.ly - c.cy) <= 1)
  WHERE c.has_asset) WHERE rn = 1"""))
def q_link_records(spark, d):
    left, cands = _link_inputs(spark, d)
    return L.link_records(left, cands, 1)


# ------------------------------------------------------------------ J8
def _merge_inputs(spark, d):
    f = view(spark, d, "film").select("id", "title", F.col("id").alias("seq"))
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    credits = j.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("director"),
                       F.lit(0).alias("seq")).unionByName(
        j.where(F.col("o_orderstatus") == "P").select(
            F.col("o_orderkey").alias("id"), F.lit("alt").alias("director"), F.lit(1).alias("seq")))
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_returnflag")
    kw = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("keywords")
    ).withColumn("seq", F.lit(0))
    return f, credits, kw


@register("merge_sources", with_views(["film"], final="""
SELECT f.id, f.title, c.director, k.keywords FROM film f
LEFT JOIN (SELECT o_orderkey AS id, c_name AS director FROM orders JOIN customer ON o_custkey = c_custkey) c
  ON f.id = c.id
LEFT JOIN (SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS keywords
           FROM lineitem GROUP BY l_orderkey) k ON f.id = k.id"""))
def q_merge_sources(spark, d):
    return L.merge_sources(*_merge_inputs(spark, d)).select("id", "title", "director", "keywords")


# ------------------------------------------------------------------ P30
def id_lists(spark, d):
    n = read_table(spark, d, "nation", "n_nationkey", "n_regionkey")
    k = F.col("n_nationkey")
    ids = F.array((k * 7).cast("string"), F.lit("abc"), (k * 7).cast("string"), F.lit("12.5"),
                  (F.col("n_regionkey") * 100 + 3).cast("string"), F.lit(" 42 "), F.lit(""),
                  (k * 7 + 1).cast("string"))
    return n.select(k.cast("bigint").alias("request_id"), ids.alias("ids"))


@register("clean_id_list", """
WITH lists AS (
  SELECT CAST(n_nationkey AS BIGINT) AS request_id,
         [CAST(n_nationkey * 7 AS VARCHAR), 'abc', CAST(n_nationkey * 7 AS VARCHAR), '12.5',
          CAST(n_regionkey * 100 + 3 AS VARCHAR), ' 42 ', '', CAST(n_nationkey * 7 + 1 AS VARCHAR)] AS ids
  FROM nation),
ex AS (SELECT request_id, unnest(ids) AS raw, generate_subscripts(ids, 1) - 1 AS pos FROM lists),
p AS (SELECT request_id, TRY_CAST(trim(raw) AS DOUBLE) AS v, pos FROM ex)
SELECT request_id, CAST(v AS BIGINT) AS item_id, CAST(min(pos) AS INTEGER) AS pos FROM p
WHERE v IS NOT NULL AND NOT isnan(v) AND v = floor(v) GROUP BY request_id, CAST(v AS BIGINT)""")
def q_clean_id_list(spark, d):
    return L.clean_id_list(id_lists(spark, d))


# ------------------------------------------------------------------ P32
@register("page_meta_extract", with_views(["page"], final=r"""
SELECT page_id, CASE WHEN v = '' THEN 'error' ELSE v END AS value FROM (
  SELECT page_id, regexp_extract(html, '<meta[^>]+property=["'']og:image["''][^>]*content=["'']([^"'']+)["'']', 1) AS v
  FROM page)"""))
def q_page_meta_extract(spark, d):
    return L.page_meta_extract(view(spark, d, "page"), "og:image")


@register("page_title_extract", with_views(["page"], final=r"""
SELECT page_id, CASE WHEN v = '' THEN 'error' ELSE v END AS value FROM (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS v FROM page)"""))
def q_page_title_extract(spark, d):
    return L.page_title_extract(view(spark, d, "page"))


# --------------------------------------------------- S8 / S9 / A28
_REG_SQL = ("reg", """
  SELECT imdb_id, arg_max(poster_url, seq) AS poster_url, max(seq) AS seq
  FROM (SELECT * FROM reg0 UNION ALL SELECT * FROM reg1) GROUP BY imdb_id""")


def _registry(spark, d):
    existing, updates = registry(spark, d)
    return L.upsert_latest(existing, updates, "imdb_id", "seq")


@register("upsert_latest", with_views(_V, *_FIX_SQL, _REG_SQL, final="SELECT imdb_id, poster_url, seq FROM reg"))
def q_upsert_latest(spark, d):
    return _registry(spark, d).select("imdb_id", "poster_url", "seq")


@register("delete_by_key", with_views(_V, *_FIX_SQL, _REG_SQL, final=f"""
SELECT imdb_id, poster_url FROM reg WHERE imdb_id NOT IN (
  SELECT {_asset_sql('b.ext_id')} FROM bridge b JOIN part p ON b.item_id = p.p_partkey WHERE p.p_size > 45)
  AND poster_url <> 'error'"""))
def q_delete_by_key(spark, d):
    b = view(spark, d, "bridge")
    part = read_table(spark, d, "part", "p_partkey", "p_size")
    keys = b.join(part, b.item_id == part.p_partkey).where(F.col("p_size") > 45).select(
        L.asset_name("ext_id").alias("imdb_id"))
    out = L.delete_errors(L.delete_by_key(_registry(spark, d), keys, "imdb_id"))
    return out.select("imdb_id", "poster_url")


@register("registry_counts", with_views(_V, *_FIX_SQL, _REG_SQL, final="""
SELECT count(*) AS n_entries, count_if(poster_url = 'error') AS n_errors FROM reg"""))
def q_registry_counts(spark, d):
    return L.registry_counts(_registry(spark, d))


# -------------------------------------------------------------- W6 / S12
@register("item_index_map", with_views(_V, *_FIX_SQL, final="""
SELECT CAST(row_number() OVER (ORDER BY b.catalog_id) - 1 AS BIGINT) AS idx, b.catalog_id AS id, c.title
FROM (SELECT DISTINCT catalog_id FROM bridged) b JOIN catalog c ON b.catalog_id = c.id"""))
def q_item_index_map(spark, d):
    ids = _bridged(spark, d).select(F.col("catalog_id").alias("id")).distinct()
    m = L.item_index_map(ids, "id")
    return m.join(view(spark, d, "catalog").select("id", "title"), "id").select("idx", "id", "title")


# ----------------------------------------------------- A27 / W1 / W2 / S13
_PROFILE_SQL = [
    ("b", "SELECT b.user_id, c.genres FROM bridged b JOIN catalog c ON b.catalog_id = c.id"),
    ("tot", "SELECT user_id, count(*) AS total FROM b GROUP BY user_id HAVING count(*) >= 50"),
    ("ex", "SELECT user_id, unnest(genres) AS genre FROM b WHERE user_id IN (SELECT user_id FROM tot)"),
    ("cnt", "SELECT user_id, genre, count(*) AS n FROM ex WHERE genre IS NOT NULL AND genre <> '' GROUP BY 1, 2"),
    ("shares", "SELECT c.user_id, c.genre, c.n, t.total, c.n / t.total AS share FROM cnt c JOIN tot t USING (user_id)"),
    ("top1", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, genre) AS r
             FROM shares) WHERE r = 1"""),
    ("top3", """SELECT *, CAST(row_number() OVER (PARTITION BY genre ORDER BY share DESC, user_id) AS INTEGER) AS rank
             FROM top1"""),
]


def _shares(spark, d):
    j = L.bridge_with_attrs(_bridged(spark, d), view(spark, d, "catalog"), ["genres"])
    return L.profile_shares(j, 50)


@register("profile_shares", with_views(_V, *_FIX_SQL, *_PROFILE_SQL, final="""
SELECT user_id, genre, n, total, round(share, 6) AS share FROM shares"""))
def q_profile_shares(spark, d):
    return _shares(spark, d).select("user_id", "genre", "n", "total", r6("share").alias("share"))


@register("profile_top_category", with_views(_V, *_FIX_SQL, *_PROFILE_SQL, final="""
SELECT user_id, genre, n, total, round(share, 6) AS share FROM top1"""))
def q_profile_top_category(spark, d):
    t = L.profile_top_category(_shares(spark, d))
    return t.select("user_id", "genre", "n", "total", r6("share").alias("share"))


@register("profile_top_per_group", with_views(_V, *_FIX_SQL, *_PROFILE_SQL, final="""
SELECT genre, user_id, round(share, 6) AS share, rank FROM top3 WHERE rank <= 3"""))
def q_profile_top_per_group(spark, d):
    t = L.profile_top_per_group(L.profile_top_category(_shares(spark, d)), 3)
    return t.select("genre", "user_id", r6("share").alias("share"), "rank")


@register("curated_profiles", with_views(_V, *_FIX_SQL, *_PROFILE_SQL, final="""
SELECT user_id AS id, genre || ' fan' AS label, genre AS top_genre, total AS n_ratings,
       round(share, 2) AS genre_share FROM top3 WHERE rank = 1"""))
def q_curated_profiles(spark, d):
    t = L.profile_top_per_group(L.profile_top_category(_shares(spark, d)), 1)
    return t.select(F.col("user_id").alias("id"), F.concat("genre", F.lit(" fan")).alias("label"),
                    F.col("genre").alias("top_genre"), F.col("total").alias("n_ratings"),
                    F.round("share", 2).alias("genre_share"))


@register("parse_nested_names", """
SELECT event_id,
       array_to_string(list_transform(from_json('[' || props || ']', '[{"id": "BIGINT", "k": "VARCHAR"}]'),
                                      lambda x: x.k), ',') AS names
FROM events""")
def q_parse_nested_names(spark, d):
    from marquee.sources.files import parse_nested_names
    ev = read_table(spark, d, "events", "event_id", "props")
    names = parse_nested_names(F.concat(F.lit("["), F.col("props"), F.lit("]")), field="k")
    return ev.select("event_id", F.array_join(names, ",").alias("names"))
