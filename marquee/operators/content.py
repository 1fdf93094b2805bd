"""Content similarity: weighted item documents, TF-IDF, cosine by inverted
index, dense-vector kNN and genre-set cosine.

TF-IDF follows the studied recommender's vectoriser settings: lower-case
word tokens of >= 2 characters, English stop words removed, terms kept when
2 <= df <= 0.8 * N, then the ``max_features`` terms with the largest corpus
count; weight ``(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)``, L2-normalised
per document. Cosine of two documents is the dot product of their weights,
computed for blocks of seeds against blocks of documents, term after term.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import col
from marquee.functions.text import director_token
from marquee.session import written

# Unicode word runs of two or more characters (the ``\b\w\w+\b`` token rule).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> list[str]:
    """Spark MLlib's English stop-word list (181 words), stored with the package."""
    path = os.path.join(os.path.dirname(__file__), "..", "functions", "stopwords_en.txt")
    with open(path, encoding="utf-8") as fh:
        return [w.strip() for w in fh if w.strip()]


# ------------------------------------------------------------ P25 / P26
def weighted_document(items: DataFrame, genre_w: int = 3, keyword_w: int = 2,
                      director_w: int = 5) -> DataFrame:
    """Overview + genres x3 + keywords x2 + director token x5."""
    def rep(arr_text, n):
        return F.repeat(F.concat(arr_text, F.lit(" ")), n)

    doc = F.concat(
        F.coalesce(F.col("overview"), F.lit("")), F.lit(" "),
        rep(F.array_join(F.coalesce("genres", F.array().cast("array<string>")), " "), genre_w),
        F.lit(" "),
        rep(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), keyword_w),
        F.lit(" "),
        rep(director_token("director"), director_w),
    )
    return items.select("id", doc.alias("doc"))


def empty_doc_rate(docs: DataFrame, warn_pct: float = 5.0) -> DataFrame:
    """Share of blank documents and whether it passes the warning line."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"),
                    F.count_if(F.trim("doc") == "").alias("n_empty")).select(
        "n_docs", "n_empty",
        col(F.when(F.col("n_docs") > 0, F.col("n_empty") * 100.0 / F.col("n_docs"))
           .otherwise(0.0)).alias("pct_empty"),
        (F.col("n_empty") * 100.0 > F.col("n_docs") * warn_pct).alias("warn"))


# ---------------------------------------------------------------- T1 - T3
def tfidf_tokens(docs: DataFrame, stop_words: Sequence[str] | None = None,
                 pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(id, term, tf) -- term counts per document after stop words."""
    sw = list(english_stop_words() if stop_words is None else stop_words)
    toks = docs.select("id", F.explode(F.regexp_extract_all(F.lower("doc"), F.lit(pattern), 0))
                       .alias("term"))
    if sw:
        toks = toks.where(~F.col("term").isin(sw))
    return toks.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocab(tokens: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.8,
                max_features: int = 20000) -> DataFrame:
    """(term, df, cf, rank) -- document-frequency window, then the
    ``max_features`` most frequent terms (ties by term). ``n_docs`` is a
    one-row frame with column ``n``."""
    stats = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    nd = F.broadcast(n_docs.select(F.col("n").alias("_n")))
    kept = stats.join(nd, how="inner", on=F.lit(True)).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df)).drop("_n")
    top = kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), F.asc("term"))))


def tfidf_weights(tokens: DataFrame, vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(id, term, w) with sublinear tf, smooth idf, unit L2 norm per doc."""
    nd = F.broadcast(n_docs.select(F.col("n").alias("_n")))
    v = vocab.select("term", "df").join(nd, how="inner", on=F.lit(True))
    idf = F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    # the vocabulary is capped at max_features rows: a proven broadcast bound
    raw = tokens.join(F.broadcast(v), "term").select(
        "id", "term", ((1.0 + F.log(F.col("tf").cast("double"))) * idf).alias("w0"))
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w0") / norm).alias("w"))


def build_tfidf(items: DataFrame, language: str | None = "en", stop_words=None,
                pattern: str = TOKEN_PATTERN, min_df: int = 2, max_df: float = 0.8,
                max_features: int = 20000, keep: bool = False) -> dict[str, DataFrame]:
    """P27 + P26 + T1-T3 in one place: the language subset, weighted docs,
    tokens, vocabulary and weights (all lazy DataFrames; with ``keep`` tokens and weights are written)."""
    sub = items.where(F.col("original_language") == language) if language else items
    docs = weighted_document(sub)
    toks = tfidf_tokens(docs, stop_words, pattern)
    if keep:
        toks = written(toks, "tokens")  # texts are cut into words once, for the vocabulary and the weights
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    vocab = tfidf_vocab(toks, n_docs, min_df, max_df, max_features)
    weights = tfidf_weights(toks, vocab, n_docs)
    if keep:
        weights = written(weights, "weights")
    return {"docs": docs, "tokens": toks, "vocab": vocab, "weights": weights, "n_docs": n_docs}


# ---------------------------------------------------------------- T4 - T6
def _terms(table: pa.Table, *columns: str) -> tuple[np.ndarray, ...]:
    """The lists of a block's rows laid end to end in the order of the terms: term, row, then ``columns``."""
    lists = table["terms"].combine_chunks()
    term = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(term, kind="stable")
    return tuple(x[order] for x in (term, row, *(
        table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in columns)))


def _shared(ta: np.ndarray, tb: np.ndarray):
    """The stretches of two ordered term lists that hold the same term."""
    both = np.intersect1d(ta, tb)
    return zip(*(np.searchsorted(t, both, side) for t in (ta, tb) for side in ("left", "right")))


def _join(parts: list, kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _dense(terms: np.ndarray, rows: np.ndarray, ws: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """The weights of the ``common`` terms (ascending) as a matrix, a row a document."""
    out = np.zeros((n, len(common)))
    at = np.searchsorted(common, terms)
    here = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == terms) if len(common) else np.zeros(0, dtype="i8")
    np.add.at(out, (rows[here], at[here]), ws[here])
    return out


def _nearest(row: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at`` the best ``n``, best first, equal to nine places by id."""
    if len(at) > n:
        least = np.partition(row[at], len(at) - n)[len(at) - n]
        at = at[row[at] >= least - 2e-9]  # rounding makes no other better
    return at[np.lexsort((ids[at], -np.round(row[at], 9)))[:n]]


def _cell(n: int | None, strip: int = 256, most_common: int = 256):
    """Similarities of a block of seeds with a block of items, a strip of seeds at a time: terms that an eighth of the items
    have (the ``most_common``, at most) by a product of dense matrices; of the others, term after term, the seeds' weights times
    the items' postings are added into the dense score block. A row goes out for each request of a seed
    (``blank``: also for one without an id)."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            ids = right["id"].combine_chunks().to_numpy()
            tb, rb, wb = _terms(right, "ws")
            terms, times = np.unique(tb, return_counts=True)
            common = np.argsort(-times, kind="stable")[:most_common]
            common = np.sort(terms[common[8 * times[common] >= len(ids)]])
            dense = np.ascontiguousarray(_dense(tb, rb, wb, common, len(ids)).T)
            rare = ~np.isin(tb, common)
            tb, rb, wb = tb[rare], rb[rare], wb[rare]
            for start in range(0, left.num_rows, strip):
                part = left.slice(start, strip)
                ta, ra, wa = _terms(part, "ws")
                block = _dense(ta, ra, wa, common, part.num_rows) @ dense
                for a0, a1, b0, b1 in _shared(ta, tb):
                    block[np.ix_(ra[a0:a1], rb[b0:b1])] += wa[a0:a1, None] * wb[None, b0:b1]
                for seed, named, blank, row in zip(*(part[c].to_pylist() for c in ("id", "requests", "blank")), block):
                    requests = [*named, 0] if blank else named
                    at = np.flatnonzero((row > 0) & (ids != seed))
                    if n is not None:
                        at = _nearest(row, at, ids, n)
                    out[0].append(np.repeat(np.array(requests, dtype=np.int64), len(at)))
                    out[1].append(np.full(len(at) * len(requests), seed, dtype=np.int64))
                    out[2].append(np.tile(ids[at], len(requests)))
                    out[3].append(np.tile(row[at], len(requests)))
                    out[4].append(np.repeat(np.arange(len(requests)) >= len(named), len(at)))
        return pa.table({"request_id": pa.array(_join(out[0], "i8"), pa.int64(), mask=_join(out[4], "?")),
                         "seed_id": pa.array(_join(out[1], "i8"), pa.int64()),
                         "item_id": pa.array(_join(out[2], "i8"), pa.int64()),
                         "sim": pa.array(_join(out[3], "f8"), pa.float64())})

    return score


def _vectors(weights: DataFrame) -> DataFrame:
    """One row per document: ``id, terms`` (hashes), ``ws``; written."""
    w = weights.select(F.col("id").cast("bigint").alias("id"), F.xxhash64("term").alias("t"), "w")
    pairs = w.groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("p"))  # one document's terms
    return written(pairs.select("id", F.col("p.t").alias("terms"), F.col("p.w").alias("ws")), "vectors")


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _every(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _eighth(rows: int, least: int, most: int) -> int:
    """Rows a block: an eighth of all, so that the other side is sent 8 times whatever its size, within bounds."""
    return max(least, min(most, -(-rows // 8)))


def _similarities(weights: DataFrame, seeds: DataFrame, n: int | None, block_items: int | None = None,
                  block_seeds: int | None = None, items: DataFrame | None = None) -> DataFrame:
    """(request_id, seed_id, item_id, sim > 0) of each distinct seed of (request_id, seed_id): with every
    item that shares a term, or per block of items the best ``n``. The vectors are written once; a
    group is one block of seeds with one block of items, each document's terms as one row. Blocks grow with their
    tables up to 16,384 seeds and 32,768 items, so a vector is sent about 8 times. A seed
    carries its requests, so no pair is shuffled. Of ``items`` (item_id) only, if given."""
    vec = _vectors(weights)
    found = vec if items is None else written(
        vec.join(items.select(F.col("item_id").cast("bigint").alias("id")), "id", "left_semi"), "found")
    requests = seeds.select(F.col("seed_id").cast("bigint").alias("id"), F.col("request_id").cast("bigint").alias("r")).groupBy(
        "id").agg(F.collect_set("r").alias("requests"), F.max(F.col("r").isNull()).alias("blank"))
    asked = written(vec.join(requests, "id"), "seeds")
    n_seeds, n_items = asked.count(), found.count()
    seeds_in = max(1, -(-n_seeds // (block_seeds or _eighth(n_seeds, 1024, 16_384))))
    items_in = max(1, -(-n_items // (block_items or _eighth(n_items, 4096, 32_768))))
    items_in = max(items_in, -(-16 // seeds_in))  # pairs enough for several tasks
    left = asked.select("id", "requests", "blank", "terms", "ws", _block("id", seeds_in).alias("sb"), _every(items_in).alias("ib"))
    right = found.select("id", "terms", "ws", _block("id", items_in).alias("ib"), _every(seeds_in).alias("sb"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    return left.groupBy("sb", "ib").cogroup(right.groupBy("sb", "ib")).applyInArrow(
        _cell(n), "request_id long, seed_id long, item_id long, sim double")


def seed_scores(weights: DataFrame, seeds: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """T5: (request_id, seed_id, item_id, sim) for every item sharing a term
    with a seed, the seed itself excluded (its own slot is 0). Unknown seeds
    produce nothing. With ``items`` (item_id), only these are compared with the seeds."""
    s = seeds.select("request_id", F.col("item_id").alias("seed_id")).distinct()
    return _similarities(weights, s, None, items=items)


def similar_items(weights: DataFrame, seeds: DataFrame, n: int = 10) -> DataFrame:
    """T4: top-n most similar items per (request, seed), sim > 0, ties by id."""
    s = seeds.select("request_id", F.col("item_id").alias("seed_id")).distinct()
    # rank on the similarity rounded to 1e-9 so float summation order never
    # reorders equal documents; ties go to the smaller id
    w = Window.partitionBy("request_id", "seed_id").orderBy(F.desc(F.round("sim", 9)), F.asc("item_id"))
    best = _similarities(weights, s, n).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.select("request_id", "seed_id", "item_id", "sim", "rank")


def _sums(strip: int = 256):
    """Per request and item of a block the sum of the item's similarities with the request's seeds
    other than itself: the seeds' weights are already added up per term, so an item that is a seed
    takes off its own squares. ``ns`` counts the seeds of a term, so that an item which shares
    terms with nothing but itself is told by whole numbers."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = right["id"].combine_chunks().to_numpy()
            order = np.argsort(ids)
            tb, rb, wb = _terms(right, "ws")
            squares = np.bincount(rb, wb * wb, len(ids))
            terms = np.bincount(rb, minlength=len(ids))
            for start in range(0, left.num_rows, strip):
                part = left.slice(start, strip)
                total, shared = np.zeros((2, part.num_rows, len(ids)))
                ta, ra, wa, na = _terms(part, "ws", "ns")
                for a0, a1, b0, b1 in _shared(ta, tb):
                    at = np.ix_(ra[a0:a1], rb[b0:b1])
                    total[at] += wa[a0:a1, None] * wb[None, b0:b1]
                    shared[at] += na[a0:a1, None]
                for request, own, row, count in zip(part["request_id"].to_pylist(), part["own"].to_pylist(), total, shared):
                    if own:
                        at = order[np.searchsorted(ids, np.array(own, dtype=np.int64), sorter=order)]
                        row[at] -= squares[at]
                        count[at] -= terms[at]
                    at = np.flatnonzero(count > 0)
                    out[0].append(np.full(len(at), request, dtype=np.int64))
                    out[1].append(ids[at])
                    out[2].append(row[at])
        return pa.table({"request_id": pa.array(_join(out[0], "i8"), pa.int64()),
                         "item_id": pa.array(_join(out[1], "i8"), pa.int64()),
                         "raw": pa.array(_join(out[2], "f8"), pa.float64())})

    return score


def _raw_scores(weights: DataFrame, seeds: DataFrame, catalog_ids: DataFrame, block_items: int = 8192,
                block_requests: int = 1024) -> DataFrame:
    """(request_id, item_id, raw) of catalog items: a request is one vector, the sum of its seeds' (weights are
    positive), so requests x items arise instead of seeds x items, and none of them is shuffled."""
    vec = _vectors(weights)
    s = seeds.select(F.col("request_id").cast("bigint").alias("request_id"), F.col("item_id").cast("bigint").alias("id")).where(
        "request_id IS NOT NULL").distinct().join(vec, "id")
    terms = s.select("request_id", F.explode(F.arrays_zip("terms", "ws")).alias("p")).groupBy("request_id", "p.terms").agg(
        F.sum("p.ws").alias("w"), F.count(F.lit(1)).alias("n"))
    asked = written(terms.groupBy("request_id").agg(F.collect_list(F.struct("terms", "w", "n")).alias("p"))  # one request's terms
                    .select("request_id", F.col("p.terms").alias("terms"), F.col("p.w").alias("ws"), F.col("p.n").alias("ns")), "asked")
    items = vec.join(catalog_ids.select(F.col("id").cast("bigint").alias("id")), "id", "left_semi")
    requests_in = max(1, -(-asked.count() // block_requests))
    items_in = max(1, -(-vec.count() // block_items))
    items_in = max(items_in, -(-16 // requests_in))
    own = s.join(items.select("id"), "id", "left_semi").groupBy("request_id", _block("id", items_in).alias("ib")).agg(
        F.collect_list("id").alias("own"))  # of one block
    left = asked.select("*", _block("request_id", requests_in).alias("rb"), _every(items_in).alias("ib"))
    left = left.join(own, ["request_id", "ib"], "left").select("request_id", "terms", "ws", "ns", "own", "rb", "ib")
    right = items.select("id", "terms", "ws", _block("id", items_in).alias("ib"), _every(requests_in).alias("rb"))
    right = right.toDF(*right.columns)
    return left.groupBy("rb", "ib").cogroup(right.groupBy("rb", "ib")).applyInArrow(
        _sums(), "request_id long, item_id long, raw double")


def content_scores(weights: DataFrame, seeds: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """Per request, the sum over seeds of positive similarities, on the
    catalog (absent = 0), min-max normalised over the whole catalog.

    Returns only items with a positive raw score (all others normalise to the
    same value, reported as ``zero_norm``); ``lo``/``hi`` come from one small
    aggregate per request."""
    raw = written(_raw_scores(weights, seeds, catalog_ids), "content-raw")
    n_cat = catalog_ids.agg(F.count(F.lit(1)).alias("_ncat"))
    per = raw.groupBy("request_id").agg(F.count(F.lit(1)).alias("_npos"), F.min("raw").alias("_mn"),
                                        F.max("raw").alias("_mx"))
    per = per.join(F.broadcast(n_cat), how="inner", on=F.lit(True))
    lo = F.when(F.col("_npos") < F.col("_ncat"), F.lit(0.0)).otherwise(F.col("_mn"))
    per = per.select("request_id", lo.alias("lo"), F.col("_mx").alias("hi"))
    out = raw.join(per, "request_id")
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))) \
        .otherwise(F.lit(0.0))
    zero = F.when(F.col("hi") > F.col("lo"), (F.lit(0.0) - F.col("lo")) / (F.col("hi") - F.col("lo"))) \
        .otherwise(F.lit(0.0))
    return out.select("request_id", "item_id", "raw", norm.alias("norm"), "lo", "hi",
                      zero.alias("zero_norm"))


# ---------------------------------------------------------------- T7
def _unit(vec: str):
    """The vector over its length (a zero vector stays)."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def embedding_knn(vectors: DataFrame, requests: DataFrame, k: int = 5,
                  id_col: str = "vec_id", vec_col: str = "embedding", block_items: int | None = None,
                  block_requests: int | None = None) -> DataFrame:
    """Exact cosine top-k neighbours (self excluded) of every requested item, as
    ``request_id, item_id, neighbor_id, sim, rank``.

    Each distinct item is searched once, in blocks of requested items against blocks
    of candidates (``score_requests``): a task keeps the best k of its block, so
    neither a pair table nor a set of request vectors is ever gathered.
    """
    from marquee.operators.collab import score_requests
    req = requests.select(F.col("request_id").cast("long"), F.col("item_id").cast("long")).distinct()
    unit = vectors.select(F.col(id_col).cast("long").alias("item_id"), _unit(vec_col).alias("v"))
    asked = unit.join(req.select("item_id").distinct(), "item_id", "left_semi").select(
        F.col("item_id").alias("request_id"), "v", F.lit(0.0).alias("off"))
    own = asked.select("request_id", F.col("request_id").alias("item_id"))
    out = score_requests(unit, asked, "v", "off", k, own, block_items=block_items, block_requests=block_requests)
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), F.asc("item_id"))
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("request_id").alias("item_id"), F.col("item_id").alias("neighbor_id"), F.col("score").alias("sim"), "rank")
    return req.join(best, "item_id").select("request_id", "item_id", "neighbor_id", "sim", "rank")


# ---------------------------------------------------------------- T8
def genre_sets(items: DataFrame, genres: str = "genres") -> DataFrame:
    """Items keyed by their distinct, sorted genre set."""
    gs = F.array_sort(F.array_distinct(F.coalesce(F.col(genres), F.array().cast("array<string>"))))
    return items.select("id", gs.alias("gset"), F.size(gs).alias("gsize"))


def genre_onehot_cosine(items: DataFrame, seeds: DataFrame, n: int = 10,
                        genres: str = "genres") -> DataFrame:
    """One-hot genre cosine ``|A & B| / sqrt(|A| |B|)`` of each seed with
    every item (self excluded, sim > 0), top-n per request and seed.

    Overlaps are computed between distinct genre *sets* (an inverted join on
    genre over the small set table), then expanded to the items of each set.
    """
    it = genre_sets(items, genres)
    sets = it.select("gset", "gsize").distinct()
    ex = sets.select("gset", "gsize", F.explode("gset").alias("g"))
    sd = seeds.select("request_id", F.col("item_id").alias("seed_id")).join(
        it.select(F.col("id").alias("seed_id"), F.col("gset").alias("sset"), F.col("gsize").alias("ssize")),
        "seed_id")
    sx = sd.select("request_id", "seed_id", "ssize", F.explode("sset").alias("g"))
    ov = sx.join(ex, "g").groupBy("request_id", "seed_id", "ssize", "gset", "gsize").agg(
        F.count(F.lit(1)).alias("inter"))
    sim = ov.select("request_id", "seed_id", "gset",
                    (F.col("inter") / F.sqrt(F.col("ssize") * F.col("gsize"))).alias("sim"))
    cand = sim.join(it.select(F.col("id").alias("item_id"), "gset"), "gset").where(
        F.col("item_id") != F.col("seed_id"))
    w = Window.partitionBy("request_id", "seed_id").orderBy(F.desc("sim"), F.asc("item_id"))
    return (cand.drop("gset").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def genre_similarity_range(items: DataFrame, genres: str = "genres") -> DataFrame:
    """Min and max off-diagonal one-hot cosine over all item pairs, from
    the set-level table (pairs of distinct sets and sets shared by >1 item)."""
    it = genre_sets(items, genres)
    sets = it.groupBy("gset", "gsize").agg(F.count(F.lit(1)).alias("n_items"))
    ex = sets.select("gset", "gsize", F.explode("gset").alias("g"))
    a = ex.select(F.col("gset").alias("a"), F.col("gsize").alias("na"), "g")
    b = ex.select(F.col("gset").alias("b"), F.col("gsize").alias("nb"), "g")
    ov = (a.join(b, "g").where(F.col("a") < F.col("b")).groupBy("a", "b", "na", "nb")
          .agg(F.count(F.lit(1)).alias("inter")))
    cross = ov.agg(F.count(F.lit(1)).alias("n_overlap_pairs"),
                   F.min(F.col("inter") / F.sqrt(F.col("na") * F.col("nb"))).alias("min_ov"),
                   F.max(F.col("inter") / F.sqrt(F.col("na") * F.col("nb"))).alias("max_ov"))
    st = sets.agg(F.count(F.lit(1)).alias("n_sets"),
                  F.max(F.when((F.col("n_items") > 1) & (F.col("gsize") > 0), 1.0)).alias("self_one"))
    j = st.join(cross, how="inner", on=F.lit(True))
    all_pairs = F.col("n_sets") * (F.col("n_sets") - 1) / 2
    mn = F.when(F.col("n_overlap_pairs") < all_pairs, F.lit(0.0)).otherwise(F.col("min_ov"))
    mn = F.when(F.col("self_one").isNotNull(), F.least(mn, F.lit(1.0))).otherwise(mn)
    mx = F.greatest(F.coalesce("max_ov", F.lit(0.0)), F.coalesce("self_one", F.lit(0.0)))
    return j.select(col(mn).alias("min_sim"), col(mx).alias("max_sim"), "n_sets")


# ---------------------------------------------------------------- T9
def genre_svd_embeddings(items: DataFrame, k: int = 10, genres: str = "genres"):
    """Rank-k SVD of the one-hot genre matrix through its genre x genre
    Gram (co-occurrence counts, one aggregate over per-item genre pairs), an
    eigen-decomposition of that small matrix on the driver, then item
    embeddings = sum of their genres' rows of V. Returns the (id, vec) table
    and the explained-variance ratio of the k components (column variances
    as in the decomposition of the uncentred matrix)."""
    it = genre_sets(items, genres)
    pairs = it.select(F.explode("gset").alias("a"), "gset").select(
        "a", F.explode("gset").alias("b"))
    co = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    n_items = it.count()
    vocab = sorted({r["a"] for r in co})
    if not vocab:
        raise ValueError("no genres")
    pos = {g: i for i, g in enumerate(vocab)}
    gm = np.zeros((len(vocab), len(vocab)))
    for r in co:
        gm[pos[r["a"]], pos[r["b"]]] = r["n"]
    k = max(1, min(k, len(vocab) - 1))
    lam, w = np.linalg.eigh(gm)
    order = np.argsort(-lam)[:k]
    v = w[:, order]
    mean = np.diag(gm) / n_items
    proj_var = np.array([v[:, i] @ gm @ v[:, i] / n_items - (mean @ v[:, i]) ** 2 for i in range(k)])
    total = float(np.sum(np.diag(gm) / n_items - mean ** 2))
    ratio = float(proj_var.sum() / total) if total > 0 else 0.0
    spark = items.sparkSession
    vt = spark.createDataFrame([(g, [float(x) for x in v[pos[g]]]) for g in vocab],
                               "g string, gv array<double>")
    # vt has one row per genre (the vocabulary): a bounded broadcast
    ex = it.select("id", F.explode("gset").alias("g")).join(F.broadcast(vt), "g")
    emb = ex.groupBy("id").agg(*[F.sum(F.col("gv")[i]).alias(f"_e{i}") for i in range(k)])
    emb = emb.select("id", F.array(*[F.col(f"_e{i}") for i in range(k)]).alias("vec"))
    empty = it.where(F.col("gsize") == 0).select("id", F.array_repeat(F.lit(0.0), k).alias("vec"))
    return emb.unionByName(empty), ratio
