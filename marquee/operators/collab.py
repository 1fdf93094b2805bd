"""Collaborative filtering: centred rating matrix, truncated SVD, fold-in,
predictions, top-n for users, and the hybrid blend with explanations.

Truncated SVD restarts a basis of fixed width from its Ritz vectors (filtered by a Chebyshev
polynomial of A^T A), stopped by the residual of the k leading vectors. Ratings lie in cells of
a block of users and a block of items (``functions/blocks.py``), so a pass is linear in the number of
ratings, and a user with a third of all ratings is spread over all item blocks; only matrices of the basis'
width reach the driver. The tables of a step are written to the shared folder, so lost
executors recompute at most one product.

Scoring every item for each request (top-n for users, fold-in) is a product of
blocks of requests with blocks of items: one group per pair of blocks, numpy inside
the task, seen items masked and the best n kept there. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import blocks as BL
from marquee.functions import linalg as LA
from marquee.functions.positions import POS, first_free, positions
from marquee.session import discarded, written

K_FACTORS = 50
#: Singular vectors that are taken out of the matrix when found, while others are sought.
MOST_KNOWN = 8


# ------------------------------------------------------------------ R1
def rating_matrix(bridged: DataFrame, user: str = "user_id", item: str = "catalog_id",
                  rating: str = "rating", center: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(user_id, item_id, value)`` with value = rating - user mean,
    duplicate (user, item) entries summed; plus ``(user_id, mu, n)``."""
    r = bridged.select(F.col(user).alias("user_id"), F.col(item).alias("item_id"),
                       F.col(rating).cast("double").alias("rating"))
    means = r.groupBy("user_id").agg(F.avg("rating").alias("mu"), F.count(F.lit(1)).alias("n"))
    if center:
        c = r.join(means.select("user_id", "mu"), "user_id").select(
            "user_id", "item_id", (F.col("rating") - F.col("mu")).alias("value"))
    else:
        c = r.select("user_id", "item_id", F.col("rating").alias("value"))
    m = c.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
    return m, means


def matrix_status(entries: DataFrame) -> DataFrame:
    """Shape and sparsity ``1 - nnz / (users * items)``."""
    return entries.agg(F.count_distinct("user_id").alias("n_users"),
                       F.count_distinct("item_id").alias("n_items"),
                       F.count(F.lit(1)).alias("nnz")).select(
        "n_users", "n_items", "nnz",
        F.round(1 - F.col("nnz") / (F.col("n_users") * F.col("n_items")), 6).alias("sparsity"))


# ------------------------------------------------------------------ R2
def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The turn that makes columns of this Gram matrix orthonormal; dependent ones drop out."""
    length = np.sqrt(np.diag(gram))
    length = np.where(length > 1e-150, length, np.inf)
    lam, u = np.linalg.eigh(gram / length[:, None] / length[None, :])
    good = lam > 1e-13 * max(lam[-1], 1e-300)
    return (u[:, good] / np.sqrt(lam[good])) / length[:, None]


def _ritz(gram: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, largest first, and the turn to their vectors."""
    low = np.linalg.inv(np.linalg.cholesky((gram + gram.T) / 2))
    t = low @ ((image + image.T) / 2) @ low.T
    theta, s = np.linalg.eigh((t + t.T) / 2)
    return theta[::-1], low.T @ s[:, ::-1]


def _spread(theta: np.ndarray, cut: float, most: int) -> int:
    """Degree of the filter on [0, cut]: as high as double precision bears, at most ``most``."""
    at = 2.0 * theta[0] / cut - 1.0
    return most if at <= 1.0 else max(1, min(most, int(16.0 / np.arccosh(at))))


def _needed(value: float, cut: float, over: float) -> int:
    """Degree at which the filter on [0, cut] takes a residual ``over`` times too large a hundred times below the tolerance, by
    its growth at the smallest wanted ``value``."""
    at = np.arccosh(max(1.0, 2.0 * value / cut - 1.0))
    return int(min(1e6, np.ceil(np.arccosh(max(1.0, 100.0 * over)) / max(at, 1e-6)))) + 1


def truncated_svd(entries: DataFrame, k: int = K_FACTORS, tol: float = 1e-9, width: int | None = None,
                  max_cycles: int = 200, degree: int = 64, seed: int = 42, block: int = 2048, whole: int = BL.WHOLE) -> dict:
    """R2: rank-k SVD ``A ~ U diag(s) V^T`` of the (user, item, value) matrix.

    Returns ``sigma`` (numpy, descending), ``users`` (key, vec = U row) and
    ``items`` (key, vec = V row) factor tables. ``k`` is capped at
    ``min(shape) - 1``. A basis of fixed ``width`` (5k / 2, or all items if fewer) is restarted in every
    cycle from its Ritz vectors: a Chebyshev polynomial of A^T A that is small on the
    unwanted part of the spectrum (zero to the smallest Ritz value) is applied to them, the result made orthonormal,
    and Ritz vectors taken anew, until ``|A^T A v - s^2 v| <= tol * s_1^2`` for the k leading ones. A basis
    that closes under ``A^T A`` is exact up to rounding. Leading vectors found to a tenth of that are taken out
    of the polynomial of the others (``A^T A - V diag(s^2) V^T``), so that a few large values do not keep its degree low. Not converging raises. Up to ``whole`` ratings a task
    may hold all of them (``functions/blocks.py``).
    """
    kept_entries = written(entries.select("user_id", "item_id", "value"), "entries")
    a = BL.cells(kept_entries, "user_id", "item_id", "value", block, whole)
    discarded(kept_entries)
    if not a.n_rows or not a.n_cols:
        raise ValueError("empty rating matrix")
    k = max(1, min(k, min(a.n_rows, a.n_cols) - 1))
    width = min(width or max(k + 8, 5 * k // 2), a.n_cols)

    starts = a.col_keys.select(F.col("block").alias("key"), F.size("keys").alias("n"))

    def first(batches):
        for batch in batches:
            made = [np.random.default_rng([seed, b]).choice([-1.0, 1.0], (n, width)).tobytes()
                    for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "m"])

    x = written(starts.mapInArrow(first, "key int, m binary"), "start")
    both = BL.filtered(a, x, width, np.eye(width), 1.0, 0)
    discarded(x)
    for cycle in range(max_cycles):
        turn = _orthonormal(BL.gathered(both, ["m"], [width], lambda m: m.T @ m, a.col_blocks).reshape(width, width))
        w = turn.shape[1]
        g = BL.gathered(both, ["m", "im"], [width, width], lambda m, im, t=turn: (m @ t).T @ np.hstack([m @ t, im @ t]),
                        a.col_blocks).reshape(w, 2 * w)
        theta, ritz = _ritz(g[:, :w], g[:, w:])
        turn = turn @ ritz
        kept = min(k, w)
        lead, at = turn[:, :kept], theta[:kept]
        rest = np.sqrt(BL.gathered(both, ["m", "im"], [width, width], lambda m, im, t=lead, h=at: (
            (im @ t - (m @ t) * h) ** 2).sum(axis=0), a.col_blocks))
        if rest.max() <= tol * max(theta[0], 1e-300):
            break
        half = max(theta[-1], 1e-14 * theta[0]) / 2
        known = 0  # far above the others, these would keep the degree low once they are found
        if a.strips is not None:
            known = int(np.argmax(np.append(rest > 0.1 * tol * theta[0], True)[:min(MOST_KNOWN, w // 4) + 1]))
        reach = theta[known:] + rest.max()  # as far as the residual says that a value may still lie above
        most = min(degree, 4 << cycle, _needed(theta[kept - 1], 2 * half, rest.max() / (tol * theta[0])))
        last, both = both, BL.filtered(a, both, width, turn, half, _spread(reach, 2 * half, most),
                                       values=theta[:known], theta=theta, near=rest.max() <= 1e-3 * theta[0])
        width = w
        discarded(last)
    else:
        raise RuntimeError("the singular vectors did not converge")
    k = kept
    sigma = np.sqrt(np.clip(theta[:k], 0.0, None))
    inv = np.where(sigma > 1e-12 * max(sigma[0], 1e-300), 1.0 / np.maximum(sigma, 1e-300), 0.0)
    v = written(BL.mapped(both, ["m"], [width], ["m"], lambda m: [m @ lead]), "items")
    used: list[DataFrame] = []
    u = BL.mapped(BL.left_product(a, v, k, used=used), ["m"], [k], ["m"], lambda m: [m * inv])
    out = {"sigma": sigma, "users": written(BL.rows(u, a.row_keys, k), "users"),
           "items": written(BL.rows(v, a.col_keys, k), "items"), "k": k}
    discarded(both, v, *used, *(t for t in (a.strips, a.thin, a.cells) if t is not None))
    return out


def factor_tables(svd: dict, means: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User factors scaled by sigma with the user mean, and item factors."""
    s = np.asarray(svd["sigma"], dtype=np.float64)
    us = LA.transform(svd["users"], np.diag(s))
    uf = us.select(F.col("key").alias("user_id"), F.col(LA.VEC).alias("us")).join(
        means.select("user_id", "mu"), "user_id")
    itf = svd["items"].select(F.col("key").alias("item_id"), F.col(LA.VEC).alias("v"))
    return uf, itf


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


# ------------------------------------------------------------------ R3
def predict_rating(user_factors: DataFrame, item_factors: DataFrame, requests: DataFrame,
                   lo: float = 0.5, hi: float = 5.0) -> DataFrame:
    """Predicted rating for (request_id, user_id, item_id), clipped and
    rounded to 2 (through nine places, so a decimal tie does not hang on the last bit); null
    with a reason when a side is outside the model."""
    j = (requests.join(user_factors, "user_id", "left").join(item_factors, "item_id", "left"))
    raw = _dot("us", "v") + F.col("mu")
    pred = F.when(F.col("us").isNotNull() & F.col("v").isNotNull(),
                  F.round(F.round(F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)), 9), 2))
    reason = (F.when(F.col("us").isNull(), F.lit("unknown_user"))
              .when(F.col("v").isNull(), F.lit("unknown_item")).otherwise(F.lit("ok")))
    return j.select("request_id", "user_id", "item_id", pred.alias("predicted"),
                    (pred * 2).alias("predicted_10"), reason.alias("reason"))


# --------------------------------------------------- dense scoring in blocks
_SCORES = "request_id long, item_id long, score double"


def _rows(column) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best(q: np.ndarray, off: np.ndarray, seen: tuple[np.ndarray, np.ndarray], ids: np.ndarray, v: np.ndarray,
          n: int, lo: float, hi: float, wide: int = 2048, thin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, places in ``ids`` (ascending) and scores of each row's best ``n`` places outside
    ``seen`` (rows, places); equal to nine places by id, what is not a number last. Items come in
    strips, and of a strip only what beats a row's n-th best so far is looked at: what a product in single precision
    (``thin``: v) less its largest error leaves is scored in double precision."""
    row, at, best = (np.zeros(0, dtype=k) for k in ("i8", "i8", "f8"))
    last, full = np.full(len(q), -np.inf), np.zeros(len(q), dtype=bool)
    odd = not (np.isfinite(v).all() and np.isfinite(q).all() and np.isfinite(off).all())
    reach = 0.0 if odd else np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max(initial=0.0))
    odd = odd or not np.max(reach, initial=0.0) < 1e30
    if not odd:
        thin = v.astype(np.float32) if thin is None else thin
        few, error = q.astype(np.float32), 1.2e-7 * (q.shape[1] + 4) * reach + 1e-30
        rough, over = (np.empty(len(q) * min(len(ids), max(wide, 64, 4 * n)), dtype=k) for k in (np.float32, bool))
    a, step = 0, max(64, 4 * n)
    while a < len(ids):
        if odd:
            s = np.clip(q @ v[a:a + step].T + off[:, None], lo, hi)
            key = np.where(np.isnan(s), -np.inf, s)
            fit = key > last[:, None]
            fit[~full] = True
        else:  # what may beat the n-th best, which the clipped score of no item does once that is hi
            least = np.where(full, np.where(last < hi, last - off - error, np.inf), -np.inf)
            part = thin[a:a + step].T
            size = len(q) * part.shape[1]
            near = np.matmul(few, part, out=rough[:size].reshape(len(q), -1))
            fit = np.greater(near, np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None],
                             out=over[:size].reshape(len(q), -1))
        here = (seen[1] >= a) & (seen[1] < a + step)
        fit[seen[0][here], seen[1][here] - a] = False
        r, c = np.divmod(np.flatnonzero(fit), fit.shape[1])
        score = s[r, c] if odd else np.clip(np.einsum("ij,ij->i", q[r], v[c + a]) + off[r], lo, hi)
        k = np.round(np.where(np.isnan(score), -np.inf, score), 9)
        good = (k > last[r]) | ~full[r]
        r, c, score = r[good], c[good], score[good]
        if len(r):
            row, at, best = np.append(row, r), np.append(at, c + a), np.append(best, score)
            k = np.round(np.where(np.isnan(best), -np.inf, best), 9)
            order = np.lexsort((at, -k, row))
            row, at, best, k = row[order], at[order], best[order], k[order]
            first = np.searchsorted(row, np.arange(len(q)))
            place = np.arange(len(row)) - first[row]
            last[row[place == n - 1]], full[row[place == n - 1]] = k[place == n - 1], True
            row, at, best = row[place < n], at[place < n], best[place < n]
        a, step = a + step, min(2 * step, wide)
    return row, at, best


def _cell(n: int | None, lo: float, hi: float, strip: int = 256):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = right["item_id"].combine_chunks().to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _rows(right["v"])[order]
            thin = None if n is None else v.astype(np.float32)
            for start in range(0, left.num_rows, strip):
                part = left.slice(start, strip)
                q, off = _rows(part["q"]), part["off"].combine_chunks().to_numpy()
                request = part["request_id"].combine_chunks().to_numpy()
                lists = part["seen"].combine_chunks()
                had = np.repeat(np.arange(len(q)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                items = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.searchsorted(ids, items), np.searchsorted(ids, items, "right")
                times = ends[1] - ends[0]  # places of a seen item, an id may come again
                at = np.repeat(ends[0] - np.cumsum(times) + times, times) + np.arange(times.sum())
                seen = np.repeat(had, times), at
                if n is not None:
                    row, at, best = _best(q, off, seen, ids, v, n, lo, hi, thin=thin)
                else:
                    s = np.clip(q @ v.T + off[:, None], lo, hi)
                    free = np.ones(s.shape, dtype=bool)
                    free[seen] = False
                    row, at = np.nonzero(free)
                    best = s[row, at]
                out[0].append(request[row])
                out[1].append(ids[at])
                out[2].append(best)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"request_id": pa.array(join(out[0], "i8"), pa.int64()),
                         "item_id": pa.array(join(out[1], "i8"), pa.int64()),
                         "score": pa.array(join(out[2], "f8"), pa.float64())})

    return score


def block_size(rows: int, least: int, most: int) -> int:
    """Rows a block: a sixteenth of all, so that the other side is sent 16 times whatever its size, within bounds."""
    return max(least, min(most, -(-rows // 16)))


def score_requests(item_factors: DataFrame, req_vectors: DataFrame, vec_col: str, offset_col: str,
                   n: int | None = None, seen: DataFrame | None = None, lo: float = -np.inf, hi: float = np.inf,
                   block_items: int | None = None, block_requests: int | None = None) -> DataFrame:
    """(request_id, item_id, score = q_r . v_i + offset_r, clipped) of the items a request
    has not ``seen`` (request_id, item_id): all of them, or per request and block of items
    the best ``n``. One group per pair of blocks; a seen list holds one block's items. A block grows
    with its table up to 131,072 rows, scored in strips, so a vector is sent about 16 times."""
    n_items, n_requests = item_factors.count(), req_vectors.count()
    block_items = block_items or (4096 if n is None else block_size(n_items, 4096, 131072))
    block_requests = block_requests or (64 if n is None else block_size(n_requests, 1024, 131072))
    items_in = max(1, -(-n_items // block_items))
    requests_in = max(1, -(-n_requests // block_requests))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = req_vectors.select("request_id", F.col(vec_col).alias("q"), F.col(offset_col).cast("double").alias("off"),
                              block("request_id", requests_in).alias("rb"), every(items_in).alias("ib"))
    if seen is None:
        left = left.withColumn("seen", F.array().cast("array<bigint>"))
    else:
        lists = (seen.select("request_id", "item_id", block("item_id", items_in).alias("ib"))
                 .groupBy("request_id", "ib").agg(F.collect_set(F.col("item_id").cast("bigint")).alias("seen")))
        left = left.join(lists, ["request_id", "ib"], "left")
    right = item_factors.select("item_id", "v", block("item_id", items_in).alias("ib"), every(requests_in).alias("rb"))
    return (left.select("request_id", "q", "off", "seen", "rb", "ib").groupBy("rb", "ib")
            .cogroup(right.groupBy("rb", "ib")).applyInArrow(_cell(n, lo, hi), _SCORES))


# ------------------------------------------------------------------ R4
def recommend_users(user_factors: DataFrame, item_factors: DataFrame, users: DataFrame,
                    seen: DataFrame, n: int = 10, lo: float = 0.5, hi: float = 5.0) -> DataFrame:
    """Top-n unseen items per requested user by predicted rating
    (clipped like the dense predicted matrix; ties by item id)."""
    req = users.select("user_id").distinct().join(user_factors, "user_id").select(
        F.col("user_id").alias("request_id"), "us", "mu")
    s = score_requests(item_factors, req, "us", "mu", n, seen.select(F.col("user_id").alias("request_id"), "item_id"),
                       lo, hi)
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), F.asc("item_id"))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumnRenamed("request_id", "user_id"))


# ------------------------------------------------------------------ R5
def fold_in_vectors(item_factors: DataFrame, liked: DataFrame, mu: float, k: int) -> DataFrame:
    """Per request ``(5 - mu) * sum of liked item rows`` (R5: sigma cancels)."""
    j = liked.select("request_id", "item_id").distinct().join(item_factors, "item_id")
    aggs = [F.sum(F.col("v")[i]).alias(f"_s{i}") for i in range(k)]
    s = j.groupBy("request_id").agg(*aggs)
    return s.select("request_id", F.array(*[F.col(f"_s{i}") * (5.0 - mu) for i in range(k)]).alias("q"),
                    F.lit(float(mu)).alias("mu"))


def fold_in_scores(item_factors: DataFrame, liked: DataFrame, mu: float, k: int) -> DataFrame:
    """Predicted rating of every model item for a synthetic user who rated
    the liked items 5: ``r V V^T + mu`` (not clipped)."""
    return score_requests(item_factors, fold_in_vectors(item_factors, liked, mu, k), "q", "mu")


# ------------------------------------------------------------ R6 - R9
def _minmax_params(scores: DataFrame, n_catalog: DataFrame, col: str) -> DataFrame:
    """Per request lo/hi of a catalog-wide vector that is 0 outside the rows
    given (W5 over the whole catalog; all zeros when hi <= lo)."""
    per = scores.groupBy("request_id").agg(F.count(F.lit(1)).alias("_np"), F.min(col).alias("_mn"),
                                           F.max(col).alias("_mx"))
    per = per.join(F.broadcast(n_catalog), how="inner", on=F.lit(True))
    has_zero = F.col("_np") < F.col("_ncat")
    lo = F.when(has_zero, F.least(F.col("_mn"), F.lit(0.0))).otherwise(F.col("_mn"))
    hi = F.when(has_zero, F.greatest(F.col("_mx"), F.lit(0.0))).otherwise(F.col("_mx"))
    return per.select("request_id", lo.alias("lo"), hi.alias("hi"))


def _norm(x, lo, hi):
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))


def cf_scores(item_factors: DataFrame, liked: DataFrame, catalog_ids: DataFrame, mu: float,
              k: int) -> DataFrame:
    """Fold-in scores on the catalog (absent items are 0 before min-max)."""
    f = fold_in_scores(item_factors, liked, mu, k).join(
        catalog_ids.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    n_cat = catalog_ids.agg(F.count(F.lit(1)).alias("_ncat"))
    p = _minmax_params(f, n_cat, "score")
    out = f.join(p, "request_id")
    return out.select("request_id", "item_id", F.col("score").alias("raw"),
                      _norm(F.col("score"), F.col("lo"), F.col("hi")).alias("norm"),
                      _norm(F.lit(0.0), F.col("lo"), F.col("hi")).alias("zero_norm"))


def _ranges(mu: float):
    """Per request least and largest score of a block of items, and their number."""
    def span(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        s = _rows(left["q"]) @ _rows(right["v"]).T + mu if n else np.zeros((0, 1))
        return pa.table({"request_id": left["request_id"].slice(0, n), "mn": pa.array(s.min(axis=1)),
                         "mx": pa.array(s.max(axis=1)), "n": pa.array(np.full(n, right.num_rows, dtype=np.int64))})

    return span


def _dealt(items: DataFrame, requests: DataFrame, block_items: int, block_requests: int):
    """Both sides dealt over pairs of blocks (rb, ib), and the block of an item."""
    items_in = max(1, -(-items.count() // block_items))
    requests_in = max(1, -(-requests.count() // block_requests))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = requests.select("*", block("request_id", requests_in).alias("rb"), every(items_in).alias("ib"))
    right = items.select("item_id", "v", block("item_id", items_in).alias("ib"), every(requests_in).alias("rb"))
    return left, right, lambda c: block(c, items_in)


def cf_ranges(item_factors: DataFrame, vectors: DataFrame, catalog_ids: DataFrame, mu: float,
              block_items: int = 4096, block_requests: int = 1024) -> DataFrame:
    """Per request of ``vectors`` (request_id, q) the ends ``lo, hi`` of its fold-in scores over the
    whole catalog (items outside the model are 0, W5), and ``top``, the largest normalised one, from
    one row per request and block of items. Requests without a model item in the catalog are absent."""
    ids = catalog_ids.select(F.col("id").cast("long").alias("item_id")).distinct()
    items = item_factors.select("item_id", "v").join(ids, "item_id", "left_semi")
    left, right, _ = _dealt(items, vectors.select("request_id", "q"), block_items, block_requests)
    spans = left.groupBy("rb", "ib").cogroup(right.groupBy("rb", "ib")).applyInArrow(
        _ranges(mu), "request_id long, mn double, mx double, n long")
    per = spans.groupBy("request_id").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("n").alias("n"))
    per = per.join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n_catalog"))), how="inner", on=F.lit(True))
    zero = F.col("n") < F.col("n_catalog")
    ends = per.select("request_id", "mx", F.when(zero, F.least("mn", F.lit(0.0))).otherwise(F.col("mn")).alias("lo"),
                      F.when(zero, F.greatest("mx", F.lit(0.0))).otherwise(F.col("mx")).alias("hi"))
    return ends.select("request_id", "lo", "hi", _norm(F.col("mx"), F.col("lo"), F.col("hi")).alias("top"))


def _blend(mu: float, alpha: float, n: int):
    """The best ``n`` of a block of catalog items for each request of a block."""
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = right["item_id"].combine_chunks().to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], right["v"].combine_chunks()
            known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False)[order])
            v = _rows(right["v"].take(order[known])) if len(known) else None
            for r in left.to_pylist():
                f = np.full(len(ids), r["zf"])
                if v is not None and r["q"] is not None and r["lo"] is not None:
                    wide = r["hi"] - r["lo"]
                    f[known] = (v @ np.array(r["q"]) + mu - r["lo"]) / wide if wide > 0 else 0.0
                c = np.full(len(ids), r["zc"])
                if r["items"]:
                    at = np.searchsorted(ids, r["items"])
                    here = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == r["items"])
                    c[at[here]] = np.array(r["norms"])[here]
                score = (1 - alpha) * c + alpha * f
                fit = score > 0
                if r["own"]:
                    fit[np.isin(ids, np.array(r["own"], dtype=np.int64))] = False
                at = np.flatnonzero(fit)
                at = at[np.lexsort((ids[at], -np.round(score[at], 9)))[:n]]
                out[0].append(np.full(len(at), r["request_id"], dtype=np.int64))
                out[1].append(ids[at])
                out[2].append(score[at])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"request_id": pa.array(join(out[0], "i8"), pa.int64()),
                         "item_id": pa.array(join(out[1], "i8"), pa.int64()),
                         "score": pa.array(join(out[2], "f8"), pa.float64())})

    return best


def hybrid_topn(content: DataFrame, item_factors: DataFrame, liked: DataFrame, catalog_ids: DataFrame, mu: float,
                k: int, alpha: float = 0.5, n: int = 20, block_items: int = 4096, block_requests: int = 256) -> DataFrame:
    """R7 like ``hybrid_recommend``, without a table of requests times items: the collaborative
    scores are made and blended where they are needed, in the pair of a block of requests and a
    block of catalog items, and at most ``n`` rows leave it per request.

    ``content`` carries (request_id, item_id, norm, zero_norm). A first pass finds each request's ends
    of the collaborative scores (one row per request and block), a second one blends: an item that an
    engine does not cover takes that engine's value for 0. Liked items are masked, scores must be
    positive, ties go to the smaller id."""
    alpha = float(max(0.0, min(1.0, alpha)))
    vectors = written(fold_in_vectors(item_factors, liked, mu, k).select("request_id", "q"), "requests")
    ends = cf_ranges(item_factors, vectors, catalog_ids, mu, block_items, block_requests)
    zero = content.groupBy("request_id").agg(F.first("zero_norm").alias("zc"))
    requests = written(
        liked.select("request_id").distinct().join(vectors, "request_id", "left").join(ends, "request_id", "left")
        .join(zero, "request_id", "left")
        .select("request_id", "q", "lo", "hi", _norm(F.lit(0.0), F.col("lo"), F.col("hi")).alias("zf"),
                F.coalesce("zc", F.lit(0.0)).alias("zc")), "ends")
    items = written(catalog_ids.select(F.col("id").cast("long").alias("item_id")).distinct()
                    .join(item_factors.select("item_id", "v"), "item_id", "left"), "catalog")
    left, right, block = _dealt(items, requests, block_items, block_requests)
    norms = (content.select("request_id", F.col("item_id").cast("long").alias("item_id"), "norm", block("item_id").alias("ib"))
             .groupBy("request_id", "ib").agg(F.collect_list(F.struct("item_id", "norm")).alias("c"))  # of one block
             .select("request_id", "ib", F.col("c.item_id").alias("items"), F.col("c.norm").alias("norms")))
    own = (liked.select("request_id", F.col("item_id").cast("long").alias("item_id")).distinct()
           .groupBy("request_id", block("item_id").alias("ib")).agg(F.collect_list("item_id").alias("own")))
    left = left.join(norms, ["request_id", "ib"], "left").join(own, ["request_id", "ib"], "left")
    best = left.groupBy("rb", "ib").cogroup(right.groupBy("rb", "ib")).applyInArrow(_blend(mu, alpha, n), _SCORES)
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), F.asc("item_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hybrid_recommend(content: DataFrame, cf: DataFrame, liked: DataFrame, catalog_ids: DataFrame,
                     alpha: float = 0.5, n: int = 20) -> DataFrame:
    """``(1 - alpha) * content + alpha * cf`` over the whole catalog,
    liked items removed, score > 0, top-n per request (ties by item id).

    ``content``/``cf`` carry (request_id, item_id, norm, zero_norm) for the
    items each engine covers; every other catalog item takes the engine's
    ``zero_norm``. Items covered by neither engine share one constant score
    per request; when it is positive the n smallest such ids compete too.
    """
    alpha = float(max(0.0, min(1.0, alpha)))
    c = content.select("request_id", "item_id", F.col("norm").alias("cn"))
    f = cf.select("request_id", "item_id", F.col("norm").alias("fn"))
    zc = content.groupBy("request_id").agg(F.first("zero_norm").alias("zc"))
    zf = cf.groupBy("request_id").agg(F.first("zero_norm").alias("zf"))
    reqs = liked.select("request_id").distinct()
    z = reqs.join(zc, "request_id", "left").join(zf, "request_id", "left").fillna(0.0, ["zc", "zf"])
    both = c.join(f, ["request_id", "item_id"], "full").join(z, "request_id")
    score = ((1 - alpha) * F.coalesce("cn", "zc") + alpha * F.coalesce("fn", "zf"))
    scored = both.select("request_id", "item_id", score.alias("score"))
    # items that neither engine covers for this request share one score: its first n such ids compete
    const = z.select("request_id", ((1 - alpha) * F.col("zc") + alpha * F.col("zf")).alias("score")).where("score > 0")
    ids = catalog_ids.select(F.col("id").alias("item_id")).distinct()
    placed = positions(ids, [], ["item_id"])
    own = scored.select("request_id", "item_id").unionByName(liked.select("request_id", "item_id"))
    free = first_free(own.join(placed, "item_id"), const, "request_id", n, ids.count())
    idle = free.join(placed, POS).join(const, "request_id").select("request_id", "item_id", "score")
    allc = scored.unionByName(idle).join(ids, "item_id", "left_semi")
    allc = allc.join(liked.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
    allc = allc.where(F.col("score") > 0)
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), F.asc("item_id"))
    return allc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def seed_coverage(liked: DataFrame, content_ids: DataFrame, cf_ids: DataFrame) -> DataFrame:
    """Each deduplicated liked id, whether either engine covers it
    (used) or neither (ignored)."""
    d = liked.select("request_id", "item_id").distinct()
    c = content_ids.select(F.col("id").alias("item_id")).distinct().withColumn("in_content", F.lit(True))
    f = cf_ids.select(F.col("id").alias("item_id")).distinct().withColumn("in_cf", F.lit(True))
    j = d.join(c, "item_id", "left").join(f, "item_id", "left").fillna(False, ["in_content", "in_cf"])
    return j.select("request_id", "item_id", "in_content", "in_cf",
                    F.when(F.col("in_content") | F.col("in_cf"), F.lit("used"))
                    .otherwise(F.lit("ignored")).alias("status"))


def engine_coverage(content_ids: DataFrame, cf_ids: DataFrame) -> DataFrame:
    """U4: items per engine, their union and overlap."""
    c = content_ids.select(F.col("id").alias("item_id")).distinct().withColumn("c", F.lit(1))
    f = cf_ids.select(F.col("id").alias("item_id")).distinct().withColumn("f", F.lit(1))
    j = c.join(f, "item_id", "full")
    return j.agg(F.count("c").alias("n_content"), F.count("f").alias("n_cf"),
                 F.count(F.lit(1)).alias("n_union"),
                 F.count_if(F.col("c").isNotNull() & F.col("f").isNotNull()).alias("n_overlap"))


def hybrid_status(coverage: DataFrame, content: DataFrame, cf: DataFrame, recs: DataFrame,
                  alpha: float) -> DataFrame:
    """Per request the outcome and hint of the hybrid call."""
    used = coverage.groupBy("request_id").agg(F.count_if(F.col("status") == "used").alias("n_used"),
                                              F.count_if(F.col("status") == "ignored").alias("n_ignored"))
    ch = content.groupBy("request_id").agg((F.max("norm") > 0).alias("content_has"))
    fh = cf.groupBy("request_id").agg((F.max("norm") > 0).alias("cf_has"))
    nr = recs.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_recs"))
    j = (used.join(ch, "request_id", "left").join(fh, "request_id", "left").join(nr, "request_id", "left")
         .fillna(False, ["content_has", "cf_has"]).fillna(0, ["n_recs"]))
    a = float(max(0.0, min(1.0, alpha)))
    status = (F.when(F.col("n_used") == 0, F.lit("no_seed_covered"))
              .when(F.col("n_recs") > 0, F.lit("ok"))
              .when(F.lit(a >= 1.0) & F.col("content_has") & ~F.col("cf_has"), F.lit("move_to_content"))
              .when(F.lit(a <= 0.0) & F.col("cf_has") & ~F.col("content_has"), F.lit("move_to_collaborative"))
              .otherwise(F.lit("no_signal")))
    return j.select("request_id", "n_used", "n_ignored", "n_recs", "content_has", "cf_has",
                    status.alias("status"))


def explain_recs(recs: DataFrame, seed_sims: DataFrame, used: DataFrame, titles: DataFrame) -> DataFrame:
    """For each recommendation the used seed with the largest content
    similarity (ties -> smaller seed id), only when that similarity > 0."""
    s = seed_sims.join(used.select("request_id", F.col("item_id").alias("seed_id")),
                       ["request_id", "seed_id"], "left_semi")
    s = s.join(recs.select("request_id", "item_id"), ["request_id", "item_id"], "left_semi")
    best = s.groupBy("request_id", "item_id").agg(
        F.min_by(F.struct("seed_id", "sim"), F.struct(-F.round("sim", 9), F.col("seed_id"))).alias("b"))
    best = best.where(F.col("b.sim") > 0).select("request_id", "item_id",
                                                 F.col("b.seed_id").alias("source_id"),
                                                 F.round("b.sim", 3).alias("sim"))
    return best.join(titles.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")),
                     "source_id", "left")


# ---------------------------------------------------------- R11 - R15
def split_flag(df: DataFrame, key_cols, seed: int = 42, test_pct: int = 20) -> DataFrame:
    """Deterministic hash split (repartition-safe, unlike rand(seed))."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_test", F.pmod(h, F.lit(100)) < test_pct)


def servable(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test pairs whose user and item both occur in train."""
    return (test.join(train.select("user_id").distinct(), "user_id", "left_semi")
            .join(train.select("item_id").distinct(), "item_id", "left_semi"))


def rating_error(pred: DataFrame, truth: str = "rating", p: str = "predicted") -> DataFrame:
    """RMSE and MAE."""
    d = F.col(p) - F.col(truth)
    return pred.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"),
                    F.avg(F.abs(d)).alias("mae"))


def precision_at_k(recs: DataFrame, test_servable: DataFrame, k: int = 10, liked: float = 4.0,
                   min_likes: int = 5) -> DataFrame:
    """Users with >= min_likes liked servable test ratings; hits / k
    averaged over those that received recommendations."""
    lk = test_servable.where(F.col("rating") >= liked).select("user_id", "item_id").distinct()
    elig = lk.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_liked")).where(
        F.col("n_liked") >= min_likes)
    r = recs.select("user_id", "item_id").join(elig.select("user_id"), "user_id", "left_semi")
    got = r.select("user_id").distinct()
    hits = r.join(lk, ["user_id", "item_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    per = got.join(hits, "user_id", "left").fillna(0, ["hits"])
    return per.agg(F.count(F.lit(1)).alias("n_users"),
                   F.avg(F.col("hits") / k).alias("precision"),
                   F.sum("hits").alias("total_hits"))


def popularity_recs(train: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Baseline recommender: the k most rated train items a user has not
    rated, found as the first free places of the popularity order between the places
    of the user's own items, so no user x item pairs arise."""
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = positions(pop, [], [F.desc("cnt"), F.asc("item_id")]).select("item_id", POS)
    own = train.select("user_id", "item_id").distinct().join(ranked, "item_id")
    free = first_free(own, users, "user_id", k, ranked.count()).join(ranked, POS)
    w = Window.partitionBy("user_id").orderBy(POS)
    return free.withColumn("rank", F.row_number().over(w)).select("user_id", "item_id", "rank")


def random_precision(train: DataFrame, test_servable: DataFrame, liked: float = 4.0,
                     min_likes: int = 5) -> DataFrame:
    """Expected precision of a uniform ranking of unseen train items:
    mean over eligible users of liked_test / unseen candidates."""
    n_items = train.select("item_id").distinct().agg(F.count(F.lit(1)).alias("_ni"))
    seen = train.select("user_id", "item_id").distinct().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("s"))
    lk = test_servable.where(F.col("rating") >= liked).select("user_id", "item_id").distinct()
    elig = lk.groupBy("user_id").agg(F.count(F.lit(1)).alias("L")).where(F.col("L") >= min_likes)
    j = elig.join(seen, "user_id").join(F.broadcast(n_items), how="inner", on=F.lit(True))
    return j.agg(F.count(F.lit(1)).alias("n_users"),
                 F.avg(F.col("L") / (F.col("_ni") - F.col("s"))).alias("random_precision"))


# ------------------------------------------------------------------ W5
def minmax_norm(df: DataFrame, col: str, out: str = "norm") -> DataFrame:
    """``(x - lo) / (hi - lo)`` over all rows, 0 when hi <= lo. lo/hi come
    from a one-row aggregate broadcast back (no unpartitioned window)."""
    mm = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.join(F.broadcast(mm), how="inner", on=F.lit(True))
    return j.withColumn(out, _norm(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
