"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each text gets plain counts, base rules on them, and a vector of four transformed
statistics. Per cohort - the texts of one language and source that pass the base
rules - a minimum-covariance-determinant estimate of centre and scatter is made by
concentration steps: from medians and median deviations on, the share ``keep`` of
rows with the smallest Mahalanobis distances gives the next centre and covariance,
each step lowering its determinant. The last estimate is reweighted once and a text
is rejected if its squared distance exceeds the chi-square quantile ``cutoff``.

The vector, with ``k`` (pseudo) words added to a text so that short ones, whose shares
say little, lie near the middle: log of the mean word length, and square roots of
symbols per word, of the share of repeated lines and of the share of words in
repeated five-word windows. Variances have a floor, so that a statistic which is zero for nearly
all of a cohort does not reject the first text that has a little of it.

Scale: texts are read once and never shuffled; the steps scan a table of a few numbers
per text. A step is one aggregate by (cohort, distance bin) with map-side combine -
quantiles and sums both come from its bins, at most a few thousand per cohort - so no
cohort, however large, is gathered anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.workers import shielded
from marquee.session import written

DIM = 4
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Smallest variance of each statistic within a cohort.
FLOOR = (0.01, 0.02, 0.02, 0.02)
_X = [f"x{i}" for i in range(DIM)]
_M = [f"m{i}" for i in range(DIM)]
_L = [f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _bare(text) -> Column:
    return F.translate(text, SPACE, "")


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that the text has twice or more."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + n] for n in range(width)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = _let(ordered, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda e, j: F.get(s, j - 1)["h"].eqNullSafe(e["h"])
                     | F.get(s, j + 1)["h"].eqNullSafe(e["h"])), lambda e: e["i"])))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(places, covered)).otherwise(F.lit(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, _let(_let(hashes, windows), repeated)).otherwise(F.lit(0))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_lines, n_repeat_words`` (longs) of the whole text; a null text is empty. Columns of
    these names are replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    rest = [c for c in docs.columns if c not in made and c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " ", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: _bare(x) != "")
    per_words = _let(parts, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    per_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return (docs.select(*rest, F.length(_bare(text)).alias("word_chars"),
                        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
                        per_words.alias("_w"), per_lines.alias("_l"))
            .select(*rest, F.col("_w.n").cast("long").alias("n_words"), F.col("word_chars").cast("long"),
                    F.col("n_symbols").cast("long"), (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
                    F.col("_l.n").cast("long").alias("n_lines"), F.col("_w.r").cast("long").alias("n_repeat_words")))


def _vector(k: float) -> list[Column]:
    words = F.col("n_words") + F.lit(k)
    return [F.log((F.col("word_chars") + F.lit(5.0 * k)) / words),
            F.sqrt(F.col("n_symbols") / words),
            F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(k / 10))),
            F.sqrt(F.col("n_repeat_words") / words)]


def chi2_cdf(x: float, d: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, d // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


def _factor(params: DataFrame) -> DataFrame:
    """Covariances ``c<ij>`` (i >= j) to their Cholesky factor ``l<ij>``, column after column."""
    for i in range(DIM):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}")
            for p in range(j):
                s = s - F.col(f"l{i}{p}") * F.col(f"l{j}{p}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j
                                       else s / F.col(f"l{j}{j}"))
    return params.select("cohort", *_M, *_L)


def _distance(df: DataFrame) -> DataFrame:
    """``d2``: the squared Mahalanobis distance by the params joined on."""
    z = []
    for i in range(DIM):
        s = F.col(_X[i]) - F.col(_M[i])
        for j in range(i):
            s = s - F.col(f"l{i}{j}") * F.col(f"_z{j}")
        df = df.withColumn(f"_z{i}", s / F.col(f"l{i}{i}"))
        z.append(F.col(f"_z{i}") * F.col(f"_z{i}"))
    return df.withColumn("d2", z[0] + z[1] + z[2] + z[3]).drop(*[f"_z{i}" for i in range(DIM)])


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(F.least(d2, F.lit(1e12))) * 200)


def _middle(rows: DataFrame, values: list[Column], names: list[str], width: float = 0.005) -> DataFrame:
    """Per cohort the median of every value, to ``width``."""
    long = rows.select("cohort", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.floor(v / width).alias("b"))
                                                     for n, v in zip(names, values)])).alias("e"))
    counts = long.groupBy("cohort", "e.name", "e.b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cohort", "name")
    up = w.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = (counts.withColumn("c", F.sum("n").over(up)).withColumn("t", F.sum("n").over(w))
               .where(2 * F.col("c") >= F.col("t")))
    least = reached.groupBy("cohort", "name").agg(F.min("b").alias("b"))
    return least.groupBy("cohort").agg(*[
        F.max(F.when(F.col("name") == n, (F.col("b") + 0.5) * width)).alias(n) for n in names])


def _moments(rows: DataFrame, keep: float | None, limit: float | None, factor: float, floor) -> DataFrame:
    """The next params: mean and covariance (times ``factor``) of the rows with the smallest
    distances - the share ``keep``, to a bin, or those up to ``limit``."""
    y = [F.col(_X[i]) - F.col(_M[i]) for i in range(DIM)]
    sums = [F.sum(y[i]).alias(f"s{i}") for i in range(DIM)]
    sums += [F.sum(y[i] * y[j]).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)]
    if limit is not None:
        inner = rows.where(F.col("d2") <= limit).groupBy("cohort", *_M).agg(F.count(F.lit(1)).alias("n"), *sums)
    else:
        bins = rows.groupBy("cohort", *_M, _bin(F.col("d2")).alias("b")).agg(F.count(F.lit(1)).alias("n"), *sums)
        w = Window.partitionBy("cohort")
        below = w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        bins = (bins.withColumn("c", F.coalesce(F.sum("n").over(below), F.lit(0)))
                .withColumn("t", F.sum("n").over(w)).where(F.col("c") < F.col("t") * keep))
        inner = bins.groupBy("cohort", *_M).agg(*[F.sum(c).alias(c) for c in bins.columns if c[0] in "nsq"])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIM)]
    cov = [((F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * F.lit(factor)
            + F.lit(floor[i] if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    moved = inner.select("cohort", *[(F.col(_M[i]) + mean[i]).alias(_M[i]) for i in range(DIM)], *cov)
    return _factor(moved)


def robust_estimates(rows: DataFrame, keep: float = 0.75, steps: int = 5, floor=FLOOR) -> DataFrame:
    """``cohort``, centre ``m<i>`` and Cholesky factor ``l<ij>`` of the reweighted MCD of the
    columns ``x<i>``; the input is scanned once a step, so pass a written table."""
    centre = written(_middle(rows, [F.col(x) for x in _X], _M), "centre")
    away = rows.join(centre, "cohort")
    spread = _middle(away, [F.abs(F.col(x) - F.col(m)) for x, m in zip(_X, _M)], [f"d{i}" for i in range(DIM)])
    first = centre.join(spread, "cohort")
    params = _factor(first.select("cohort", *_M, *[
        (F.pow(F.col(f"d{i}") * 1.4826, 2) + F.lit(floor[i]) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
        for i in range(DIM) for j in range(i + 1)]))
    shrunk = keep / chi2_cdf(chi2_quantile(keep, DIM), DIM + 2)
    for step in range(steps + 1):
        placed = _distance(rows.join(written(params, f"params{step}"), "cohort"))
        params = (_moments(placed, keep, None, shrunk, floor) if step < steps
                  else _moments(placed, None, chi2_quantile(0.975, DIM), 1.0, floor))
    return written(params, "estimates")


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            pseudo_words: float = 20.0, min_rows: int = 50, keep: float = 0.75, cutoff: float = 0.9999) -> DataFrame:
    """``docs`` without its text, with the counts of :func:`text_stats`, ``base_failed``,
    ``distance`` (squared; null where there is no estimate) and ``kept``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated windows.
    A null language or source is a value of its own. Cohorts of fewer than ``min_rows``
    rows are pooled by language, and what is still smaller over all; a pool that is
    smaller even then has no estimate and its rows are kept if the base rules pass.
    Repeated rows count each. Columns of the names that are made are replaced.
    """
    made = ("base_failed", "distance", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    base, restored = shielded(docs, text_col, lang_col, source_col, made=made)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (lang_col, source_col))
    stats = text_stats(base, text_col).withColumn("base_failed", failed)
    stats = stats.select("*", *[v.alias(x) for x, v in zip(_X, _vector(pseudo_words))],
                         F.concat(F.lit("s"), F.length(lang).cast("string"), lang, source).alias("_s"),
                         F.concat(F.lit("l"), lang).alias("_l"))
    stats = written(stats, "stats")
    fine = stats.where("NOT base_failed")
    by_source = fine.groupBy("_s", "_l").agg(F.count(F.lit(1)).alias("n"))
    large = by_source.where(F.col("n") >= min_rows).select("_s", F.col("_s").alias("cohort"))
    by_lang = by_source.where(F.col("n") < min_rows).groupBy("_l").agg(F.sum("n").alias("n"))
    pooled = by_source.where(F.col("n") < min_rows).select("_s", "_l").join(by_lang, "_l").select(
        "_s", F.when(F.col("n") >= min_rows, F.col("_l")).otherwise(F.lit("all")).alias("cohort"), "_l")
    cohorts = written(large.unionByName(pooled.drop("_l")), "cohorts")
    rows = written(fine.select("_s", *_X).join(cohorts, "_s").select("cohort", *_X), "vectors")
    enough = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("cohort")
    estimates = robust_estimates(rows, keep).join(enough, "cohort")
    judged = _distance(stats.join(cohorts.join(estimates, "cohort"), "_s", "left"))
    far = F.coalesce(F.col("d2") > chi2_quantile(cutoff, DIM), F.lit(False))
    keepers = [c for c in stats.columns if c not in (*_X, "_s", "_l")]
    return restored(judged.select(*keepers, F.col("d2").alias("distance"), (~F.col("base_failed") & ~far).alias("kept")))
