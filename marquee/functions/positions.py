"""Distributed positions and exact quantiles, in JVM operators only.

``running_totals`` gives every row the sum of a weight over the rows before it in its
key group, without ever moving a group into one task:

1. the rows are range-partitioned on (keys, order) once and *written* with their
   partition number, so every later step sees one and the same partitioning (a second
   use of a range shuffle would sample its own bounds);
2. per (partition, key) totals - at most #partitions + #keys rows - become offsets by
   a running sum per key;
3. within a (partition, key) the running sum is a window over a bounded slice.

A global ``row_number()`` or a per-group window would put a whole group, possibly a
third of the data, into one task.

``positions`` is that with weight 1. ``grouped_quantiles`` needs no order of all rows: a sketch
brackets the wanted places and a second scan counts out what lies within (the exact
linear-interpolation quantile, ``quantile_cont`` / the numpy default). It writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import written

PID = "_pid"
POS = "_pos"


def _join_by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Inner join on equal keys (null equals null) and plain columns ``also``."""
    renamed = {k: f"_r{i}" for i, k in enumerate((*keys, *also))}
    right = right.withColumnsRenamed(renamed)
    on = [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys] + [F.col(k) == F.col(renamed[k]) for k in also]
    return left.join(right, reduce(lambda x, y: x & y, on, F.lit(True))).drop(*renamed.values())


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: Column,
                   out: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out``: the weight before each row within ``keys`` under ``order``."""
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sort_cols = [F.col(k) for k in keys] + order_cols
    ranged = (df.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else df.repartitionByRange(*sort_cols))
    placed = written(ranged.withColumn("_w", weight.cast("bigint")).withColumn(PID, F.spark_partition_id()), "ranged")
    totals = placed.groupBy(PID, *keys).agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PID, *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(PID, *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return _join_by_keys(local, offsets, keys, [PID]).select(
        *df.columns, (F.col("_off") + F.col("_local")).alias(out))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
              num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_pos``: 0-based position within ``keys`` under ``order``.

    ``order`` must be a total order inside each key group (append a unique
    column as the last tie-break) for the result to be deterministic. A null key is a
    group of its own.
    """
    return running_totals(df, keys, order, F.lit(1), POS, num_partitions)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                      probs: Iterable[float], names: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` per ``keys``, by selection in two scans.

    Returns ``keys`` + ``n`` + one column per probability (named ``names`` or
    ``q0, q1, ...``). Null values are ignored; groups with no value are absent,
    and a null key is a group of its own.

    A mergeable sketch per group, whose rank error is at most n / ``accuracy``, brackets every wanted
    place. The second scan counts the values within the brackets one by one and all between two brackets as one row
    with its ends, so a group ends as about 6 n / ``accuracy`` distinct values per
    probability, over which the places are counted out; only these meet in one task.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin, order = 3.0 / accuracy, sorted(set(probs))
    ends = [e for p in order for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    brackets = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_b"))
    low, high = ([F.col("_b")[2 * i + side] for i in range(len(order))] for side in (0, 1))
    inside = reduce(lambda x, y: x | y, [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in zip(low, high)])
    passed = reduce(lambda x, y: x + y, [(F.col("_v") > b).cast("int") for b in high])
    counted = (_join_by_keys(rows, brackets, keys)
               .select(*keys, "_v", passed.alias("_passed"), F.when(inside, F.col("_v")).alias("_one"))
               .groupBy(*keys, "_passed", "_one")
               .agg(F.count(F.lit(1)).alias("_times"), F.min("_v").alias("_first"), F.max("_v").alias("_last")))
    group = Window.partitionBy(*keys)
    placed = counted.select(
        "*", F.sum("_times").over(group).alias("n"),
        F.coalesce(F.sum("_times").over(group.orderBy("_passed", F.asc_nulls_first("_one"))
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))

    def at(place: Column) -> Column:
        nth = place - F.col("_before")
        return F.when((nth < 0) | (nth >= F.col("_times")), None).when(
            F.col("_one").isNotNull() | (nth == 0), F.col("_first")).when(
            nth == F.col("_times") - 1, F.col("_last")).otherwise(
            F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("n") - 1) * F.lit(p)
        share = F.max(h - F.floor(h))
        aggs.append((F.max(at(F.floor(h))) * (1 - share) + F.max(at(F.ceil(h))) * share).alias(name))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def first_free(taken: DataFrame, groups: DataFrame, group: str, n: int, total: int) -> DataFrame:
    """Per row of ``groups`` the first ``n`` places of 0 .. total - 1 that the group has not
    taken, as ``group, _pos``; ``taken`` holds ``group, _pos``. Only the gaps between a
    group's taken places are looked at, so n rows come out, however many are taken."""
    ends = groups.select(group).distinct().withColumn(POS, F.lit(total).cast("bigint"))
    rows = taken.select(group, F.col(POS).cast("bigint").alias(POS)).distinct().join(
        groups.select(group).distinct(), group, "left_semi").unionByName(ends)
    w = Window.partitionBy(group).orderBy(POS)
    gaps = rows.select(group, POS, (F.lag(POS, 1, -1).over(w) + 1).alias("_start"),
                       (F.row_number().over(w) - 1).alias("_taken"))
    gaps = gaps.withColumn("_some", F.least(F.col(POS) - F.col("_start"), F.lit(n) - (F.col("_start") - F.col("_taken"))))
    return gaps.where("_some > 0").select(
        group, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_some") - 1)).alias(POS))
